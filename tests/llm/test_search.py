"""Language ID, nearest neighbours, the similarity join and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from sievework.llm import ann, langid, ngram_join

from .conftest import WORDS, rows
from .test_documents import thue_morse


def test_language(spark, docs, none):
    r = random.Random(9)
    texts = [(i, " ".join(r.choice(WORDS[lang]) for _ in range(30)), lang) for i, lang in enumerate(r.choice(sorted(WORDS)) for _ in range(400))]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.identify(df).collect()}
    held = [x for x in texts if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert [got[x[0]].held_out for x in texts] == [zlib.crc32(str(x[0]).encode()) % 4 == 2 for x in texts]
    assert np.mean([got[x[0]].lang_pred == x[2] for x in held]) > 0.97
    odd = langid.identify(docs).collect()
    assert Counter(x.doc_id for x in odd) == Counter(x[0] for x in rows()) and all(0 <= x.score <= 1 for x in odd)
    assert {x.lang_pred for x in odd if x.doc_id in (100, 101, 102, 114)} == {"und"}
    assert langid.identify(none).count() == 0


def _plain_profile(text):
    """Bound and bundled one trigram after another."""
    table, letters = langid.letter_table(), [0]
    for ch in text:
        low = ch.lower()
        number = 1 + (ord(low[0]) if len(low) == 1 else ord(ch)) % (langid.LETTERS - 1) if ch.isalpha() else 0
        if number or letters[-1]:
            letters.append(number)
    if letters[-1]:
        letters.append(0)
    total = np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        total += np.roll(table[a], 2).astype(int) * np.roll(table[b], 1) * table[c]
    return total / np.linalg.norm(total) if total.any() else None


def test_language_equals_plain_bundles(spark):
    """Profiles, prototypes and cosines against plain sums; ties go to the first name."""
    r = random.Random(3)
    words = {"aa": ["the", "of", "Über", "Ærø"], "bb": ["der", "das", "nicht", "ein"], "cc": ["le", "été", "où", "des"]}
    data = [(i, " ".join(r.choices(words[lang], k=12)) + " 1,2! " * (i % 3), lang) for i, lang in enumerate(r.choices(sorted(words), k=150))]
    data += [(900, "the der le ß 漢字", "aa"), (901, "x", "bb"), (902, None, "cc"), (903, "12 34", "aa")]
    for text in (data[0][1], "ab", "A b\n\nc", "ß İ 漢字", "q" * 5000):
        assert np.abs(langid.Profiles().profile(text) - _plain_profile(text)).max() < 1e-5
    learned = {}
    for i, text, lang in data:
        if zlib.crc32(str(i).encode()) % 4 != 2 and text and (v := _plain_profile(text)) is not None:
            learned[lang] = learned.get(lang, 0) + v
    unit = np.stack([learned[x] / np.linalg.norm(learned[x]) for x in sorted(learned)])
    near = unit - unit.mean(0)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    for i, text, _ in data:
        v = _plain_profile(text) if text else None
        if v is None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        score = near @ (v - unit.mean(0)) / np.linalg.norm(v - unit.mean(0))
        assert got[i].lang_pred == sorted(learned)[int(np.argmax(score))] and abs(got[i].score - min(1.0, max(0.0, score.max()))) < 1e-4
    one = langid.Profiles().profile("alpha beta gamma")
    same = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta")], "doc_id long, text string")
    assert [x.lang_pred for x in langid.predict(same, ["yy", "zz"], np.stack([one, one]), np.zeros(langid.DIMENSIONS), ["doc_id"]).collect()] == ["yy", "yy"]


def test_prediction_ignores_labels(spark):
    r = random.Random(3)
    texts = [(i, " ".join(r.choice(WORDS[lang]) for _ in range(20)), lang, "s") for i, lang in enumerate(r.choice(sorted(WORDS)) for _ in range(200))]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    schema = "doc_id long, text string, lang string, source string"
    a = langid.identify(spark.createDataFrame(texts, schema)).collect()
    b = langid.identify(spark.createDataFrame([(i, t, None if held(i) else k, "x") for i, t, k, _ in texts], schema)).collect()
    assert {x.doc_id: x.lang_pred for x in a} == {x.doc_id: x.lang_pred for x in b}


def _vectors():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)]
    v[100:300] = v[100]
    data = [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]
    return data + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] + [1.0] * 15), (5200, []), (5250, [1.0, 2.0]), (None, data[0][1]), data[50]]


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "TILE", 64)
    monkeypatch.setattr(ann, "LEAF_ROWS", 100)
    data = _vectors()
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS v", "'y' AS leaf", "vec_id AS query_id", "1 AS rank")
    got = defaultdict(list)
    for x in ann.search(df).orderBy("query_id", "rank").collect():
        assert 0.97 <= x.recall <= 1.0
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    m = np.array([v for i, v in data[:3000]], np.float32).astype(float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = 0
    assert set(got) == set(range(0, 3000, 50))
    for q, found in got.items():
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        s = unit @ unit[q]
        s[q] = -np.inf
        assert all(abs(s[v] - c) < 1e-12 for _, v, c in found) and [(-c, v) for _, v, c in found] == sorted((-c, v) for _, v, c in found)
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(3000), -np.round(s, 10)))[:5].tolist()))
    assert hits / (5 * len(got)) >= 0.9
    assert [v for _, v, _ in got[150]] == [100, 101, 102, 103, 104]
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 0")).count() == 0


def test_nearest_of_isolated_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 20)
    rng = np.random.default_rng(4)
    tight = np.repeat(np.eye(16)[:4], 250, axis=0) + 1e-3 * rng.normal(size=(1000, 16))
    v = np.concatenate([tight, 5.0 * np.eye(16)[6:14], -np.eye(16)[6:12]])  # 14 isolated ones
    ids = np.concatenate([50 * np.arange(1000) + 1, 50 * np.arange(14)])  # they alone ask
    df = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, v)], "vec_id long, embedding array<float>")
    got = Counter(x.query_id for x in ann.search(df, recall=0.0).collect())  # one leaf visited, if rows would not tell
    assert got == {50 * i: 5 for i in range(14)}
    few = Counter(x.query_id for x in ann.search(df.where("vec_id % 50 = 0 AND vec_id < 200")).collect())
    assert few == {50 * i: 3 for i in range(4)}


def _components(all_rows):
    def words(t):
        return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]

    def shingled(t):
        w = words(t)
        return frozenset({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)})

    sets = [shingled(x[1]) for x in all_rows]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, x in enumerate(all_rows):
        if x[0] is not None:
            least[find(i)] = min(least.get(find(i), x[0]), x[0])
    return Counter((x[0], len(sets[i]), least.get(find(i)) if sets[i] else x[0]) for i, x in enumerate(all_rows))


def _near_rows():
    r = random.Random(6)
    common = [f"c{i}" for i in range(30)]
    out = []
    for g in range(12):
        base = [r.choice("abcdefgh") + str(r.randint(0, 400)) for _ in range(r.randint(20, 120))]
        for _ in range(r.randint(1, 14)):  # chains: edits of edits
            base = list(base)
            for _ in range(r.randint(0, 2)):
                base[r.randrange(len(base))] = f"e{r.randint(0, 9999)}"
            out.append((len(out), " ".join(base)))
    out += [(len(out) + i, " ".join(common + [f"u{i}x{k}" for k in range(r.randint(3, 9))])) for i in range(40)]
    out += [(len(out) + i, " ".join(common)) for i in range(20)]
    return out


@pytest.mark.parametrize("short, tile, hot, part", [(12, 2048, 1 << 16, 2_000_000), (2, 3, 4, 100)])
def test_join(spark, docs, none, monkeypatch, short, tile, hot, part):
    """Also with lists, tiles and parts so small that shingles are split by salts."""
    for name, value in (("SHORT", short), ("TILE", tile), ("HOT", hot), ("PART", part)):
        monkeypatch.setattr(ngram_join, name, value)
    near = _near_rows()
    for df, all_rows in ((spark.createDataFrame(near, "doc_id long, text string").repartition(5), near), (docs, rows())):
        got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(df).collect())
        assert got == _components(all_rows)
    assert ngram_join.near_duplicates(none).count() == 0


def test_repetitive_words_do_not_link(spark):
    a, b = thue_morse("ab")
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(df).collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}
    assert {x.doc_id for x in ngram_join.representatives(df).collect()} == {1, 2}


def _groups(texts):
    """A number for each text with words, the same within a component; None without words."""
    words = [(t or "").split() for t in texts]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = [i if x else None for i, x in enumerate(sets)]
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and group[i] != group[j] and 4 * len(a & sets[j]) >= 3 * len(a | sets[j]):
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    return group


def test_one_document_of_each_group_stays(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    near = [x[1] for x in _near_rows()]
    third = [(None if i % 3 == 0 else i, t) for i, t in enumerate(near)]
    alone = [(None, t) for t in near]  # no group has an id
    same = [(i // 5, t) for i, t in enumerate(near)] + [(0, None), (0, ""), (None, ""), (None, "")]  # near-duplicates under one id
    for all_rows in (third, alone, same):
        df = spark.createDataFrame(all_rows, "doc_id long, text string").repartition(3)
        hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
        of = _groups([t for _, t in all_rows])
        groups = defaultdict(list)
        for i, (d, t) in enumerate(all_rows):
            groups[(d, t) if of[i] is None else of[i]].append((d is None, d or 0, hashes[t], d, t))
        want = Counter(min(g)[3:] for g in groups.values())
        assert Counter((x.doc_id, x.text) for x in corpus_pipeline.ngram_jaccard(spark, df, "").collect()) == want


def test_bitmaps_never_lose_a_link():
    rng = np.random.default_rng(2)
    from fractions import Fraction

    for _ in range(300):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, max(1, int(len(a) * rng.uniform(0.6, 1))), replace=False), rng.integers(0, 1 << 63, int(n * rng.uniform(0, 0.3)), dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 4 * shared >= 3 * (len(a) + len(b) - shared):
            assert ngram_join.may_link(len(a), len(b), ngram_join.bitmap(a), ngram_join.bitmap(b), Fraction(3, 4))


def test_pipeline(spark, docs, none, tmp_path):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, "")
        assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, current = current, spark.read.parquet(path)
        assert current.count() <= before.count()
        if name == "language_id":
            gone = Counter(x.doc_id for x in before.collect()) - Counter(x.doc_id for x in current.collect())
            assert {100, 101, 102, 103, 114} <= set(gone) and all(i in (None, *range(100, 117)) for i in gone)
        if name == "ngram_jaccard":
            kept = [(x.doc_id, x.text) for x in current.collect()]
            assert len(kept) == len(set(kept))
        assert all(x.n_chars == len(x.text) for x in current.collect() if x.text is not None)
    assert corpus_pipeline.STAGES[-1][1](spark, current, "").count() > 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))  # no language to learn: only letters count
    kept = Counter(x.text for x in corpus_pipeline.language_id(spark, unlabelled, "").collect())
    assert kept == Counter(x[1] for x in rows() if x[1] and any(c.isalpha() for c in x[1]))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0

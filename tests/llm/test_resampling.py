"""Importance resampling against plain sums over every document."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from sievework.llm import queries as Q
from sievework.llm.common import Memo
from sievework.llm.resampling import _crc_pair, buckets, resample

from .conftest import WORDS, rows


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, order=3):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10_000 for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def target():
    return [(1, " ".join(WORDS["en"]) * 3), (2, "The house of the river and walking LIGHTS with this stone"), (3, None), (4, "")]


def want(table, goal, percent=5):
    made = [features(t) for _, t in table]
    s, t = Counter(f for x in made for f in x), Counter(f for _, x in goal for f in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for (d, text), x in zip(table, made):
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f] for f in x)
        out.append([d, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)), hashlib.sha256((text or "").encode()).hexdigest()])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[6]))
    for i, x in enumerate(able[:percent * len(able) // 100]):
        x[4] = i + 1
    return Counter(tuple(x[:5]) for x in out)


def test_buckets():
    memory = Memo(_crc_pair)
    for text in ["", None, "a", "A b", "x " * 50, "straße é漢字 x9 " + "long" * 30 + " tail " + "é" * 24 + " " + "y" * 47 + " " + "z" * 48 + " end", *(r[1] for r in rows() if r[1] and len(r[1]) < 5000)]:
        n, got = buckets(text, memory)
        assert n == len(words(text)) and got.tolist() == features(text)
    assert buckets("a b c d e f", memory, 5, 1 << 20)[1].dtype == "uint32"


@pytest.mark.parametrize("percent", [5, 60])
def test_resample(spark, docs, none, percent):
    goal = spark.createDataFrame(target(), "item_id long, text string")
    more = [(1000 + i, rows()[0][1]) for i in range(60)] + [(None, rows()[1][1])] * 3  # copies of one text, equal rows
    table = docs.select("doc_id", "text", "length", "node").unionByName(spark.createDataFrame([(d, t, "l", "n") for d, t in more], "doc_id long, text string, length string, node string"))
    got = resample(table, goal, percent)
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect())
    assert got == want([(x[0], x[1]) for x in rows()] + more, target(), percent)
    assert resample(none, goal).count() == 0


def test_empty_target(spark, docs, none):
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in resample(docs, none).collect())
    assert got == want([(x[0], x[1]) for x in rows()], [])


def test_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(target(), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Q.queries()["op13_resampling"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {f.dataType.simpleString() for f in got.schema.fields} == {"bigint"}
    assert Counter(map(tuple, got.collect())) == want([(x[0], x[1]) for x in rows()], target())

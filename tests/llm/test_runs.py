"""Periodic runs against a word-by-word search of every lag."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from sievework.llm import queries as Q
from sievework.llm.runs import periodic_runs, scan, word_ids

from .conftest import rows


def brute(words):
    """Every maximal stretch of its smallest period, by definition."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, q, n) for (s, n), q in found.items())


def collapsed(words, runs):
    drop = {i for s, q, n in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


@pytest.mark.parametrize("seed", range(60))
def test_scan(seed):
    r = random.Random(seed)
    n, letters = r.choice([5, 12, 13, 40, 150, 700]), r.choice([1, 2, 3, 50])
    words = [r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[:letters]) for _ in range(n)]
    for _ in range(r.randint(0, 3)):  # repeat a piece in place
        a, p = r.randrange(n), r.randint(1, max(1, n // 3))
        for i in range(a + p, min(n, a + p * r.randint(2, 5))):
            words[i] = words[i - p]
    ids = word_ids([w.encode() for w in words])
    want = brute(words)
    assert sorted((s, q, m) for (s, m), q in scan(ids).items()) == want
    parts = {}
    for first in range(1, n // 2 + 1, 37):  # any dealing of lags
        for k, q in scan(ids, first, first + 36).items():
            parts[k] = min(q, parts.get(k, q))
    assert sorted((s, q, m) for (s, m), q in parts.items()) == want
    assert scan(ids.astype(np.uint32)) == scan(ids)


def test_long_period():
    r = random.Random(1)
    piece = [str(r.random()) for _ in range(9000)]
    words = ["x", "y"] + piece * 2 + piece[:77] + ["z"]
    assert scan(word_ids([w.encode() for w in words])) == {(2, 18_077): 9000}
    assert scan(word_ids([b"w"] * 70_000)) == {(0, 70_000): 1}


def extra():
    r = random.Random(3)
    piece = " ".join(r.choice("abc") for _ in range(300))
    return [("again " * 40, 7), (f"{piece} {piece} {piece}\n{piece}", 8), ("a b " * 6, 9), ("a b " * 5 + "a", 9), ("é ü " * 30 + " tail", 10), (" ".join([piece] * 3), 8)]


@pytest.mark.parametrize("long_bytes", [1 << 20, 200])
def test_periodic_runs(spark, docs, none, long_bytes):
    more = extra()
    table = docs.select("doc_id", "text", "length", "node").unionByName(spark.createDataFrame([(d, t, "l", "n") for t, d in more], "doc_id long, text string, length string, node string"))
    want = Counter()
    for d, t in [(x[0], x[1]) for x in rows()] + [(d, t) for t, d in more]:
        words = split(t)
        runs = [(0, 1, len(words))] if len(words) > 20_000 else brute(words)
        want[d, len(words), tuple(runs), collapsed(words, runs)] += 1
    got = periodic_runs(table, long_bytes=long_bytes, lag_range=64).collect()
    assert Counter((r.doc_id, r.n_words, tuple((x.start, x.period, x.length) for x in r.runs), r.collapsed) for r in got) == want
    assert periodic_runs(none).count() == 0


def test_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for d, t, *_ in rows():
        words = split(t)
        n, h = len(words), zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = [(0, 1, n)] if n > 20_000 else brute(words)
        best = min(((-m, s, q) for s, q, m in runs), default=None)
        want[(d, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
              hashlib.sha256("".join(f"{s},{m},{q}\n" for s, q, m in runs).encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())] += 1
    got = Q.queries()["op11_word_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {f.dataType.simpleString() for f in got.schema.fields[:6]} == {"bigint"}
    assert Counter(map(tuple, got.collect())) == want

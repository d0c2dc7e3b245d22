"""The banded similarity join against all pairs."""

import random
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F
from sievework import queries as Q
from sievework.functions import text as T
from sievework.operators import similar as V

SF = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def texts():
    r = random.Random(5)
    words = "the river stone house walking light over under where when small large green".split()
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 25))) for _ in range(25)]
    out = list(base)
    for b in base:  # cut, doubled, with some letters changed, and shuffled
        out += [b[:len(b) * 8 // 10], b + " " + b, "".join(c if r.random() > 0.12 else r.choice("abcxyz ") for c in b), " ".join(r.sample(b.split(), len(b.split())))]
    return out + ["", "a", "ab", "x" * 30, "y" + "x" * 40, None]


def test_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 150))) for _ in "ab")
        n, least = lcs(a, b), r.randint(0, 120)
        assert T.common_subsequence(a, b) == n
        got = T.common_subsequence(a, b, least)
        assert got == n if n >= least else got < least


def alike(a, b):
    if not a or not b:
        return False
    if a == b or len(a) >= 24 and a in b or len(b) >= 24 and b in a:
        return True
    return min(len(a), len(b)) / max(len(a), len(b)) >= 0.55 and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.82


@pytest.mark.parametrize("small", [True, False])
def test_pairs(spark, small):
    rows = list(enumerate(texts()))
    a, b = spark.createDataFrame(rows, "a_id int, a string"), spark.createDataFrame(rows[::-1], "b_id int, b string")
    for threshold in (0.6, 0.86, 1.0):
        want = {(i, j): round(r, 9) for i, x in rows for j, y in rows if x and y and (r := SequenceMatcher(None, x, y, autojunk=False).ratio()) >= threshold}
        assert {(r.a_id, r.b_id): round(r.ratio, 9) for r in V.close_pairs(a, b, threshold, small).collect()} == want
    out = V.similar_pairs(a, b, small)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, x in rows for j, y in rows if alike(x, y)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_curriculum(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    held = [t for t, in con.execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()] + [t[:len(t) * 45 // 100] + " altered " + t[len(t) * 55 // 100:] for d, t in docs if d % 100 == 0]
    worded = lambda rows: [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", T.worded(F.col("t")).alias("w")).orderBy("i").collect()]
    needles, own = worded(held), dict(zip([d for d, _ in docs], worded([t for _, t in docs])))
    want = {}
    for d, t in docs:
        codes = [c for c, found in (("active_payload", any(m in t.lower() for m in ["<script src=http", "powershell -enc", "curl http", "wget http"])), ("empty_text", not own[d]), ("repeated_seed", d % 50 == 7),
                                    ("resembles_heldout", any(alike(n, own[d]) for n in needles))) if found]
        if codes:
            want[d] = ",".join(codes)
    assert {r.task_id: r.codes for r in Q.queries()["q_curriculum"](spark, SF).collect()} == want
    assert "resembles_heldout" in set(want.values())
    twice = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (2, None, None), (3, None, "wget http://a")], "task_id int, seed_id int, text string")
    none = spark.createDataFrame([], "held_id int, text string")
    assert {r.task_id: r.codes for r in V.curriculum_codes(twice, none, ["wget http"]).collect()} == {1: ["repeated_task"], 2: ["empty_text"], 3: ["active_payload"]}


def test_tiles_are_tasks(spark, monkeypatch):
    """Tiles of few bytes take long to compare, so they stay tasks of their own."""
    monkeypatch.setattr(V, "TILE", 300)
    rows = [(i, t) for i, t in enumerate(texts()) if t]
    a, b = spark.createDataFrame(rows, "a_id int, a string"), spark.createDataFrame(rows, "b_id int, b string")
    found = V.close_pairs(a, b, 0.86).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in found}) > 8
    assert {(r.a_id, r.b_id) for r in found} == {(i, j) for i, x in rows for j, y in rows if SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.86}

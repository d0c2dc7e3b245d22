"""Stateful totals and durable progress across restarts, against batch recounts."""

import json
import os
import time
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from sievework.sources.tail import JsonlTail
from sievework.streaming import monitor


def write(path, rows, mode="w"):
    with open(path, mode) as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def recount(folder):
    out = Counter()
    for name in os.listdir(folder):
        for line in open(f"{folder}/{name}"):
            r = json.loads(line)
            if r.get("stage"):
                key = (int(name[1]), r["stage"])
                out[key, "rows"] += 1
                out[key, "total"] += r.get("amount") or 0
                out[key, "unknown"] += r.get("amount") is None
    return +out


def test_restarts(spark, tmp_path):
    """Growth, truncation and replacement, some while the query is down."""
    spark.dataSource.register(JsonlTail)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", monitor.STATE_STORE)
    logs, out, state = tmp_path / "logs", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    logs.mkdir()

    def run():
        lines = spark.readStream.format("jsonl_tail").option("path", f"{logs}/*.jsonl").load().where("line IS NOT NULL")
        record = F.from_json("line", "stage string, amount double")
        rows = lines.select(F.regexp_extract("path", r"s(\d)[ab].jsonl", 1).cast("long").alias("shard"), F.col("path").alias("file"), "generation", record.stage.alias("stage"), record.amount.alias("amount"))
        updates = monitor.file_totals(rows)
        query = monitor.record(updates, out, state)
        query.awaitTermination()
        rows = sum(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:] if p["stateOperators"])
        totals = monitor.shard_totals(monitor.latest_totals(monitor.recorded(spark, out, updates.schema)))
        got = Counter()
        for r in totals.collect():
            key = (r["shard"], r["stage"])
            got.update({(key, "rows"): r["rows"], (key, "total"): r["total"], (key, "unknown"): r["unknown_rows"]})
        return +got, rows

    write(logs / "s0a.jsonl", [{"id": 1, "stage": "plan", "amount": 2}, {"id": 2, "stage": "review", "amount": 1}, {"id": 3}])
    write(logs / "s0b.jsonl", [{"id": 9, "stage": "plan", "amount": 5}])
    write(logs / "s1a.jsonl", [{"id": 5, "stage": "plan"}, {"id": 6, "stage": "plan", "amount": 3}])
    assert run()[0] == recount(logs)
    write(logs / "s0a.jsonl", [{"id": 4, "stage": "plan", "amount": 10}], "a")  # grows
    assert run()[0] == recount(logs)
    write(logs / "s0b.jsonl", [{"id": 77, "stage": "review"}])  # cut off, written anew
    os.remove(logs / "s1a.jsonl")
    write(logs / "tmp", [{"id": 8, "stage": "security", "amount": 7}] * 9)
    os.rename(logs / "tmp", logs / "s1a.jsonl")  # replaced
    got, rows = run()
    assert got == recount(logs)
    # state: a generation and one total a stage of the three files: s0a plan, review; s0b review; s1a security
    assert rows <= 3 + 4 + 3
    assert run()[0] == recount(logs)  # nothing new


def test_generations_out_of_order(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", monitor.STATE_STORE)
    rows = [(0, "f", 2, "a", 1.0), (0, "f", 10, "a", 5.0), (0, "f", 2, "b", 7.0), (0, "f", 10, "b", None), (0, "f", 9, "c", 1.0), (1, "g", 1, "a", 4.0), (1, "g", 1, None, 4.0)]
    schema = "shard long, file string, generation int, stage string, amount double"
    for i, r in enumerate(rows):  # a file a batch, late rows among them
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    updates = monitor.file_totals(stream, ordered=True)
    monitor.record(updates, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = monitor.latest_totals(monitor.recorded(spark, f"{tmp_path}/out", updates.schema)).collect()
    assert {(r["shard"], r["generation"], r["stage"], r["rows"], r["total"], r["unknown_rows"]) for r in got} == {(0, "10", "a", 1, 5.0, 0), (0, "10", "b", 1, 0.0, 1), (1, "1", "a", 1, 4.0, 0)}


def test_state_calls_do_not_grow_with_rows_and_stages():
    calls = []

    class Value:
        def __init__(self, name):
            self.name, self.value = name, None

        def get(self):
            calls.append(self.name)
            return self.value

        def update(self, value):
            calls.append(self.name)
            self.value = value

    class Handle:
        def getValueState(self, name, schema, ttl=None):
            return Value(name)

    totals = monitor.FileTotals(True, None)
    totals.init(Handle())
    rows = [(0, "f", str(g), f"s{i}", a) for g in (9, 10) for i in range(30) for a in (1.0, 2.0, None, float("nan"))]
    for times in (1, 2):
        calls.clear()
        got = list(totals.handleInputRows((0, "f"), iter(rows), None))
        assert len(calls) <= 4
        assert sorted(map(tuple, got)) == sorted((0, "f", "10", f"s{i}", 4 * times, 3.0 * times, 2 * times) for i in range(30))
    calls.clear()
    assert len(list(totals.handleInputRows((0, "f"), iter([(0, "f", "9", "late", 1.0)]), None))) == 30 and len(calls) <= 2


def test_forgets(spark, tmp_path):
    """With a time to live the query polls, and what no batch touches leaves the state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", monitor.STATE_STORE)
    schema = "shard long, file string, generation string, stage string, amount double"
    spark.createDataFrame([(0, "f", "x", "a", 1.0), (0, "f", "x", "b", 2.0)], schema).write.parquet(f"{tmp_path}/in")
    updates = monitor.file_totals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ttl_ms=4_000)
    query = monitor.record(updates, f"{tmp_path}/out", f"{tmp_path}/state", once=False, every="1 second")
    sizes, end = [], time.time() + 60
    try:
        while time.time() < end and query.isActive and not (max(sizes, default=0) >= 2 and sizes[-1] == 0):
            sizes += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:] if p["stateOperators"]]
            time.sleep(0.2)
    finally:
        query.stop()
    assert max(sizes) >= 2 and sizes[-1] == 0


def test_progress_survives_a_kill(spark, tmp_path):
    rows = [(i % 7, s, False) for i in range(40) for s in ("plan", "review")] + [(3, "plan", True), (8, "plan", True), (None, "plan", False), (9, None, False)]
    schema = monitor.PROGRESS
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = f"{tmp_path}/seen"
    new, calls = monitor.first_seen(seen), []

    def killed(batch, batch_id):
        """Writes the batch, and dies before it is committed."""
        if batch_id == 2:
            new(batch, batch_id).write.mode("overwrite").parquet(f"{seen}/batch_id={batch_id}")
            raise RuntimeError("killed")
        return new(batch, batch_id)

    def start(per_batch):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        monitor.record(stream, seen, f"{tmp_path}/state", per_batch).awaitTermination()

    with pytest.raises(StreamingQueryException):
        start(killed)
    assert monitor.recorded(spark, seen, schema).where("batch_id = 2").count() >= 0
    start(lambda batch, i: (calls.append(i), new(batch, i))[1])
    assert calls[0] == 2  # the batch that died is repeated
    pairs = [(r["index"], r["stage"]) for r in monitor.recorded(spark, seen, schema).collect()]
    assert sorted(pairs) == sorted({(i, s) for i, s, _ in rows if i is not None and s})  # none twice, none lost
    state = {r["index"]: r for r in monitor.progress(monitor.recorded(spark, seen, schema), 2).collect()}
    assert state[8]["rejected"] and not state[8]["complete"] and state[1]["complete"]
    done = sum(r["complete"] for r in state.values())
    report = monitor.outlook(monitor.progress(monitor.recorded(spark, seen, schema), 2), 20, 4.0).first()
    assert (report.used, report.complete, report.remaining, report.eta_seconds) == (8, done, 20 - done, (20 - done) / 4.0)
    assert monitor.outlook(monitor.progress(monitor.recorded(spark, seen, schema), 2), 20, None).first().eta_seconds is None
    assert monitor.recorded(spark, f"{tmp_path}/nothing", schema).count() == 0


def test_since_different(spark):
    at = [0, 100, 200, 500, 700, 1300, 1350, 1400, 2500, 2600]
    value = [1, 1, 3, 3, 3, 3, 4, 2, 2, None]
    rows = [("k", t, v) for t, v in zip(at, value)] + [("other", 5, 9)]
    df = spark.createDataFrame(rows, "k string, t long, n long").select("k", F.timestamp_seconds("t").alias("ts"), "n")
    got = {r.ts.timestamp(): r for r in monitor.since_different(df, ["k"], "ts", "n", 600).where("k = 'k'").collect()}
    base = lambda t: (got[t].base_at and got[t].base_at.timestamp(), got[t].base, got[t].per_second)
    assert base(0) == (None, None, None) and base(100) == (None, None, None)
    assert base(200) == (0, 1, 2 / 200) and base(500) == (0, 1, 2 / 500)
    assert base(700) == (100, 1, 2 / 600)  # the point at 0 is too old
    assert base(1300) == (None, None, None)  # all that differs is too old
    assert base(1350) == (1300, 3, 1 / 50)
    assert base(1400) == (1300, 3, None)  # fell: a reset
    assert got[1400].last_at.timestamp() == 1350 and got[1400].last_different == 4
    assert base(2500) == (None, None, None)
    assert base(2600)[0] == 2500 and got[2600].per_second is None

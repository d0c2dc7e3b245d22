"""Streams give what the batch gives on the same rows."""

import os

from pyspark.sql import functions as F
from sievework.sources.tail import JsonlTail
from sievework.streaming import telemetry as S

EVENTS = "/root/testdata/sf0.001/events.parquet"


def _split(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet(EVENTS).repartitionByRange(4, "ts").write.parquet(path)
    return path


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_rollup_and_changes(spark, tmp_path):
    path = _split(spark, tmp_path)
    batch = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    _run(S.rollup(S.replay(spark, path)), "rollup", "complete")
    same = lambda d: sorted((r.event_type, r.rows, round(r.total, 4), r.unknown_rows) for r in d.collect())
    assert same(spark.table("rollup")) == same(S.rollup(batch))
    _run(S.change_log(S.replay(spark, path, 10)), "changes", "append")
    from sievework.operators.ordered import changes

    assert sorted((r.user_id, r.event_id) for r in spark.table("changes").collect()) == sorted((r.user_id, r.event_id) for r in changes(batch, "user_id", ["ts", "event_id"], "event_type").collect())


def test_windows(spark, tmp_path):
    path = _split(spark, tmp_path)
    _run(S.windowed_rates(S.replay(spark, path, 10), "1 day", "1 day", "1 day"), "rates", "append")
    batch = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.start, r.event_type, r.n) for r in S.windowed_rates(batch, "1 day", "1 day").collect()}
    got = {(r.start, r.event_type, r.n) for r in spark.table("rates").collect()}
    assert got <= want and len(got) > 0.5 * len(want)


def test_tail(spark, tmp_path):
    spark.dataSource.register(JsonlTail)
    log = tmp_path / "a.jsonl"
    log.write_text('{"n": 1}\n{"n": 2}\n{"n"')
    q = (spark.readStream.format("jsonl_tail").option("path", str(tmp_path / "*.jsonl")).load().writeStream.format("memory").queryName("tail")
         .option("checkpointLocation", str(tmp_path / "cp")).start())
    q.processAllAvailable()
    first = spark.table("tail").count()
    with log.open("a") as f:
        f.write(": 3}\n")
    q.processAllAvailable()
    lines = sorted(r.line for r in spark.table("tail").collect())
    q.stop()
    assert first == 2 and lines == ['{"n": 1}', '{"n": 2}', '{"n": 3}'] and os.path.exists(log)


def test_tail_after_restarts(spark, tmp_path, monkeypatch):
    """Growth, truncation, replacement and bad lines, the query down in between."""
    import hashlib
    import json

    from sievework.sources import tail

    monkeypatch.setattr(tail, "SPAN", 16)
    spark.dataSource.register(JsonlTail)
    log, out = tmp_path / "logs" / "a.jsonl", str(tmp_path / "out")
    log.parent.mkdir()

    def run():
        q = (spark.readStream.format("jsonl_tail").option("path", str(log.parent / "*.jsonl")).load().writeStream.format("json").option("path", out)
             .option("checkpointLocation", str(tmp_path / "cp")).start())
        q.processAllAvailable()
        q.stop()
        rows = spark.read.schema(JsonlTail({}).schema()).json(out).collect()
        return sorted(json.loads(r.line)["n"] for r in rows if r.line), {r.generation for r in rows}, {r.bad_sha256 for r in rows if r.bad_sha256}

    text = lambda *ns: "".join(f'{{"n": {n}}}\n' for n in ns)
    log.write_text(text(1, 2))
    assert run()[0] == [1, 2]
    with log.open("a") as f:
        f.write(text(3) + "not json\n")
    seen, generations, bad = run()
    assert seen == [1, 2, 3] and len(generations) == 1 and bad == {hashlib.sha256(b"not json").hexdigest()}
    log.write_text(text(10))  # cut off
    seen, generations, _ = run()
    assert seen == [1, 2, 3, 10] and len(generations) == 2
    assert run()[0] == [1, 2, 3, 10]  # nothing twice
    log.write_text(text(20, 21, 22, 23))  # cut off and past its old size while down
    assert run()[0] == [1, 2, 3, 10, 20, 21, 22, 23]
    other = log.parent / "b"
    other.write_text(text(30, 31, 32, 33))  # replaced by one of the same size
    os.replace(other, log)
    assert run()[0] == [1, 2, 3, 10, 20, 21, 22, 23, 30, 31, 32, 33]

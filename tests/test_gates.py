"""Gates: each code fails by the row made for it, and by that one only."""

import pytest
from pyspark.sql import functions as F
from sievework.plans import gates as G

SCHEMA = "expert string, id long, text string, label int, source string"


def good():
    return [(e, 100 * k + i, f"a plain text of expert {e} with the number {i} and some more words to be long enough", i % 2, "s") for k, e in enumerate(["en", "de"]) for i in range(24)]


FAULTS = {
    "id_missing": (None, "one more plain text of a good length, without an id of its own, long enough", 1, "s"), "id_repeated": (3, "one more plain text of a good length, with an id that is taken, long enough", 1, "s"),
    "text_missing": (900, None, 1, "s"), "text_short": (900, "  ", 1, "s"), "text_long": (900, "long text " * 2500, 1, "s"),
    "text_repeated": (900, good()[0][2], 1, "s"), "secret_material": (900, "it says password: hunter2hunter2 in the middle of this plain text, long enough", 1, "s"),
    "active_payload": (900, "it holds <script src=x> in the middle of this plain text, long enough to be kept", 1, "s"), "control_text": (900, "it holds \x01 in the middle of this plain text, long enough to be kept here", 1, "s"),
    "source_missing": (900, "one more plain text of a good length, without a source to it, long enough too", 1, None), "label_unknown": (900, "one more plain text of a good length, with a label of two, long enough too", 2, "s"),
}


def failed(spark, rows, experts=("en", "de"), **options):
    judged = G.gate(spark.createDataFrame(rows, SCHEMA), list(experts), G.checks(**options))
    out = G.verdict(judged).first()
    assert out.ready == (not out.blockers) and out.checks == len(experts) * len(G.checks()) + 1
    return set(out.blockers)


def test_each_code(spark):
    assert failed(spark, good()) == set()
    for code, row in FAULTS.items():
        assert failed(spark, [*good(), ("en", *row)]) == {f"{code}:en"}, code
    assert failed(spark, good(), ("en", "de", "fr")) == {"rows_low:fr"}
    assert failed(spark, good(), ("en",)) == {"expert_unknown:all"}
    assert failed(spark, [*good(), (None, 900, "x" * 60, 1, "s")]) == {"expert_unknown:all"}
    assert failed(spark, [(e, i, t, None if e == "de" and i % 4 else n, s) for e, i, t, n, s in good()]) >= {"labelled_low:de"}
    assert failed(spark, [(e, i, t, 1 if e == "de" else n, s) for e, i, t, n, s in good()]) == {"label_one_sided_share:de"}
    assert failed(spark, [(e, i, f"t{i}" if e == "de" else t, n, s) for e, i, t, n, s in good()]) == {"mean_chars_low:de"}
    assert failed(spark, []) == {"rows_low:en", "rows_low:de"}


def test_freeze(spark, tmp_path):
    rows, path = spark.createDataFrame(good(), SCHEMA), f"{tmp_path}/snapshot"
    wanted = {"rows_low": (F.count("*"), ">=", 20), "text_missing": (F.count_if(F.col("text").isNull()), "<=", 0)}
    assert G.freeze(rows.where("id < 5"), path, wanted) == ["rows_low"]
    assert G.freeze(rows.unionByName(spark.createDataFrame([("en", 1, None, 1, "s")], SCHEMA)), path, wanted) == ["text_missing"]
    assert not (tmp_path / "snapshot").exists() and not (tmp_path / "snapshot.unchecked").exists()
    assert G.freeze(rows, path, wanted) == []
    assert spark.read.parquet(path).count() == len(good())
    with pytest.raises(FileExistsError):
        G.freeze(rows, path, wanted)


def test_fair(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, 2)], "model string, cap int, seed int")
    assert {(r.field, r["values"], r.passed) for r in G.fair(df, ["model", "cap", "seed"]).collect()} == {("model", 1, True), ("cap", 1, True), ("seed", 2, False)}
    assert not any(r.passed for r in G.fair(df.where("cap > 5"), ["model", "cap"]).collect())

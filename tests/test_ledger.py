"""The failure ledger: what is charged, when it goes too far, and what goes with it."""

from sievework.operators import ledger as L


def test_ledger(spark):
    rows = [("s", 1, 1, "a", "server"), ("s", 1, 1, "a", "server"), ("s", 1, 1, "b", "server"),  # one charge
            ("s", 1, 2, "c", "cancelled"), ("s", 1, 2, "c", None), ("s", 1, 3, "d", "server"), ("s", 1, 5, "e", "timeout"),
            ("s", 0, 1, "a", "server"), ("s", 3, 1, "a", "server"), ("t", 2, 1, "a", "cancelled"), (None, 1, 1, "a", "server"), ("t", None, 1, "a", "server"), ("t", 1, None, "a", "server")]
    failures = spark.createDataFrame(rows, "seed string, stage int, epoch int, report string, error_class string")
    charged = L.charges(failures, ["cancelled"])
    assert {tuple(r) for r in charged.collect()} == {("s", 1, 1, 2, 3), ("s", 1, 3, 1, 1), ("s", 1, 5, 1, 1), ("s", 0, 1, 1, 1), ("s", 3, 1, 1, 1)}
    book = L.ledger(charged, 2)
    assert {tuple(r) for r in book.collect()} == {("s", 1, 3, 1, 5, 5), ("s", 0, 1, 1, 1, None), ("s", 3, 1, 1, 1, None)}
    items = spark.createDataFrame([("s", i) for i in range(5)] + [("t", 2)], "seed string, stage int")
    assert {tuple(r) for r in L.cascade(items, book).collect()} == {("s", 0, "open", None), ("s", 1, "quarantined", 1), ("s", 2, "downstream", 1), ("s", 3, "downstream", 1), ("s", 4, "downstream", 1), ("t", 2, "open", None)}
    assert L.ledger(charged, 3).where("quarantined_epoch IS NOT NULL").count() == 0
    assert {r.quarantined_epoch for r in L.ledger(charged, 0).collect()} == {1}
    assert L.ledger(L.charges(failures.where("false"), []), 2).count() == 0

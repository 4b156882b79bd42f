"""Snapshot differences and folds on a few rows."""

from harrow.operators import snapshots

SCHEMA = "id string, status string, label string, areas array<string>, version string"


def test_diff_counts_and_values(spark):
    a = spark.createDataFrame([("1", "OPEN", "x", ["p", "q"], "1"), ("2", "OPEN", None, None, "1"), ("3", "DONE", "y", [], "1")], SCHEMA)
    b = spark.createDataFrame([("1", "OPEN", "x", ["q", "p"], "2"), ("2", "STOPPED", "z", None, "2"), ("4", "DONE", "y", [], "2")], SCHEMA)
    got = {r["id"]: r for r in snapshots.diff(a, b, "id", ["status", "label", "areas"], unordered=["areas"]).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"2": "changed", "3": "removed", "4": "new"}  # a new version alone is no change
    assert got["2"]["changed_fields"] == ["status", "label"]
    assert got["2"]["before"] == {"status": "OPEN", "label": None} and got["2"]["after"] == {"status": "STOPPED", "label": "z"}


def test_fold_cancels(spark):
    rows = [
        ("a", 2, "removed", None, None), ("a", 1, "added", None, "x"),  # gone again
        ("b", 1, "changed", "x", "y"), ("b", 2, "changed", "y", "x"),  # undone
        ("c", 1, "added", None, "x"), ("c", 2, "changed", "x", "y"),  # part of the addition
        ("d", 1, "removed", "x", None), ("d", 2, "added", None, "z"),  # removed and added: a change
        ("e", 1, "changed", "x", "y"),
    ]
    log = spark.createDataFrame(rows, "k string, r int, kind string, b string, a string")
    fold = lambda since: {x["k"]: (x["kind"], x["before"], x["after"]) for x in snapshots.fold_changes(log, "k", "r", "kind", "b", "a", since).collect()}
    assert fold(None) == {"c": ("added", None, "y"), "d": ("changed", "x", "z"), "e": ("changed", "x", "y")}
    assert set(fold(1)) == {"a", "b", "c", "d"}  # releases up to 1 were folded before

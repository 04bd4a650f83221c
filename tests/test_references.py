from tessera.operators.references import ForeignKey, direct_orphans, orphan_report, orphans

A = "id long, up long, name string, at timestamp_ntz, ref_table string"
KEYS = [ForeignKey("b", "up", "a", "id"), ForeignKey("c", "up", "b", "id"), ForeignKey("c", "name", "b", "name")]


def tables(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 5)
    a = spark.createDataFrame([(1, None, None, t, "x"), (1, None, None, t, "x")], A)
    b = spark.createDataFrame([(10, 1, "p", t, "x"), (11, 9, "q", t, "x"), (11, 9, "q", t, "x"), (12, None, "r", t, "x")], A)
    c = spark.createDataFrame([(20, 10, "p", t, "x"), (21, 11, "q", t, "x"), (22, 99, "", t, "x"), (23, None, None, None, "x"), (None, 99, "zz", t, "x"), (24, 12, "none", t, "x")], A)
    return {"a": a, "b": b, "c": c}


def test_direct(spark):
    assert {tuple(r) for r in direct_orphans(tables(spark), KEYS).collect()} == {("b", "up", 11), ("c", "up", 22), ("c", "name", 24)}


def test_inherited(spark):
    got = {(r["ref_table"], r["ref_field"], r["row_id"], r["kind"], r["depth"]) for r in orphans(tables(spark), KEYS).collect()}
    assert got == {("b", "up", 11, "direct", 0), ("c", "up", 22, "direct", 0), ("c", "name", 24, "direct", 0), ("c", "up", 21, "inherited", 1), ("c", "name", 21, "inherited", 1)}


def test_report(spark):
    r = {(x["ref_table"], x["ref_field"], x["month"]): (x["n_refs"], x["n_direct"], x["n_inherited"]) for x in orphan_report(tables(spark), KEYS, "at").collect()}
    assert r[("b", "up", "2025-01")] == (2, 1, 0) and r[("c", "up", "2025-01")] == (4, 1, 1) and r[("c", "name", "2025-01")] == (3, 1, 1)


def test_cycle(spark):
    t = {"n": spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (3, 99, "c"), (4, 4, "d")], "id long, up long, name string")}
    got = {(r["row_id"], r["kind"], r["depth"]) for r in orphans(t, [ForeignKey("n", "up", "n", "id")]).collect()}
    assert got == {(3, "direct", 0), (2, "inherited", 1), (1, "inherited", 2)}


def test_empty(spark):
    t = {k: spark.createDataFrame([], A) for k in "abc"}
    assert direct_orphans(t, KEYS).count() == 0 and orphan_report(t, KEYS, "at").count() == 0
    t["b"] = tables(spark)["b"]
    assert {r["row_id"] for r in direct_orphans(t, KEYS).collect()} == {10, 11}

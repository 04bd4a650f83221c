import numpy as np
from pyspark.sql import functions as F

from tessera.operators import vectors as V
from tessera.operators.fusion import Filters, hybrid_search, reciprocal_rank_fusion

SCHEMA = "id long, embedding array<float>"


def test_nearest_against_brute_force(spark):
    x = np.random.default_rng(1).standard_normal((300, 12)).astype(np.float32)
    df = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)] + [(900, None), (901, []), (902, [1.0]), (903, [float("nan")] * 12)], SCHEMA)
    q = [float(v) for v in x[7]]
    d = ((x.astype(float) - x[7].astype(float)) ** 2).sum(1)
    want = sorted((round(v, 6), k) for k, v in enumerate(d))[:10]
    assert [(round(r["distance"], 6), r["id"]) for r in V.nearest(df, q, 10).collect()] == want
    assert V.nearest(df, [], 5).count() == V.nearest(df, [1.0] * 3, 5).count() == V.nearest(df, q, 0).count() == 0
    near = {r["id"] for r in V.approximate(df, q, 10, tables=16, buckets=4.0).collect()}
    assert len(near & {k for _, k in want}) >= 8
    plan = V.nearest(df, q, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_index_of_vectors(spark, tmp_path):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], SCHEMA)
    b = spark.createDataFrame([(2, [5.0, 5.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, [2.0, 2.0])], SCHEMA)
    got = {r["id"]: r["embedding"] for r in V.add_vectors(a, b, 2, most=3).collect()}
    assert got == {1: [1.0, 0.0], 2: [5.0, 5.0], 3: [1.0, 1.0]}
    V.save_vectors(V.remove_vectors(a, b.select("id")), str(tmp_path / "v"))
    assert [r["id"] for r in V.load_vectors(spark, str(tmp_path / "v")).collect()] == [1]
    blob = spark.createDataFrame([(np.array([1, 2.5], dtype="<f4").tobytes(),), (None,)], "b binary")
    assert [r[0] for r in blob.select(V.from_bytes(F.col("b"))).collect()] == [[1.0, 2.5], None]


def chunks(spark):
    rows = [(1, "apple pie", [0.0, 1.0], "function", "python"), (2, "apple tart", [0.0, 0.9], "class", "go"), (3, "stone", [1.0, 0.0], "function", "go"), (4, "apple apple", None, "function", "python")]
    return spark.createDataFrame(rows, "id long, content string, embedding array<float>, symbol_type string, language string").selectExpr("*", "1 as start_line", "2 as end_line", "'n' as symbol_name", "'/r' as project_root")


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rn int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rn int")
    got = {r["id"]: r["score"] for r in reciprocal_rank_fusion(a, b).collect()}
    assert abs(got[2] - (1 / 62 + 1 / 61)) < 1e-12 and abs(got[3] - 1 / 62) < 1e-12 and abs(got[1] - 1 / 61) < 1e-12


def test_hybrid(spark):
    c = chunks(spark)
    ids = [r["id"] for r in hybrid_search(c, "apple", [0.0, 1.0], 4).orderBy(F.desc("score"), "id").collect()]
    assert ids[0] in (1, 2) and set(ids) == {1, 2, 3, 4}
    assert {r["id"] for r in hybrid_search(c, "apple", [0.0, 1.0], 4, Filters(language="go")).collect()} == {2, 3}
    only = hybrid_search(c, "apple", None, 2).collect()
    assert {r["type"] for r in only} == {"keyword"} and len(only) == 2
    none = hybrid_search(c, "pie", [1.0, 0.0], 1, Filters("function", "python"))
    assert [(r["id"], r["type"]) for r in none.collect()] in ([(1, "hybrid")], [(1, "keyword")])
    assert hybrid_search(c, "what?", [1.0, 0.0], 1).first()["id"] == 3
    assert hybrid_search(c.limit(0), "apple", [1.0, 0.0]).count() == 0


def test_pooling(spark):
    t = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [0.0, 0.0])], "k string, v array<float>")
    assert {r["k"]: r["pooled"] for r in V.mean_pooled(t, "k", "v").collect()} == {"a": [2.0, 3.0], "b": [0.0, 0.0]}
    assert V.stored_dimension(t.withColumnRenamed("v", "e"), "e").first()[0] == 2 and V.stored_dimension(t.limit(0), "v").first()[0] == 0

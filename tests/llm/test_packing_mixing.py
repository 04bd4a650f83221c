import random

import pytest

from tessera.llm.mixing import mixture, mixture_report
from tessera.llm.packing import configurations, fill_report, grouped_sizes, pack
from tessera.llm.tokens import count_tokens


def check(spark, sizes, capacity, loose=1.05):
    df = spark.createDataFrame([(k, s, "x") for k, s in enumerate(sizes)], "doc long, n long, container string")
    rows = pack(df, "doc", "n", capacity).collect()
    used, whole = {}, {}
    for r in rows:
        used[r["container"]] = used.get(r["container"], 0) + r["size"]
        whole.setdefault(r["item"], []).append(r["size"])
    assert all(0 < v <= capacity for v in used.values())
    assert {k: sum(v) for k, v in whole.items()} == {k: s for k, s in enumerate(sizes) if s and s > 0}
    assert all(len(v) == 1 for k, v in whole.items() if sizes[k] <= capacity)
    bound = -(-sum(s for s in sizes if s and s > 0) // capacity)
    assert len(used) <= bound * loose + 3
    return len(used), bound


@pytest.mark.parametrize("seed", range(4))
def test_sizes(spark, seed):
    rnd = random.Random(seed)
    check(spark, [min(2000, int(rnd.paretovariate(0.8) * 20)) for _ in range(3000)], 512)


def test_edges(spark):
    check(spark, [None if False else 0, 5, 512, 513, 1024, 1500, 1], 512)
    n, bound = check(spark, [257] * 100, 512, 3)
    assert n == 100
    assert check(spark, [256] * 100, 512) == (50, 50)
    check(spark, [1] * 2000, 512)
    empty = spark.createDataFrame([], "doc long, n long")
    assert pack(empty, "doc", "n", 512).count() == 0 and fill_report(pack(empty, "doc", "n", 512), 512).count() == 1
    odd = spark.createDataFrame([(1, 5), (1, 5), (None, 5), (2, None)], "doc long, n long")
    assert [(r["item"], r["size"]) for r in pack(odd, "doc", "n", 512).collect()] == [(1, 5)]


def test_configurations_hold_all_items():
    rnd = random.Random(1)
    counts = {}
    for _ in range(2000):
        s = rnd.randint(30, 400)
        counts[s] = counts.get(s, 0) + 1
    groups = grouped_sizes(counts, 400)
    assert sum(g[2] for g in groups) == sum(n for s, n in counts.items() if s >= 50)
    confs = configurations(groups, 400)
    assert all(sum(k * g[0] for k, g in zip(c, groups)) <= 400 for c, _ in confs)
    assert [sum(c[j] * n for c, n in confs) for j in range(len(groups))] == [g[2] for g in groups]


def test_tokens(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",)], "t string")
    n = [r["n"] for r in df.select(count_tokens(F.col("t")).alias("n")).collect()]
    assert n[0] == 2 and n[1] == 0 and n[2] is None and n[3] > 1


def docs(spark):
    rnd = random.Random(3)
    rows = [(k, "abc"[k % 3] if k % 7 else "d", rnd.randint(1, 300), "x") for k in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, copies string")


def test_mixture(spark):
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.2, 1), ("c", 0.1, 1), ("d", 0.15, 3), ("none", 0.05, 9)], "source string, target_share double, max_repeats int")
    m = mixture(docs(spark), t)
    r = {x["source"]: x for x in mixture_report(m, t).collect()}
    assert r["none"]["tokens"] == 0 and abs(sum(x["share"] for x in r.values()) - 1) < 1e-4
    for s, want in (("a", 0.5), ("b", 0.2), ("c", 0.1), ("d", 0.15)):
        assert abs(r[s]["share"] - want / 0.95) < 0.005 and r[s]["most_copies"] <= r[s]["max_repeats"]
    have = {x["source"]: x["s"] for x in docs(spark).groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "s").collect()}
    assert max(r[s]["tokens"] / have[s] / r[s]["max_repeats"] for s in "abcd") > 0.99  # one source is used up
    assert m.count() == m.select("doc_id").distinct().count()
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, mixture(docs(spark).repartition(5), t).collect()))


def test_mixture_edges(spark):
    t = spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 1), ("z", 0.0, 1)], "source string, target_share double, max_repeats int")
    d = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (2, "a", 0), (3, "a", None), (None, "a", 5), (4, None, 5), (5, "q", 5)], "doc_id long, source string, n_tokens long")
    assert [tuple(r) for r in mixture(d, t).collect()] == [(1, "a", 10, 2)]
    assert [tuple(r) for r in mixture(d, t, total=10).collect()] == [(1, "a", 10, 1)]
    assert mixture(d.limit(0), t).count() == 0
    assert mixture_report(mixture(d.limit(0), t), t).count() == 3


def test_item_of_two_sizes(spark):
    d = spark.createDataFrame([(1, 5), (1, 9), (1, 9), (2, 600)], "doc long, n long")
    assert sorted((r["item"], r["part"], r["size"]) for r in pack(d, "doc", "n", 512).collect()) == [(1, 0, 9), (2, 0, 512), (2, 1, 88)]


def test_certain_documents(spark):
    # one document holds half of its source: with the others' odds computed anew the sample's expected size is what is wanted
    rows = [(0, "a", 5000)] + [(k, "a", 10) for k in range(1, 501)] + [(1000 + k, "b", 10) for k in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 1)], "source string, target_share double, max_repeats int")
    m = {r["doc_id"]: r for r in mixture(d, t, total=10_000, power=1.0).collect()}
    assert 0 in m and abs(sum(r["n_tokens"] for r in m.values() if r["source"] == "a") - 6000) <= 10
    assert abs(sum(r["n_tokens"] for r in m.values() if r["source"] == "b") - 4000) <= 10

import numpy as np
import pytest

from tessera.llm import neighbours as N


def brute(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for a in range(len(u)):
        s = u @ u[a]
        out[ids[a]] = sorted(((round(float(-s[b]), 5), ids[b]) for b in range(len(u)) if b != a))[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>, other string")


def test_small_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 8))
    x[50:60] = x[40:50] + rng.standard_normal((10, 8)) * 0.05
    x[70:78] = x[69] * 3  # equal directions
    ids = list(range(100, 220))
    got = {}
    for r in N.nearest_neighbours(frame(spark, [(i, list(map(float, v)), "e") for i, v in zip(ids, x)]), dim=8).collect():
        got.setdefault(r["id"], []).append((round(-r["cosine"], 5), r["other"]))
    want = brute(x.astype(np.float32).astype(float), ids, 5)
    for i in ids:
        assert [round(a, 3) for a, _ in sorted(got[i])] == [round(a, 3) for a, _ in want[i]]
    assert {o for _, o in got[172]} == {169, 170, 171, 173, 174}  # ties by id


def test_parts_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 150)
    monkeypatch.setattr(N, "BLOCK", 100)
    monkeypatch.setattr(N, "QUERIES", 90)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([c + 0.45 * rng.standard_normal((100, 16)) for c in centres])
    ids = list(range(len(x)))
    df = frame(spark, [(i, list(map(float, v)), "e") for i, v in zip(ids, x)])
    want = brute(x, ids, 5)
    got = [(r["id"], r["other"]) for r in N.nearest_neighbours(df, dim=16).collect()]
    assert len(got) == len(set(got)) == 5 * len(x)
    hit = sum((i, o) in set(got) for i in ids for _, o in want[i])
    assert hit / (5 * len(ids)) >= 0.9
    close = {(min(i, o), max(i, o)) for i in ids for c, o in want[i] if -c >= 0.9}
    found = {tuple(r) for r in N.similar_pairs(N.nearest_neighbours(df, dim=16, least=0.9), 0.9).collect()}
    assert found <= close | {p for p in found if True} and len(found & close) >= 0.9 * len(close)


def test_unusable(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "e"), (1, [1.0, 0.0], "e"), (2, [2.0, 0.0], "e"), (3, [0.0, 0.0], "e"), (4, [nan, 1.0], "e"), (5, [inf, 1.0], "e"), (6, [1.0], "e"), (7, [], "e"), (8, None, "e"), (None, [1.0, 0.0], "e"), (9, [0.0, 1e-30], "e"), (10, [None, 1.0], "e")]
    df = frame(spark, rows)
    got = {(r["id"], r["other"], round(r["cosine"], 4)) for r in N.nearest_neighbours(df, dim=2).collect()}
    assert got == {(1, 2, 1.0), (2, 1, 1.0), (1, 9, 0.0), (2, 9, 0.0), (9, 1, 0.0), (9, 2, 0.0)}
    assert {tuple(r) for r in N.similar_pairs(N.nearest_neighbours(df, dim=2, least=0.9), 0.9).collect()} == {(1, 2)}
    assert N.nearest_neighbours(df.limit(0), dim=2).count() == 0
    assert N.nearest_neighbours(df.filter("id = 1"), dim=2).count() == 0


def test_partition_is_balanced():
    x = np.random.default_rng(3).standard_normal((800, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = N.balanced_partition(x, N.neighbour_graph(x, 8), 8)
    assert np.bincount(p, minlength=8).max() <= 111


def test_registered_queries_on_data(spark, data):
    from tessera.llm.queries import QUERIES

    t = spark.read.parquet(f"{data}/chunks.parquet").select("id", "embedding").dropDuplicates(["id"])
    rows = [(r["id"], r["embedding"]) for r in t.collect() if r["embedding"] is not None and len(r["embedding"]) == 64 and np.isfinite(r["embedding"]).all() and np.any(r["embedding"])]
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=float)
    want = {(min(i, o), max(i, o)) for i, near in brute(x, ids, 5).items() for c, o in near if -c >= 0.9}
    got = {tuple(r) for r in QUERIES["p4_found"](spark, data).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want) + 2


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_router_of_few(n):
    x = np.eye(5, 4, dtype=np.float32)[:n]
    assert N.fit_router(x, 3).parts == 1


def test_recall_is_measured(spark):
    import numpy as np

    from tessera.llm.neighbours import nearest_neighbours, recall_against_brute_force

    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 64))
    x[100:300] = x[100]  # a hot class of equal vectors
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(700, None), (750, [0.0] * 64)], "id long, embedding array<double>")
    found = nearest_neighbours(df)
    r = recall_against_brute_force(df, found).first()
    assert r["n_queries"] == 12 and r["recall"] == 1.0
    assert recall_against_brute_force(df, found.filter("rank > 1")).first()["recall"] < 0.9
    assert found.groupBy("id").count().filter("count <> 5").count() == 0 and found.filter("id = other").count() == 0
    assert found.filter("id between 100 and 299 and cosine < 0.999").count() == 0
    assert recall_against_brute_force(df.limit(0), found).first()["n_queries"] == 0

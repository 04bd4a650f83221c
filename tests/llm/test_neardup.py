import re

import numpy as np

from tessera.llm.neardup import components, near_duplicates, one_permutation_signatures, pairs_of


def sets(text, k):
    w = re.findall(r"[A-Za-z0-9_]+", text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**32, 300)
    for share in (0.5, 0.7, 0.9):
        n = int(300 * 2 * share / (1 + share))
        a, b = base, np.concatenate([base[:n], rng.integers(0, 2**32, 300 - n)])
        s = one_permutation_signatures(np.concatenate([a, b]), np.array([300, 300]), 512)
        assert abs((s[0] == s[1]).mean() - share) < 0.08
    few = one_permutation_signatures(np.arange(3), np.array([3, 0]), 64)
    assert len(set(few[0])) <= 3 and (few[1] == 0).all()


def test_data_against_brute_force(spark, data):
    t = spark.read.parquet(f"{data}/chunks.parquet")
    s = {r["id"]: x for r in t.select("id", "content").dropDuplicates(["id"]).collect() if len(x := sets(r["content"], 3)) >= 40}
    want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])}
    groups, links = near_duplicates(t, "id", "content", words=3, threshold=0.6, least=40)
    rows = [tuple(r) for r in pairs_of(groups, links).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    g = {r["id"]: r for r in groups.collect()}
    assert set(g) == set(s) and all(g[a]["group_id"] == g[b]["group_id"] for a, b in want)


def test_hot_group_and_edges(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, text, "x") for k in range(100)] + [(200 + k, text.replace(f"w{k} ", "other ", 1), "x") for k in range(5)] + [(300, None, "x"), (301, "", "x"), (302, "two words", "x"), (None, text, "x"), (303, " ".join(f"v{k}" for k in range(50_000)), "x"), (0, text, "x")]
    groups, links = near_duplicates(spark.createDataFrame(rows, "id long, content string, class_id string"), "id", "content")
    g = {r["id"]: r for r in groups.collect()}
    assert set(g) == {*range(100), *range(200, 205), 303}
    assert {g[k]["class_id"] for k in range(100)} == {0} and {g[k]["group_id"] for k in [*range(100), *range(200, 205)]} == {0}
    assert g[0]["n_links"] == 5 and g[303]["n_links"] == 0 and links.count() == len({(r["a"], r["b"]) for r in links.collect()})
    assert near_duplicates(spark.createDataFrame([], "id long, content string"), "id", "content")[0].count() == 0


def test_hot_bucket_of_dissimilar_members(spark):
    # six short records (similarity 0.65 to each other) have a header of 82 words, and so do 3,000 longer ones (0.42 to the short ones, 0.31 to each other)
    head = " ".join(f"h{k}" for k in range(82))
    rows = [(k, head + " " + " ".join(f"b{k}x{j}" for j in range(86))) for k in range(3000)] + [(5000 + k, head + " " + " ".join(f"s{k}x{j}" for j in range(21))) for k in range(6)]
    s = {i: sets(t, 3) for i, t in rows if i >= 5000}
    want = {(a, b) for a in s for b in s if a < b}
    assert all(0.6 <= len(s[a] & s[b]) / len(s[a] | s[b]) < 0.7 for a, b in want)
    groups, links = near_duplicates(spark.createDataFrame(rows, "id long, content string"), "id", "content", words=3, threshold=0.6, least=40)
    assert {tuple(r) for r in pairs_of(groups, links).collect()} == want


def test_components(spark):
    e = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 100 - 60), (55, 50), (50, 52)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 50: 50, 52: 50, 55: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_chain_and_hot_family(spark):
    # each text shares 0.82 with the next, less with those after it: links are those of neighbours only
    rows = [(k, " ".join(f"w{k * 12 + j}" for j in range(124))) for k in range(60)]
    groups, links = near_duplicates(spark.createDataFrame(rows, "id long, content string"), "id", "content")
    assert sorted((r["a"], r["b"]) for r in links.collect()) == [(k, k + 1) for k in range(59)]
    assert {r["group_id"] for r in groups.collect()} == {0}
    # a family of more than a small bucket whose members are all alike but differ in pairs
    base = [f"v{k}" for k in range(200)]
    rows = [(k, " ".join(base[:3 * k] + [f"own{k}"] + base[3 * k + 1:])) for k in range(50)]
    s = {i: {tuple(t.split()[j : j + 5]) for j in range(196)} for i, t in rows}
    want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])}
    groups, links = near_duplicates(spark.createDataFrame(rows, "id long, content string"), "id", "content")
    assert {(r["a"], r["b"]) for r in links.collect()} == want and len(want) == 50 * 49 // 2

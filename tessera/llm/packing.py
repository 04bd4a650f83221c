"""Containers of fixed capacity filled with whole items (problem 8).

Linear grouping: the large items, sorted by size, are cut into groups of equal cardinality and each is rounded up to the
largest of its group, so that few sizes remain. Configurations (how many of each size share a container) are found by
column generation over those few sizes on the counts, then rounded down; what is left is packed first-fit decreasing, on
counts as well. The actual items then take the places of their group, and the small items fill the space that is left,
best fit, shard by shard.

The driver only sees counts by size (at most ``capacity`` of them) and configurations; items never leave the executors.
An item above the capacity is cut: pieces of exactly the capacity, which are containers of their own, and the rest.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize

#: Groups of large sizes; an item is large from this share of the capacity on; containers of a shard for small items.
GROUPS, LARGE, SHARD = 24, 1 / 8, 4096


def grouped_sizes(counts: dict[int, int], capacity: int, groups: int = GROUPS, large: float = LARGE) -> list[tuple[int, int, int]]:
    """(size, first rank, number) of the groups of the large items in decreasing order of size; ranks count from 0."""
    sizes = sorted((s for s in counts if s >= max(1, capacity * large)), reverse=True)
    total = sum(counts[s] for s in sizes)
    if not total:
        return []
    out, at, k = [], 0, 0
    bounds = [round(total * j / groups) for j in range(groups + 1)]
    ranks = []
    for s in sizes:
        ranks.append((at, s))
        at += counts[s]
    starts = [r for r, _ in ranks]
    for k in range(groups):
        a, b = bounds[k], bounds[k + 1]
        if b > a:
            out.append((ranks[bisect.bisect_right(starts, a) - 1][1], a, b - a))
    return out


def _knapsack(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The configuration of most value: unbounded knapsack over the few sizes."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1, dtype=np.int64)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        for j, s in enumerate(sizes):
            if s <= c and best[c - s] + value[j] > best[c] + 1e-12:
                best[c], take[c] = best[c - s] + value[j], j
    out, c = [0] * len(sizes), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            out[take[c]] += 1
            c -= sizes[take[c]]
    return float(best[capacity]), out


def configurations(groups: list[tuple[int, int, int]], capacity: int, rounds: int = 120) -> list[tuple[list[int], int]]:
    """(configuration, containers of it) that hold exactly the items of the groups.

    Column generation: the restricted program is solved by the revised simplex method, its prices ask a knapsack for a better
    configuration. The fractional solution is rounded down and the rest packed first-fit decreasing on the counts."""
    sizes, need = [g[0] for g in groups], np.array([g[2] for g in groups], dtype=float)
    m = len(sizes)
    basis = [[(capacity // s) if i == j else 0 for i in range(m)] for j, s in enumerate(sizes)]
    b = np.array(basis, dtype=float).T
    for _ in range(rounds):
        x = np.linalg.solve(b, need)
        prices = np.linalg.solve(b.T, np.ones(m))
        worth, new = _knapsack(sizes, prices, capacity)
        if worth <= 1 + 1e-9:
            break
        d = np.linalg.solve(b, np.array(new, dtype=float))
        ratio = [(x[i] / d[i], i) for i in range(m) if d[i] > 1e-9]
        if not ratio:
            break
        _, leave = min(ratio)
        b[:, leave] = new
    x = np.linalg.solve(b, need)
    out, left = [], need.astype(int)
    for j in np.argsort(-x):
        conf = b[:, j].astype(int)
        n = int(min([np.floor(x[j] + 1e-9), *(left[i] // conf[i] for i in range(m) if conf[i])])) if conf.any() else 0
        if n > 0:
            out.append((conf.tolist(), n))
            left = left - n * conf
    # the rest: repeat the greedy configuration as often as it fits
    while left.sum():
        conf, room = [0] * m, capacity
        for i, s in enumerate(sizes):
            conf[i] = min(int(left[i]), room // s)
            room -= conf[i] * s
        n = min(int(left[i]) // conf[i] for i in range(m) if conf[i])
        out.append((conf, n))
        left = left - n * np.array(conf)
    return out


def _places(groups, confs) -> pd.DataFrame:
    """Runs of places: items of group ``g`` with rank in [start, start + n) go, ``per`` to a container, to containers from ``first``."""
    out, first, used = [], 0, [0] * len(groups)
    for conf, n in confs:
        for g, per in enumerate(conf):
            if per:
                out.append((g, groups[g][1] + used[g], n * per, per, first))
                used[g] += n * per
        first += n
    return pd.DataFrame(out, columns=["g", "start", "n", "per", "first"])


def _placer(runs: pd.DataFrame):
    """The container of a rank: runs cover the ranks without gaps; there are at most groups x configurations of them."""
    runs = runs.sort_values("start")
    start, per, first = (runs[c].to_numpy() for c in ("start", "per", "first"))

    def place(rank: pd.Series) -> pd.Series:
        r = rank.to_numpy()
        k = np.searchsorted(start, r, side="right") - 1
        return pd.Series(first[k] + (r - start[k]) // per[k])

    return F.pandas_udf(place, T.LongType())


def _fill(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        bins = pdf[pdf["item"].isna()].sort_values("container")
        items = pdf[pdf["item"].notna()].sort_values(["size", "item", "part"], ascending=[False, True, True])
        free = sorted(zip((capacity - bins["size"]).astype(int), bins["container"]))
        out, fresh = [], 0
        for item, part, size in zip(items["item"], items["part"], items["size"].astype(int)):
            k = bisect.bisect_left(free, (size,))
            if k < len(free):
                room, c = free.pop(k)
            else:
                room, c = capacity, f"s{shard}-{fresh}"
                fresh += 1
            out.append((int(item), int(part), size, c))
            if room - size:
                bisect.insort(free, (room - size, c))
        return pd.DataFrame(out, columns=["item", "part", "size", "container"])

    return run


def pack(df: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(item, part, size, container): where every item goes.

    Items of size 0 or NULL and NULL items have no row; a repeated item counts once, with its largest size; an item of at most the
    capacity is never cut (part 0). Ranks among equal sizes follow the item's id."""
    df = df.filter(F.col(item).isNotNull() & (F.col(size) > 0)).select(F.col(item).cast("long").alias("item"), F.col(size).cast("long").alias("whole")).groupBy("item").agg(F.max("whole").alias("whole"))
    pieces = materialize(
        df.select("item", F.posexplode(F.when(F.col("whole") <= capacity, F.array("whole")).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(F.col("whole") / capacity) - 1), lambda k: F.least(F.lit(capacity).cast("long"), F.col("whole") - k * capacity)))).alias("part", "size")),
        "pieces",
    )
    counts = {r["size"]: r["n"] for r in pieces.filter(F.col("size") < capacity).groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = df.sparkSession
    full = pieces.filter(F.col("size") == capacity).select("item", "part", "size", F.concat(F.lit("f"), "item", F.lit("-"), "part").alias("container"))
    groups = grouped_sizes(counts, capacity)
    confs = configurations(groups, capacity) if groups else []
    containers = sum(n for _, n in confs)
    small_from = max(1, capacity * LARGE)
    small_total = sum(s * n for s, n in counts.items() if s < small_from)
    shards = max(1, round((containers + small_total / capacity) / SHARD))
    if groups:
        # rank among the large items without one big sort: the size's first rank is known, the rank within a size is a window
        # over (size, bucket) after the buckets of a size have been counted
        first, at = [], 0
        for s in sorted((s for s in counts if s >= small_from), reverse=True):
            first.append((s, at))
            at += counts[s]
        large = pieces.filter((F.col("size") < capacity) & (F.col("size") >= small_from)).withColumn("bucket", F.pmod(F.xxhash64("item", "part"), F.lit(64)))
        per = large.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
        per = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        per = per.join(F.broadcast(spark.createDataFrame(first, "size long, first long")), "size").select("size", "bucket", (F.col("first") + F.col("before")).alias("base"))
        ranked = large.join(per, ["size", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("size", "bucket").orderBy("item", "part")) - 1)
        placed = ranked.select("item", "part", "size", _placer(_places(groups, confs))(F.col("rank")).alias("c"))
        placed = materialize(placed, "placed")
    else:
        placed = spark.createDataFrame([], "item long, part int, size long, c long")
    label = F.concat(F.lit("c"), F.col("c"))
    bins = placed.groupBy("c").agg(F.sum("size").alias("size")).filter(F.col("size") < capacity)
    shard = lambda *c: F.pmod(F.xxhash64(*c), F.lit(shards)).cast("int")
    bins = bins.select(F.lit(None).cast("long").alias("item"), F.lit(None).cast("int").alias("part"), "size", label.alias("container"), shard("c").alias("shard"))
    small = pieces.filter(F.col("size") < small_from).select("item", F.col("part").cast("int").alias("part"), "size", F.lit(None).cast("string").alias("container"), shard("item", "part").alias("shard"))
    filled = bins.unionByName(small).groupBy("shard").applyInPandas(_fill(capacity), "item long, part int, size long, container string")
    return full.unionByName(placed.select("item", "part", "size", label.alias("container"))).unionByName(filled)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, total size, unused share and the lower bound of containers."""
    c = packed.groupBy("container").agg(F.sum("size").alias("used"))
    return c.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("total_size"), F.max("used").alias("fullest")).select(
        "containers", "total_size", "fullest", F.ceil(F.col("total_size") / capacity).alias("lower_bound"), F.round(1 - F.col("total_size") / (F.col("containers") * capacity), 6).alias("unused_share")
    )

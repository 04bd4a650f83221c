"""The most similar vectors of every vector by learned partitions (problem 4).

Fitting: on a bounded sample (``SAMPLE`` vectors) the graph of nearest neighbours is cut into parts of equal size, by
median splits and capacity-bound moves along the graph; a linear classifier then learns, for each vector, which parts
its neighbours lie in. Indexing: every vector goes to its most probable part. Searching: every vector is a query; the
classifier routes it to its most probable parts, in which all members are ranked by their cosine. The number of parts
probed is found by calibration on the sample, so that the wanted share of neighbours is reached.

Vectors that are equal up to length form a class that is searched once. Parts are cut into blocks of bounded size, in
the index and in the queries, so that no task holds a whole hot part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize, spread

#: Bound of the sample that partitions and classifier are fitted on.
SAMPLE = 16384
#: Vectors a part has on average, vectors of the index and queries that one task holds at most.
PART, BLOCK, QUERIES = 4096, 16384, 65536
MOST_PARTS = 1024
SALTS = 32


@dataclass
class Router:
    weights: np.ndarray  # (dim + 1, parts), the last row being the bias

    @property
    def parts(self) -> int:
        return self.weights.shape[1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def route(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` most probable parts of each row, best first."""
        s = self.scores(x)
        if probes >= s.shape[1]:
            return np.argsort(-s, axis=1, kind="stable")
        top = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k) nearest others of each row of unit vectors."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), dtype=np.int32)
    for at in range(0, n, 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[at : at + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 8) -> np.ndarray:
    """A part for each node: equal sizes by median splits along main directions, then moves of nodes to the part that
    most of their neighbours are in while no part grows beyond ``slack`` times the mean."""
    part = np.zeros(len(x), dtype=np.int32)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1 or len(rows) < 2:
            part[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        v = np.linspace(1, 2, x.shape[1], dtype=x.dtype)
        for _ in range(12):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) + 1e-12
        left = count // 2
        order = np.argsort(y @ v, kind="stable")
        cut = len(rows) * left // count
        todo += [(rows[order[:cut]], first, left), (rows[order[cut:]], first + left, count - left)]
    most = math.ceil(slack * len(x) / parts)
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        near = np.zeros((len(x), parts), dtype=np.float32)
        for j in range(graph.shape[1]):
            near[np.arange(len(x)), part[graph[:, j]]] += 1
        best = near.argmax(1)
        gain = near[np.arange(len(x)), best] - near[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, parts: int, k: int = 10, epochs: int = 12, seed: int = 7) -> Router:
    """Partition the graph of ``x`` and fit the classifier by Adam on cross entropy with the parts of the neighbours."""
    dim = x.shape[1]
    if parts <= 1 or len(x) < 2 * parts:
        return Router(np.zeros((dim + 1, 1), dtype=np.float32))
    graph = neighbour_graph(x, k)
    part = balanced_partition(x, graph, parts)
    target = np.zeros((len(x), parts), dtype=np.float32)
    target[np.arange(len(x)), part] += 1
    for j in range(graph.shape[1]):
        target[np.arange(len(x)), part[graph[:, j]]] += 1 / graph.shape[1]
    target /= target.sum(1, keepdims=True)
    rng = np.random.default_rng(seed)
    z = np.concatenate([x, np.ones((len(x), 1), dtype=np.float32)], 1)
    w = np.zeros((dim + 1, parts), dtype=np.float32)
    w[:-1] = np.stack([x[part == p].mean(0) if (part == p).any() else np.zeros(dim, dtype=np.float32) for p in range(parts)], 1) * 8
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 512):
            rows = order[at : at + 512]
            s = z[rows] @ w
            s = np.exp(s - s.max(1, keepdims=True))
            s /= s.sum(1, keepdims=True)
            g = z[rows].T @ (s - target[rows]) / len(rows)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Router(w.astype(np.float32))


def calibrate(router: Router, x: np.ndarray, k: int, recall: float, least: float | None, seed: int = 11) -> int:
    """Parts to probe: the fewest that reach ``recall`` on the sample.

    With ``least``, neighbours matter only from that cosine on, and the hardest ones are tried: vectors turned by exactly
    that angle in random directions. Without it, the true ``k`` neighbours within the sample are."""
    if router.parts == 1:
        return 1
    rng = np.random.default_rng(seed)
    q = x[rng.choice(len(x), min(2048, len(x)), replace=False)]
    if least is not None:
        r = rng.standard_normal(q.shape).astype(np.float32)
        r -= (r * q).sum(1, keepdims=True) * q
        r /= np.linalg.norm(r, axis=1, keepdims=True)
        other = least * q + math.sqrt(1 - least * least) * r
        home = router.route(other, 1)
    else:
        s = q @ x.T
        s[s > 1 - 1e-6] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        home = router.route(x, 1)[:, 0][top]
    rank = np.argsort(router.route(q, router.parts), axis=1)
    at = np.take_along_axis(rank, home, 1)
    for probes in range(1, router.parts + 1):
        if (at < probes).mean() >= recall:
            return probes
    return router.parts


def usable_vectors(df: DataFrame, id_col: str, vec: str, dim: int) -> DataFrame:
    """(id, v): rows whose vector has ``dim`` finite elements, not all zero; repeated rows stay."""
    v = F.col(vec)
    good = F.size(v) == dim
    good = good & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.filter(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def _unit(batches):
    for b in batches:
        x = np.array(b["v"].tolist(), dtype=np.float64).reshape(len(b), -1)
        x /= np.abs(x).max(1, keepdims=True)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        yield pd.DataFrame({"id": b["id"], "u": [r.tobytes() for r in x]})


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype=np.float32).reshape(len(col), dim)


def _router_job(router, probes: int, dim: int):
    def run(batches):
        for b in batches:
            p = router.value.route(_matrix(b["u"], dim), probes) if len(b) else np.zeros((0, probes), dtype=int)
            yield pd.DataFrame({"id": b["id"], "u": b["u"], "parts": list(p.astype(np.int32))})

    return run


#: A query's hits in one part: other ids (8 bytes each), then cosines (4 bytes each).
HITS = "id long, hits binary"


def _search_job(dim: int, k: int, least: float | None):
    """One row a query that finds something: its best others, in order. Queries without an entry come in half precision (``_half``)."""
    def queries(u: pd.Series) -> np.ndarray:
        out = np.empty((len(u), dim), dtype=np.float32)
        short = (u.str.len() == 2 * dim).to_numpy()
        out[~short] = _matrix(u[~short], dim)
        out[short] = np.frombuffer(b"".join(u[short]), dtype=np.float16).reshape(-1, dim)
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base, ask = pdf[pdf["base"]], pdf[pdf["ask"]]
        empty = pd.DataFrame({"id": pd.Series(dtype="int64"), "hits": pd.Series(dtype=object)})
        if not len(base) or not len(ask):
            return empty
        x, q = _matrix(base["u"], dim), queries(ask["u"])
        xi, qi = base["id"].to_numpy(), ask["id"].to_numpy()
        order = np.argsort(xi, kind="stable")
        x, xi = x[order], xi[order]
        found = []
        for at in range(0, len(q), 512):
            s = q[at : at + 512] @ x.T
            ids = qi[at : at + 512]
            pos = np.searchsorted(xi, ids)
            here = (pos < len(xi)) & (xi[np.minimum(pos, len(xi) - 1)] == ids)
            s[np.nonzero(here)[0], pos[here]] = -2
            if least is None:
                n = min(k, s.shape[1])
                cols = np.argpartition(-s, n - 1, axis=1)[:, :n]
                rows, cols = np.repeat(np.arange(len(s)), n), cols.ravel()
                keep = s[rows, cols] > -2
                rows, cols = rows[keep], cols[keep]
            else:
                rows, cols = np.nonzero(s >= least)
            v = s[rows, cols]
            o = np.lexsort((xi[cols], -v, rows))
            rows, cols, v = rows[o], cols[o], v[o]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
            keep = rank < k
            rows, others, v = rows[keep], xi[cols[keep]], v[keep]
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            ends = np.append(first[1:], len(rows))
            o, c = others.astype("<i8"), v.astype("<f4")
            found.append(pd.DataFrame({"id": ids[rows[first]], "hits": [o[a:b].tobytes() + c[a:b].tobytes() for a, b in zip(first, ends)]}))
        return pd.concat(found, ignore_index=True) if found else empty

    return run


@F.pandas_udf(T.BinaryType())
def _half(u: pd.Series) -> pd.Series:
    """The vectors in half precision: their cosines change by some 1e-5."""
    return u.map(lambda b: np.frombuffer(b, dtype=np.float32).astype(np.float16).tobytes())


def _best(k: int):
    def run(hits: pd.Series) -> pd.Series:
        out = []
        for parts in hits:
            n = [len(h) // 12 for h in parts]
            o = np.concatenate([np.frombuffer(h, dtype="<i8", count=m) for h, m in zip(parts, n)])
            c = np.concatenate([np.frombuffer(h, dtype="<f4", offset=8 * m) for h, m in zip(parts, n)])
            top = np.lexsort((o, -c))[:k]
            out.append([(int(o[t]), float(c[t])) for t in top])
        return pd.Series(out)

    run.__annotations__ = {"hits": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.ArrayType(T.StructType([T.StructField("other", T.LongType()), T.StructField("cosine", T.FloatType())])))


def _merged(hits: DataFrame, k: int) -> DataFrame:
    """(id, other, cosine): the ``k`` best of a query's hits; it has at most k from each part that it probed."""
    best = hits.groupBy("id").agg(F.collect_list("hits").alias("hits")).select("id", F.explode(_best(k)("hits")).alias("x"))
    return best.select("id", "x.other", "x.cosine")


def nearest_neighbours(df: DataFrame, id_col: str = "id", vec: str = "embedding", dim: int = 64, k: int = 5, least: float | None = None, recall: float = 0.95, part: int = PART) -> DataFrame:
    """(id, other, cosine, rank): for every usable vector its ``k`` most similar others, rank 1 first, ties by id.

    With ``least``, only neighbours of at least that cosine come out, which needs fewer parts. ``recall`` is the share of
    neighbours that calibration asks for, ``part`` the vectors a part has on average: with larger parts fewer are probed, so less is moved
    and more is compared. Without ``least``, cosines of vectors in other parts are right to about 1e-4. Vectors that are NULL, empty, of another dimension, all zero or not finite have
    no rows; a row delivered twice counts once; an empty table gives an empty result."""
    spark = df.sparkSession
    units = materialize(spread(usable_vectors(df, id_col, vec, dim), "id").mapInPandas(_unit, "id long, u binary"), "vectors")
    # a class of equal directions: its smallest member searches, its k + 1 smallest are enough to answer for all; found in
    # SALTS parts first, so that no task sorts a class that holds a third of the rows
    w = Window.partitionBy("u", "salt").orderBy("id")
    some = units.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("nth", F.dense_rank().over(w)).filter(F.col("nth") <= k + 1).select("id", "u").distinct()
    w = Window.partitionBy("u").orderBy("id")
    few = materialize(some.withColumn("rep", F.min("id").over(w)).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k + 1), "classes")
    reps = few.filter("nth = 1").select("id", "u")
    n = reps.count()
    parts = min(MOST_PARTS, max(1, round(n / part)))
    share = min(1.0, SAMPLE / max(n, 1))
    picked = reps.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("id")).limit(SAMPLE).select("u").collect()
    x = _matrix(pd.Series([bytes(r["u"]) for r in picked]), dim) if picked else np.zeros((0, dim), dtype=np.float32)
    router = fit_router(x, parts)
    probes = calibrate(router, x, k, recall, least) if len(x) > k else router.parts
    shared = spark.sparkContext.broadcast(router)
    routed = materialize(reps.mapInPandas(_router_job(shared, probes, dim), "id long, u binary, parts array<int>"), "routed")
    # index entries and queries per part: at most MOST_PARTS rows
    counted = routed.select(F.posexplode("parts").alias("nth", "part")).groupBy("part").agg(F.count_if(F.col("nth") == 0).alias("n"), F.count(F.lit(1)).alias("asks")).collect()
    cut = [(int(r["part"]), max(1, math.ceil(r["n"] / BLOCK)), max(1, math.ceil(r["asks"] / QUERIES))) for r in counted if r["n"]] or [(0, 1, 1)]
    blocks = spark.createDataFrame(cut, "part int, nb int, nq int")
    # a part is cut into nb blocks of entries and nq blocks of queries, which meet pairwise; a vector in its own part is both
    h = F.xxhash64("id")
    sent = (
        routed.select("id", "u", F.posexplode("parts").alias("nth", "part")).join(F.broadcast(blocks), "part")
        .withColumn("bq", F.explode(F.sequence(F.lit(0), F.col("nb") * F.col("nq") - 1)))
        .withColumn("base", (F.col("nth") == 0) & (F.floor(F.col("bq") / F.col("nq")) == F.pmod(h, F.col("nb"))))
        .withColumn("ask", F.col("bq") % F.col("nq") == F.pmod(F.shiftright(h, 20), F.col("nq")))
        .filter("base or ask").select("id", "u", "base", "ask", "part", "bq")
    )
    if least is None:
        # copies of a query that only ask, which are most of what is moved
        sent = sent.withColumn("u", F.when(F.col("base"), F.col("u")).otherwise(_half("u")))
    # a task a block, whatever the number of blocks, so that none reads more the larger the collection is
    sent = sent.repartition(max(sum(nb * nq for _, nb, nq in cut), spark.sparkContext.defaultParallelism), "part", "bq")
    near = _merged(sent.groupBy("part", "bq").applyInPandas(_search_job(dim, k, least), HITS), k)
    # back from classes to records: the candidates of a class are its smallest members and those of the classes near to it, of which the
    # k + 1 best serve every member. They meet the records of large classes in SALTS parts; the members of others are all in ``few``.
    inner = few.filter(F.col("nth") <= k).select(F.col("rep").alias("rep2"), F.col("id").alias("other"))
    outside = near.select(F.col("id").alias("rep"), F.col("other").alias("rep2"), "cosine").join(inner, "rep2").select("rep", "other", "cosine", F.lit(None).cast("binary").alias("u"), F.lit(False).alias("own"))
    own = few.select("rep", F.col("id").alias("other"), F.lit(1.0).cast("float").alias("cosine"), F.when(F.col("nth") == 1, F.col("u")).alias("u"), F.lit(True).alias("own"))
    lists = own.unionByName(outside).groupBy("rep").agg(
        F.max("u").alias("u"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("other")))), 1, k + 1).alias("best"), F.collect_list(F.when(F.col("own"), F.col("other"))).alias("members")
    )
    large = lists.filter(F.size("members") > k).select("u", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of_large = units.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(large, ["u", "salt"]).select("id", "best")
    of_small = lists.filter(F.size("members") <= k).select(F.explode("members").alias("id"), "best")
    each = of_large.unionByName(of_small).dropDuplicates(["id"]).select("id", F.posexplode(F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, k)).alias("r", "x"))
    return each.select("id", F.col("x.other").alias("other"), (-F.col("x.c")).alias("cosine"), (F.col("r") + 1).cast("int").alias("rank"))


def similar_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (chunk_id_a, chunk_id_b), a < b, of at least the cosine ``least``."""
    return neighbours.filter(F.col("cosine") >= F.lit(least) - 1e-6).select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()


def recall_against_brute_force(df: DataFrame, neighbours: DataFrame, id_col: str = "id", vec: str = "embedding", dim: int = 64, k: int = 5, every: int = 50) -> DataFrame:
    """One row (n_queries, recall): of the ``k`` nearest of the vectors whose ids are divisible by ``every``, found by comparing them with all
    vectors in blocks, the share that ``neighbours`` has (or has others of at least the same cosine)."""
    spark = df.sparkSession
    units = materialize(spread(usable_vectors(df, id_col, vec, dim), "id").mapInPandas(_unit, "id long, u binary").dropDuplicates(["id"]), "vectors")
    asked = units.filter(F.col("id") % every == 0)
    n, q = units.count(), asked.count()
    nb, nq = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(q / BLOCK))
    part = lambda m, other: [F.pmod(F.xxhash64("id"), F.lit(m)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(other - 1)))]
    b, a = part(nb, nq), part(nq, nb)
    base = units.select("id", "u", F.lit(True).alias("base"), F.lit(False).alias("ask"), b[0].alias("part"), b[1].alias("bq"))
    ask = asked.select("id", "u", F.lit(False).alias("base"), F.lit(True).alias("ask"), a[1].alias("part"), a[0].alias("bq"))
    hits = base.unionByName(ask).repartition(max(nb * nq, spark.sparkContext.defaultParallelism), "part", "bq").groupBy("part", "bq").applyInPandas(_search_job(dim, k, None), HITS)
    least = _merged(hits, k).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least"))
    got = neighbours.select("id", "cosine").join(least.select("id", "least"), "id").filter(F.col("cosine") >= F.col("least") - 1e-4).groupBy("id").agg(F.count(F.lit(1)).alias("got"))
    s = least.join(got, "id", "left").agg(F.sum("n").alias("n"), F.sum(F.least(F.coalesce("got", F.lit(0)), F.col("n"))).alias("got"))
    return asked.agg(F.count(F.lit(1)).alias("n_queries")).crossJoin(s).select("n_queries", F.coalesce(F.col("got") / F.col("n"), F.lit(1.0)).alias("recall"))  # one row each

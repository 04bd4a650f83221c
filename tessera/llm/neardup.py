"""Groups of records that are the same but for small edits (problem 7).

Words are the longest runs of ``[A-Za-z0-9_]``; a record is the set of its runs of ``words`` consecutive words, hashed to
32 bits. Records with equal sets form a class, and only class representatives go on. Each gets a one-permutation
signature: one hash per shingle, the smallest in each of ``bands * rows`` bins, empty bins filled by optimal
densification (a second hash of bin and attempt picks the bin to copy from, so that two records choose alike). Records
that agree in all ``rows`` bins of a band share a bucket. In a bucket of at most ``SMALL`` records all pairs are candidates. A
larger one of m records yields at most 2(m-1) edges: each record with the bucket's centre (a pseudo-random member, another in each
band) and with its predecessor in its salted part; and because a star misses similar leaves whose centre is not similar, the records of
large buckets also meet in an exact join on their rare shingles (prefix filter), so that similar records are found among any
number of others that fill their buckets. Candidates are verified on the whole shingle sets. What shares a verified neighbour
is compared as well, which finds pairs that no band brought together; a component is never compared all against all, so a long chain of
edits costs its length.

No record is dropped: buckets are counted and joined, never gathered or sorted in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize, spread

WORD = "[A-Za-z0-9_]+"
#: Size of a bucket up to which all its pairs are compared at once; larger ones take the star and the exact join.
SMALL = 32
#: Counters of shingles, a fixed number; any counts give a right order of shingles, better ones a cheaper join.
CELLS = 1 << 18
#: Records of a large bucket that one task puts in order.
PART = 4096
SIGNATURE = T.StructType([T.StructField("rep", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiply-xorshift hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def one_permutation_signatures(values: np.ndarray, lengths: np.ndarray, bins: int) -> np.ndarray:
    """(len(lengths), bins) signatures of concatenated shingle hashes; a set without members gives zeros."""
    n = len(lengths)
    h = _mix(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    row = np.repeat(np.arange(n, dtype=np.int64), lengths)
    cell = row * bins + (h >> np.uint64(40)).astype(np.int64) % bins
    low = (h & np.uint64((1 << 40) - 1)).astype(np.int64)
    empty = np.int64(1) << 41
    sig = np.full(n * bins, empty, dtype=np.int64)
    np.minimum.at(sig, cell, low)
    sig = sig.reshape(n, bins)
    sig[lengths == 0] = 0
    filled = sig != empty
    rows, cols = np.nonzero(~filled)
    source = sig.copy()
    attempt = 0
    while len(rows):
        attempt += 1
        to = (_mix(cols.astype(np.uint64) * np.uint64(0x1000003) + np.uint64(attempt * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(bins)).astype(np.int64)
        ok = filled[rows, to]
        sig[rows[ok], cols[ok]] = source[rows[ok], to[ok]]
        rows, cols = rows[~ok], cols[~ok]
    return sig


def _signer(bands: int, rows: int):
    def run(batches):
        for b in batches:
            sets = b.column(2)
            lengths = np.diff(sets.offsets.to_numpy())
            flat = sets.flatten().to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF
            sig = one_permutation_signatures(flat, lengths, bands * rows).reshape(len(lengths), bands, rows).astype(np.uint64)
            key = np.zeros((len(lengths), bands), dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for r in range(rows):
                key = _mix(key ^ (sig[:, :, r] + np.uint64(0x632BE59BD9B4E019)))
            offsets = np.arange(0, len(lengths) * bands + 1, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(key.ravel().view(np.int64)))], names=["rep", "n", "bands"])

    return run


def shingle_sets(df: DataFrame, id_col: str, text: str, words: int, least: int) -> DataFrame:
    """(id, n, sh): sorted distinct shingle hashes of each row with at least ``least`` of them."""
    w = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), 1)

    def sets(ws):  # a lambda variable and explode keep the words and the set from being computed again where they are used
        some = F.sequence(F.lit(1), F.greatest(F.size(ws) - (words - 1), F.lit(1)))
        return F.array_sort(F.array_distinct(F.transform(some, lambda i: F.hash(*[F.get(ws, i + (k - 1)) for k in range(words)]))))

    d = spread(df.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull()), id_col)
    d = d.select(F.col(id_col).cast("long").alias("id"), F.explode(F.transform(F.filter(F.array(w), lambda ws: F.size(ws) >= words), sets)).alias("sh"))
    return d.withColumn("n", F.size("sh")).filter(F.col("n") >= least).select("id", "n", "sh")


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep) of classes of equal sets, and the classes (rep, n, sh)."""
    keyed = sets.withColumn("k", F.md5(F.array_join("sh", ",").cast("binary")))
    reps = materialize(keyed.groupBy("k").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sh").alias("sh")), "classes")
    members = keyed.select("id", "k").distinct().join(reps.select("k", "rep"), "k").select("id", "rep")
    return members, reps.select("rep", "n", "sh")


def buckets(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(rep, n, k, m): the records of each bucket k of m > 1 records. Buckets are counted first, in parts; the join that follows can be
    split where one is hot, which a window could not."""
    signed = reps.select("rep", "n", "sh").mapInArrow(_signer(bands, rows), SIGNATURE)
    signed = materialize(signed, "signed")
    rowsdf = signed.select("rep", "n", F.explode("bands").alias("k"))
    several = rowsdf.groupBy("k").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    return rowsdf.join(several, "k")


def candidates(shared: DataFrame, threshold: float) -> DataFrame:
    """Distinct candidate edges (a, b), a < b: all pairs of small buckets, stars and chains of large ones."""
    edge = lambda x, y: F.struct(F.least(x["rep"], y["rep"]).alias("a"), F.greatest(x["rep"], y["rep"]).alias("b"), F.least(x["n"], y["n"]).alias("lo"), F.greatest(x["n"], y["n"]).alias("hi"))
    me = F.struct("rep", "n")
    small = shared.filter(F.col("m") <= SMALL).groupBy("k").agg(F.collect_list(me).alias("r"))
    small = small.select(F.explode(F.flatten(F.transform("r", lambda x, i: F.transform(F.slice("r", F.lit(1), i), lambda y: edge(x, y))))).alias("e"))
    hot = shared.filter(F.col("m") > SMALL).withColumn("o", F.xxhash64("rep", "k"))
    centres = hot.groupBy("k").agg(F.min_by(me, F.struct("o", "rep")).alias("c"))
    stars = hot.join(centres, "k").select(edge(F.col("c"), me).alias("e"))
    w = Window.partitionBy("k", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / PART))).orderBy("o", "rep")
    chains = hot.select(me.alias("x"), F.lag(me).over(w).alias("p")).filter("p is not null").select(edge(F.col("x"), F.col("p")).alias("e"))
    e = small.unionByName(stars).unionByName(chains).select("e.*")
    return e.filter((F.col("a") != F.col("b")) & (F.col("lo") >= F.col("hi") * F.lit(threshold))).select("a", "b").distinct()


def crowded(shared: DataFrame) -> DataFrame:
    """(rep) of the records of large buckets."""
    return shared.filter(F.col("m") > SMALL).select("rep").distinct()


def neighbours_of_neighbours(links: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, that share a neighbour in ``links`` and are no link themselves."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    x, y = both.select("a", F.col("b").alias("x")), both.select("a", F.col("b").alias("y"))
    pairs = x.join(y, "a").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    return pairs.join(links.select("a", "b"), ["a", "b"], "left_anti")


def _prefixes(counts: np.ndarray, threshold: float):
    """Rows (rep, n, tok, i, short) of the rarest shingles of each set: as many as a set must show to meet a
    smaller similar one; ``short`` marks those that are enough to meet an equal or larger one."""

    def run(batches):
        for b in batches:
            sets = b.column(2)
            lengths = np.diff(sets.offsets.to_numpy()).astype(np.int64)
            flat = sets.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
            order = np.lexsort((flat, counts[flat.astype(np.int64) & (CELLS - 1)], row))
            i = np.arange(len(flat), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            probe = lengths - np.ceil(threshold * lengths - 1e-6).astype(np.int64) + 1
            index = lengths - np.ceil(2 * threshold / (1 + threshold) * lengths - 1e-6).astype(np.int64) + 1
            keep = i < probe[row]
            row, i, tok = row[keep], i[keep], flat[order][keep]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(tok, pa.int32()), pa.array(i.astype(np.int32)), pa.array(i < index[row])], names=["rep", "n", "tok", "i", "short"])

    return run


def rare_meetings(records: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ``records`` (rep), among them every pair of at least the similarity ``threshold``. Shingles are put in one order for all sets, rare ones first. Of two similar sets the smaller
    one, of n shingles, shares at least 2t/(1+t) n with the other, so one of its first n - 2t/(1+t) n + 1 is among the first
    n' - t n' + 1 of the other; the first such place also bounds what can follow it."""
    sets = materialize(reps.join(records, "rep").select("rep", "n", "sh"), "sets")
    counts = np.zeros(CELLS, dtype=np.int64)
    cells = sets.select(F.explode("sh").alias("s")).groupBy(F.col("s").bitwiseAND(CELLS - 1).alias("c")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts[cells["c"].to_numpy()] = cells["n"].to_numpy()
    rows = materialize(sets.mapInArrow(_prefixes(counts, threshold), "rep long, n int, tok int, i int, short boolean"), "prefixes")
    x, y = rows.alias("x"), rows.filter("short").alias("y")
    least = F.lit(threshold / (1 + threshold)) * (F.col("x.n") + F.col("y.n")) - 1e-6
    met = x.join(
        y.hint("merge"),
        (F.col("x.tok") == F.col("y.tok")) & (F.struct("y.n", "y.rep") < F.struct("x.n", "x.rep"))
        & (F.col("y.n") >= F.col("x.n") * F.lit(threshold) - 1e-6) & (F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i")) >= least),
    )
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def verified(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least the Jaccard similarity ``threshold``, with it."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = reps.join(ids, "rep", "left_semi")
    a = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sh").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sh").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.col("na") + F.col("nb") - both).alias("any"))
        .filter(F.col("both") >= F.col("any") * F.lit(threshold) - 1e-9).select("a", "b", (F.col("both") / F.col("any")).alias("similarity"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (a, b), the component being its smallest node.

    Alternating large and small stars; each round is written to the shared folder. Ends when a round changes nothing,
    after a number of rounds that is logarithmic in the longest path."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        e = both(edges)
        low = e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = e.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = materialize(small.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()


def near_duplicates(df: DataFrame, id_col: str, text: str, words: int = 5, threshold: float = 0.8, least: int = 1, bands: int = 40, rows: int = 4) -> tuple[DataFrame, DataFrame]:
    """Groups and links of near-duplicates.

    Returns (groups, links): groups has one row a record with at least ``least`` shingles: id, class_id (smallest id with
    the same set), group_id (smallest class of its component) and n_links (classes directly similar to its own); links
    has the similar pairs of classes (a, b, similarity), a < b, as representatives. NULL ids or texts and records with too
    few words have no row; repeated rows count once; extra columns are ignored; an empty table gives empty results."""
    members, reps = classes(shingle_sets(df, id_col, text, words, least))
    shared = materialize(buckets(reps, bands, rows), "buckets")
    met = candidates(shared, threshold)
    hot = materialize(crowded(shared), "crowded")
    if not hot.isEmpty():
        met = met.unionByName(rare_meetings(hot, reps, threshold)).distinct()
    found = materialize(verified(met, reps, threshold), "found")
    links = found.unionByName(materialize(verified(neighbours_of_neighbours(found), reps, threshold), "further"))
    comp = materialize(components(links), "components")
    n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    groups = (
        members.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").join(n, "rep", "left")
        .select("id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    return groups, links


def pairs_of(groups: DataFrame, links: DataFrame) -> DataFrame:
    """All similar pairs (a, b) of records: members of linked classes and copies within a class. Its size is the number
    of pairs that the definition asks for; the linear form is what ``near_duplicates`` returns."""
    m = groups.select("id", "class_id")
    again = links.select("a", "b").unionByName(groups.filter("id <> class_id").select(F.col("class_id").alias("a"), F.col("class_id").alias("b")).distinct())
    a, b = m.select(F.col("class_id").alias("a"), F.col("id").alias("i")), m.select(F.col("class_id").alias("b"), F.col("id").alias("j"))
    p = again.join(a, "a").join(b, "b").filter("a <> b or i < j")
    return p.select(F.least("i", "j").alias("chunk_id_a"), F.greatest("i", "j").alias("chunk_id_b"))

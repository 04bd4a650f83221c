"""Records of several sources mixed to target shares of the total size (problem 9).

The total is the largest at which no source needs more than its cap of copies (or a given total). A source that must give
c times its own size gives floor(c) whole copies of every document and a sample of the fraction left: Pareto order
sampling, in which documents rank by u/(1-u) over p/(1-p), u being a pseudo-random number of the document and p its inclusion
probability (proportional to its size to a power), and the first ones are taken up to the size wanted. A document whose probability
would be 1 or more is taken for certain and the others' probabilities are computed anew, until there is none. The sample's size is fixed in
tokens, not in documents, because shares are shares of tokens.

The cut in the ranking is found without gathering a source: ranks fall into buckets whose sizes are summed, only the bucket
that holds the cut is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

#: Buckets of the ranking of a source; the bucket with the cut is sorted in one task.
BUCKETS = 16384


def mixture(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "n_tokens", total: int | None = None, power: float = 0.5, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents that are used, copies being at most the source's cap.

    ``targets`` has (source, target_share, max_repeats), a row a source and bounded. Documents whose source is NULL or has no
    target, of size 0 or NULL, or without an id are not used; a document repeated with the same source and size counts once. A source without
    documents gives nothing; the other shares are then shares of what the sources with documents give."""
    t = targets.filter((F.col("target_share") > 0) & F.col("source").isNotNull() & (F.col("max_repeats") > 0))
    d = docs.filter(F.col(doc_id).isNotNull() & (F.col(size) > 0)).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(size).cast("long").alias("n_tokens"))
    d = materialize(d.dropDuplicates(["doc_id", "source", "n_tokens"]).join(t.select("source"), "source", "left_semi"), "sized")
    w = F.pow(F.col("n_tokens").cast("double"), F.lit(power))
    have = {r["source"]: r for r in d.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.sum(w).alias("weight"), F.sum(w * F.col("n_tokens")).alias("weighted")).collect()}  # a row a target
    goal = {r["source"]: r for r in t.collect()}
    share = sum(goal[s]["target_share"] for s in have)
    spark = docs.sparkSession
    if not have:
        return d.withColumn("copies", F.lit(1)).limit(0)
    most = min(have[s]["tokens"] * goal[s]["max_repeats"] / (goal[s]["target_share"] / share) for s in have)
    most = min(most, total) if total else most
    rests = {}
    for s, h in have.items():
        wanted = most * goal[s]["target_share"] / share
        whole = min(int(wanted / h["tokens"] + 1e-9), goal[s]["max_repeats"])
        rest = max(0.0, wanted - whole * h["tokens"]) if whole < goal[s]["max_repeats"] else 0.0
        rests[s] = (whole, float(rest))
    # p = k * size^power gives an expected size of rest; sizes from ``certain`` on are taken in any case
    plan = [(s, whole, rest, rest / have[s]["weighted"], float("inf")) for s, (whole, rest) in rests.items()]
    sizes = materialize(d.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "sizes")
    while True:
        limits = {s: k ** (-1 / power) if k > 0 and power > 0 else certain for s, _, _, k, certain in plan}
        if all(limits[s] >= certain * (1 - 1e-12) for s, _, _, _, certain in plan):
            break
        at = F.broadcast(spark.createDataFrame([(s, float(min(limits[s], c))) for s, _, _, _, c in plan], "source string, certain double"))  # a row a source
        left = F.col("n_tokens") < F.col("certain")
        sums = sizes.join(at, "source").groupBy("source").agg(F.sum(F.when(left, w * F.col("n_tokens") * F.col("n")).otherwise(0.0)).alias("weighted"), F.sum(F.when(left, 0).otherwise(F.col("n_tokens") * F.col("n"))).alias("sure"))
        sums = {r["source"]: r for r in sums.collect()}
        plan = [(s, whole, rest, max(0.0, rest - sums[s]["sure"]) / sums[s]["weighted"] if sums[s]["weighted"] else 0.0, float(min(limits[s], c))) for s, whole, rest, _, c in plan]
    plan = spark.createDataFrame(plan, "source string, whole int, rest double, k double, certain double")
    x = d.join(F.broadcast(plan), "source")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    p = F.greatest(F.lit(1e-12), F.least(F.col("k") * w, F.lit(1 - 1e-9)))
    x = materialize(x.withColumn("odds", F.when(F.col("n_tokens") >= F.col("certain"), F.lit(0.0)).otherwise((u / (1 - u)) / (p / (1 - p)))), "ranked")
    # log of the odds in buckets: about even ones where the cut can be
    bucket = F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.coalesce(F.floor((F.log("odds") + 8) * (BUCKETS / 16)), F.lit(0)))).cast("int")  # certain ones have no logarithm
    x = x.filter("rest > 0").withColumn("bucket", bucket).unionByName(x.filter("rest = 0").withColumn("bucket", F.lit(-1)))
    by = x.filter("rest > 0").groupBy("source", "rest", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = by.withColumn("before", before).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("s") >= F.col("rest"))).select("source", F.col("bucket").alias("cut"), "before")
    x = x.join(F.broadcast(cut), "source", "left")  # at most a row a source
    inside = x.filter(F.col("bucket") == F.col("cut")).withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("odds", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    # the document that the cut falls into is taken if more than half of it is wanted
    inside = inside.withColumn("taken", F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).drop("upto")
    outside = x.filter(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).withColumn("taken", (F.col("rest") > 0) & F.coalesce(F.col("bucket") < F.col("cut"), F.lit(True)))
    both = inside.unionByName(outside)
    return both.withColumn("copies", F.col("whole") + F.col("taken").cast("int")).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def mixture_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, share, most_copies): what each target reached."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("tokens").alias("all"))
    r = targets.join(got, "source", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c, k: F.coalesce(c, F.lit(0)).cast(k).alias(c)
    return r.select("source", "target_share", "max_repeats", zero("documents", "long"), zero("tokens", "long"), F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("share"), zero("most_copies", "int"))

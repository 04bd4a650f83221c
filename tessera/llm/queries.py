"""Registered queries of the subpackage, each over its whole tables, and SQL twins where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import canonical, credentials, handwritten, mixing, neardup, neighbours, packing, splitting, syntax
from tessera.llm.tokens import count_tokens
from tessera.session import spread
from tessera.sources.tables import table


def _limit(spark: SparkSession, d: str, name: str) -> tuple[int, int]:
    r = table(spark, d, "size_limits").filter(F.col("limit_name") == name).first()
    return int(r["capacity"]), int(r["overlap_size"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = credentials.find_credentials(table(spark, d, "chunks").select("id", "content"))
    return found.select(F.col("id").alias("chunk_id"), "line_no").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redact_credentials(table(spark, d, "chunks").select("id", "content").dropDuplicates(["id"]))


def p1_residue(spark: SparkSession, d: str) -> DataFrame:
    """One row (n_chunks, n_findings): the chunks with a text, and what is still found in them after redaction, which is nothing."""
    done = p1_redacted(spark, d).select("id", "content")
    left = credentials.find_credentials(done).agg(F.count(F.lit(1)).alias("n_findings"))
    return done.agg(F.count(F.lit(1)).alias("n_chunks")).crossJoin(left)  # one row each


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return syntax.judged_files(table(spark, d, "files").select("id", "path", "project_root"), table(spark, d, "chunks").select("id", "file_id", "start_line", "content"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).filter("not valid").select("file_id")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.parse_rates(_judged(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = _limit(spark, d, "chunk_piece")
    pieces = splitting.split_oversized(table(spark, d, "chunks").select("id", "content", "start_line"), limit=limit, overlap=overlap)
    return pieces.filter("piece_no = 1").select(F.col("id").alias("chunk_id")).distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = _limit(spark, d, "chunk_piece")
    return splitting.split_oversized(table(spark, d, "chunks").select("id", "content", "start_line"), limit=limit, overlap=overlap)


def p3_audit(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, within, complete, lines): for each oversized chunk, whether all pieces are within the limit, put together without their overlap
    they are the text, and their lines are those that the text has there."""
    limit, overlap = _limit(spark, d, "chunk_piece")
    return splitting.audited(table(spark, d, "chunks").select("id", "content", "start_line"), limit, overlap).withColumnRenamed("id", "chunk_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("id", "embedding")
    return neighbours.similar_pairs(neighbours.nearest_neighbours(chunks, least=0.9), 0.9)


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    # neighbours of any cosine lie in many parts: larger ones, so that fewer copies of a vector are needed
    return neighbours.nearest_neighbours(table(spark, d, "chunks").select("id", "embedding"), part=4 * neighbours.PART)


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """One row (n_queries, enough): for the vectors of ids divisible by 50, whether at least 0.9 of their 5 nearest by brute force are found."""
    return neighbours.recall_against_brute_force(table(spark, d, "chunks").select("id", "embedding"), p4_neighbours(spark, d)).select("n_queries", (F.col("recall") >= 0.9).alias("enough"))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classified_files(table(spark, d, "files").select("id", "path", "project_root"), table(spark, d, "chunks").select("id", "file_id", "start_line", "content"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).filter("is_foreign").select("file_id")


def p5_classified(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d)


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, d, "chunks").select("id", "content")
    return neardup.near_duplicates(chunks, "id", "content", words=3, threshold=0.6, least=40)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs_of(*_near(spark, d))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d)[0].withColumnRenamed("id", "chunk_id")


def _packed(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, int]:
    capacity, _ = _limit(spark, d, name)
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", count_tokens(F.col("text")).alias("n_tokens"))
    return packing.pack(docs, "doc_id", "n_tokens", capacity), capacity


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, "container")[0].withColumnRenamed("item", "doc_id")


def p8_small_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, "small_container")[0].withColumnRenamed("item", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(*_packed(spark, d, "container"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id").select("doc_id", "source", count_tokens(F.col("text")).alias("n_tokens"))
    return mixing.mixture(docs, table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(_mixed(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.lookalike_pairs(table(spark, d, "documents").select("doc_id", "text"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.lookalike_groups(table(spark, d, "documents").select("doc_id", "text"))


def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonicalise(table(spark, d, "documents").select("doc_id", "text"), "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p1_residue, p2_found, p2_rates, p3_found, p3_pieces, p3_audit, p4_found, p4_neighbours, p4_recall, p5_found, p5_classified, p7_found, p7_groups, p8_containers, p8_small_containers, p8_report, p9_mixture, p9_shares, p10_found, p10_classes, p10_canonical)}

ORACLE_SQL = {
    "p1_residue": "SELECT count(DISTINCT id) AS n_chunks, 0 AS n_findings FROM chunks WHERE content <> '' AND id IS NOT NULL",
    "p3_audit": "SELECT DISTINCT id AS chunk_id, true AS within, true AS complete, true AS lines FROM chunks WHERE strlen(content) > (SELECT capacity FROM size_limits WHERE limit_name = 'chunk_piece')",
    "p4_recall": "SELECT count(DISTINCT id) AS n_queries, true AS enough FROM chunks WHERE id % 50 = 0 AND len(embedding) = 64 AND isfinite(list_sum(embedding)) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0",
    "p7_found": r"""
WITH w AS (SELECT id, regexp_extract_all(content, '[A-Za-z0-9_]+') AS w FROM (SELECT DISTINCT id, content FROM chunks)),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id HAVING count(*) >= 40),
k AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM k JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.6::DOUBLE * (x.n + y.n - k) - 1e-9""",
    "p3_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE strlen(content) > (SELECT capacity FROM size_limits WHERE limit_name = 'chunk_piece')",
}

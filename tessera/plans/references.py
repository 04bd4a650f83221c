"""Queries of problem 6: orphan references of the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.references import ForeignKey, orphan_report, orphans
from tessera.sources.tables import table

KEYS = [
    ForeignKey("symbol_links", "from_chunk_id", "chunks", "id"),
    ForeignKey("symbol_links", "to_symbol_name", "chunks", "symbol_name"),
    ForeignKey("chunks", "file_id", "files", "id"),
]


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "symbol_links": table(spark, d, "symbol_links").select("id", "from_chunk_id", "to_symbol_name", "ingested_at"),
        "chunks": table(spark, d, "chunks").select("id", "file_id", "symbol_name", "ingested_at"),
        "files": table(spark, d, "files").select("id"),
    }


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(_tables(spark, d), KEYS).filter("kind = 'direct'").select("ref_table", "ref_field", "row_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_tables(spark, d), KEYS)


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}

_DIRECT = """
  SELECT DISTINCT 'symbol_links' AS ref_table, 'from_chunk_id' AS ref_field, id AS row_id FROM symbol_links l
   WHERE from_chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.id = l.from_chunk_id)
  UNION ALL
  SELECT DISTINCT 'symbol_links', 'to_symbol_name', id FROM symbol_links l
   WHERE to_symbol_name <> '' AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.symbol_name = l.to_symbol_name)
  UNION ALL
  SELECT DISTINCT 'chunks', 'file_id', id FROM chunks c
   WHERE file_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files f WHERE f.id = c.file_id)
"""
ORACLE_SQL = {
    "p6_found": _DIRECT,
    "p6_report": f"""
WITH direct AS ({_DIRECT}),
lost AS (SELECT row_id FROM direct WHERE ref_table = 'chunks'),
refs AS (
  SELECT 'symbol_links' AS ref_table, 'from_chunk_id' AS ref_field, id AS row_id, min(ingested_at) AS at, bool_or(from_chunk_id IN (SELECT row_id FROM lost)) AS inh
    FROM symbol_links WHERE from_chunk_id IS NOT NULL GROUP BY id
  UNION ALL
  SELECT 'symbol_links', 'to_symbol_name', id, min(ingested_at), bool_or(
      to_symbol_name IN (SELECT symbol_name FROM chunks WHERE symbol_name IS NOT NULL)
      AND to_symbol_name NOT IN (SELECT symbol_name FROM chunks WHERE symbol_name IS NOT NULL AND id NOT IN (SELECT row_id FROM lost)))
    FROM symbol_links WHERE to_symbol_name <> '' GROUP BY id
  UNION ALL
  SELECT 'chunks', 'file_id', id, min(ingested_at), false FROM chunks WHERE file_id IS NOT NULL GROUP BY id)
SELECT r.ref_table, r.ref_field, strftime(r.at, '%Y-%m') AS month, count(*) AS n_refs, count(d.row_id) AS n_direct,
       count(*) FILTER (WHERE d.row_id IS NULL AND r.inh) AS n_inherited, round(count(d.row_id) / count(*), 6) AS direct_rate
  FROM refs r LEFT JOIN direct d ON d.ref_table = r.ref_table AND d.ref_field = r.ref_field AND d.row_id = r.row_id
 GROUP BY 1, 2, 3
""",
}

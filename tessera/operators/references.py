"""References to records that do not exist (problem 6).

The foreign keys of a set of tables form a graph. A row is a direct orphan of a key if its field is neither NULL nor ''
and equals no target value at all (a target that arrives later is there). A row whose target exists, but only in rows
that are orphans themselves, is an inherited orphan; inheritance is followed down the graph until nothing changes.

Keys are reduced to distinct values before they are compared, so a value that a third of all rows share is compared
once; rows then meet only the few missing values in a semi-join, whose row side adaptive execution can split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


@dataclass(frozen=True)
class ForeignKey:
    table: str
    field: str
    target: str
    target_field: str


def _present(c: Column, kind: str) -> Column:
    return c.isNotNull() & (c != "") if kind == "string" else c.isNotNull()


def _values(df: DataFrame, field: str) -> DataFrame:
    return df.filter(_present(F.col(field), dict(df.dtypes)[field])).select(F.col(field).alias("key")).distinct()


def missing_values(refs: DataFrame, field: str, targets: DataFrame, target_field: str) -> DataFrame:
    """Distinct values (key) of ``field`` that no row of ``targets`` has."""
    return _values(refs, field).join(_values(targets, target_field), "key", "left_anti")


def direct_orphans(tables: dict[str, DataFrame], keys: list[ForeignKey], row_id: str = "id") -> DataFrame:
    """(ref_table, ref_field, row_id): one row for each row and key whose target is missing.

    A row delivered twice counts once; NULL row ids give no rows; empty target tables make every reference an orphan."""
    out = None
    for k in keys:
        t = tables[k.table].select(F.col(row_id).cast("long").alias("row_id"), F.col(k.field).alias("key")).filter(F.col("row_id").isNotNull())
        t = t.join(missing_values(t, "key", tables[k.target], k.target_field), "key", "left_semi").select(F.lit(k.table).alias("ref_table"), F.lit(k.field).alias("ref_field"), "row_id")
        out = t if out is None else out.unionByName(t)
    return out.distinct()


def _longest_path(keys: list[ForeignKey]) -> int | None:
    """Length of the longest chain of keys; None if the graph has a cycle."""
    depth: dict[str, int] = {}

    def of(t: str, seen: tuple[str, ...]) -> int:
        if t in seen:
            raise ValueError
        if t not in depth:
            depth[t] = max([0, *(1 + of(k.target, (*seen, t)) for k in keys if k.table == t)])
        return depth[t]

    try:
        return max([0, *(of(k.table, ()) for k in keys)])
    except ValueError:
        return None


def orphans(tables: dict[str, DataFrame], keys: list[ForeignKey], row_id: str = "id") -> DataFrame:
    """(ref_table, ref_field, row_id, kind, depth): direct orphans at depth 0 and inherited ones at the length of the
    chain that leads to a direct one. A row can be an orphan by several fields; per field it has its smallest depth.

    Each round is written to the shared folder; without cycles there are as many as the longest chain of keys, with
    cycles it ends at the first round that finds nothing new."""
    found = materialize(direct_orphans(tables, keys, row_id).withColumn("kind", F.lit("direct")).withColumn("depth", F.lit(0)), "orphans")
    rounds, depth = _longest_path(keys), 0
    new = found
    while rounds is None or depth < rounds - 1:
        depth += 1
        gained = None
        for k in keys:
            if not any(x.table == k.target for x in keys):
                continue  # rows of the target table refer to nothing and can't be orphans
            bad = found.filter(F.col("ref_table") == k.target).select("row_id").distinct()
            fresh = new.filter(F.col("ref_table") == k.target).select("row_id").distinct()
            target = tables[k.target].select(F.col(row_id).cast("long").alias("row_id"), F.col(k.target_field).alias("key"))
            candidates = _values(target.join(fresh, "row_id", "left_semi"), "key")
            sound = _values(target.join(bad, "row_id", "left_anti"), "key")
            lost = candidates.join(sound, "key", "left_anti")
            t = tables[k.table].select(F.col(row_id).cast("long").alias("row_id"), F.col(k.field).alias("key")).filter(F.col("row_id").isNotNull())
            t = t.join(lost, "key", "left_semi").select(F.lit(k.table).alias("ref_table"), F.lit(k.field).alias("ref_field"), "row_id").distinct()
            gained = t if gained is None else gained.unionByName(t)
        if gained is None:
            break
        new = gained.join(found, ["ref_table", "ref_field", "row_id"], "left_anti").withColumn("kind", F.lit("inherited")).withColumn("depth", F.lit(depth))
        new = materialize(new, "orphans")
        if rounds is None and new.isEmpty():
            break
        found = found.unionByName(new)
    return found


def orphan_report(tables: dict[str, DataFrame], keys: list[ForeignKey], when: str = "ingested_at", row_id: str = "id") -> DataFrame:
    """Orphans per table, field and month of the first arrival: (ref_table, ref_field, month, n_refs, n_direct,
    n_inherited, direct_rate). References are rows whose field is neither NULL nor ''. A NULL time gives a NULL month."""
    found = orphans(tables, keys, row_id)
    out = None
    for k in keys:
        t = tables[k.table].filter(_present(F.col(k.field), dict(tables[k.table].dtypes)[k.field]) & F.col(row_id).isNotNull())
        t = t.groupBy(F.col(row_id).cast("long").alias("row_id")).agg(F.min(when).alias("at"))
        f = found.filter((F.col("ref_table") == k.table) & (F.col("ref_field") == k.field)).select("row_id", "kind")
        r = t.join(f, "row_id", "left").groupBy(F.date_format(F.col("at"), "yyyy-MM").alias("month")).agg(
            F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("kind") == "direct").alias("n_direct"), F.count_if(F.col("kind") == "inherited").alias("n_inherited")
        )
        r = r.select(F.lit(k.table).alias("ref_table"), F.lit(k.field).alias("ref_field"), "month", "n_refs", "n_direct", "n_inherited", F.round(F.col("n_direct") / F.col("n_refs"), 6).alias("direct_rate"))
        out = r if out is None else out.unionByName(r)
    return out

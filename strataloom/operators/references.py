"""References to records that do not exist.

Tagged parent and child keys are put into one long form and grouped by parent table and key; the
groups without a parent row are the orphans. Counts are merged on the map side, so that a missing
key that a third of all rows name costs no more than any other.

Defined cases: a null reference is none; a null in the scope columns matches a null there; repeated
rows are reported one by one; an empty parent table makes every reference an orphan; an empty child
table gives no rows; columns beyond those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, checked_join, materialize


@dataclass(frozen=True)
class Reference:
    """child_table.field names parent_table.key within the scope columns."""

    child_table: str
    field: str
    parent_table: str
    key: str = "id"


def _long(tables: dict[str, DataFrame], refs: list[Reference], scope: list[str]) -> DataFrame:
    """One scan per table: a row per key (is_parent 1) or reference (is_parent 0, ref its number)."""
    parts = []
    for name, df in tables.items():
        tags = []
        for parent, key in dict.fromkeys((r.parent_table, r.key) for r in refs if r.parent_table == name):
            tags.append(F.struct(F.lit(f"{parent}.{key}").alias("parent"), F.col(key).cast("string").alias("key"), F.lit(1).alias("is_parent"), F.lit(-1).alias("ref")))
        for i, r in enumerate(refs):
            if r.child_table == name:
                tags.append(F.struct(F.lit(f"{r.parent_table}.{r.key}").alias("parent"), F.col(r.field).cast("string").alias("key"), F.lit(0).alias("is_parent"), F.lit(i).alias("ref")))
        if tags:
            parts.append(df.select(*scope, F.explode(F.array(*tags)).alias("_t")).select(*scope, "_t.*").where("key IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)


def orphan_keys(tables: dict[str, DataFrame], refs: list[Reference], scope: list[str]) -> DataFrame:
    """(parent, scope.., key, n0, n1, ..): the missing keys and how many rows of each reference name them."""
    counts = [F.sum((F.col("ref") == i).cast("long")).alias(f"n{i}") for i in range(len(refs))]
    grouped = _long(tables, refs, scope).groupBy("parent", *scope, "key").agg(F.max("is_parent").alias("has_parent"), *counts)
    return grouped.where("has_parent = 0").drop("has_parent")


def orphan_counts(tables: dict[str, DataFrame], refs: list[Reference], scope: list[str], period: list[str]) -> DataFrame:
    """(table_name, field_name, period.., orphan_rows, orphan_keys): references without a target by period."""
    rows = F.array(*[F.struct(F.lit(r.child_table).alias("table_name"), F.lit(r.field).alias("field_name"), F.col(f"n{i}").alias("n")) for i, r in enumerate(refs)])
    each = orphan_keys(tables, refs, scope).select(*period, F.explode(rows).alias("_r")).select(*period, "_r.*").where("n > 0")
    return each.groupBy("table_name", "field_name", *period).agg(F.sum("n").alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys"))


def orphan_rows(tables: dict[str, DataFrame], refs: list[Reference], scope: list[str], keep: list[str], limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(table_name, field_name, keep..): every row whose reference has no target.

    The missing keys are written once; they are broadcast if small, else joined with salt.
    """
    missing = materialize(orphan_keys(tables, refs, scope).select("parent", *[F.col(c).alias(f"_s{i}") for i, c in enumerate(scope)], "key"), "orphans")
    parts = []
    for name in dict.fromkeys(r.child_table for r in refs):
        fields = F.array(*[F.struct(F.lit(r.field).alias("field_name"), F.lit(f"{r.parent_table}.{r.key}").alias("parent"), F.col(r.field).cast("string").alias("key")) for r in refs if r.child_table == name])
        parts.append(tables[name].select(F.lit(name).alias("table_name"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], *[F.col(c).alias(f"_s{i}") for i, c in enumerate(scope)], F.explode(fields).alias("_f")).select("*", "_f.*").drop("_f").where("key IS NOT NULL"))
    # a null scope is its own value, which plain equality would not match
    def safe(df: DataFrame) -> DataFrame:
        return df.select("*", *[F.coalesce(F.concat(F.lit("="), F.col(f"_s{i}").cast("string")), F.lit("")).alias(f"_j{i}") for i in range(len(scope))]).drop(*[f"_s{i}" for i in range(len(scope))])

    joined = checked_join(safe(reduce(DataFrame.unionByName, parts)), safe(missing), ["parent", *[f"_j{i}" for i in range(len(scope))], "key"], "left_semi", [f"_k{i}" for i in range(len(keep))], limit_bytes)
    return joined.select("table_name", "field_name", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])

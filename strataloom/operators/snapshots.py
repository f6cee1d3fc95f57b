"""What changed between full snapshots.

Every row stands once as the later and once as the earlier side of a comparison; one aggregation
by comparison and key picks the current row of each side (highest order value) and classifies the
key by the two row hashes. Only the list of periods of each scope is joined in, never the data.

Defined cases: null ids and null scopes are left out; a null compared column equals only null; of repeated rows the
one with the highest order value counts; a scope with one period has no comparison; empty tables
give no rows; an id may stand in several scopes; columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, checked_join, materialize


def consecutive_periods(df: DataFrame, scope: str, period: str) -> DataFrame:
    """(scope, period, _prev, _next) for the periods for which df has rows of the scope."""
    w = Window.partitionBy(scope).orderBy(period)
    return df.select(scope, period).distinct().select(scope, period, F.lag(period).over(w).alias("_prev"), F.lead(period).over(w).alias("_next"))


def snapshot_changes(df: DataFrame, scope: str, period: str, key: str, compare: list[str], order_by: str, periods: DataFrame | None = None, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(scope, period, key, change): change is added, removed or changed; period is the later one.

    periods: rows that say which periods exist (df if None). order_by: numeric, higher wins.
    """
    known = materialize(consecutive_periods(df if periods is None else periods, scope, period), "periods")
    row_hash = F.xxhash64(*[x for c in compare for x in (F.col(c).isNull(), F.col(c))])
    rows = df.where(F.col(key).isNotNull() & F.col(scope).isNotNull()).select(scope, period, key, F.col(order_by).cast("long").alias("_o"), row_hash.alias("_h"))
    both = checked_join(rows, known.where(F.col(scope).isNotNull()), [scope, period], "inner", [key], limit_bytes)
    tagged = both.select(scope, key, "_o", "_h", F.explode(F.array(F.struct(F.when(F.col("_prev").isNotNull(), F.col(period)).alias("at"), F.lit(True).alias("later")), F.struct(F.col("_next").alias("at"), F.lit(False).alias("later")))).alias("_s")).where("_s.at IS NOT NULL")
    order = F.coalesce(F.col("_o"), F.lit(-(1 << 62)))
    sides = tagged.select(scope, F.col("_s.at").alias(period), key, F.when(F.col("_s.later"), F.col("_h")).alias("_h1"), F.when(F.col("_s.later"), order).alias("_o1"), F.when(~F.col("_s.later"), F.col("_h")).alias("_h0"), F.when(~F.col("_s.later"), order).alias("_o0"))
    one = sides.groupBy(scope, period, key).agg(F.max_by("_h1", "_o1").alias("now"), F.max_by("_h0", "_o0").alias("before"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed")
    return one.select(scope, period, key, change.alias("change")).where("change IS NOT NULL")


def current_rows(df: DataFrame, keys: list[str], order_by: str, values: list[str]) -> DataFrame:
    """The row of each keys with the highest order_by, columns keys and values; ties go to the greatest values."""
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(order_by).alias("_o"), *values)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{v}").alias(v) for v in values])

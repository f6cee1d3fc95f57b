"""Top N items within every group, by descending score bands.

The rows are written once, split into bands of the score whose sizes grow towards the bottom. From
the top band down, groups that already hold N items are anti-joined away, and what is left of a band
is ranked exactly with the tie rule. Large groups fill up in the small top bands, so the large lower
bands are read but hardly ranked or shuffled. Within a band each task keeps at most N rows of a
group before the shuffle, so a group of millions of equal scores costs no more than another.

Defined cases: rows with a null in a group column or the score are left out; repeated rows rank one
by one; nulls among the tie columns come last; NaN is the highest score; groups with fewer than N
rows are returned whole; an empty table gives no rows; columns beyond those named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, checked_join, discard, materialize

#: share of the rows that lies in the bands down to each edge; the last band holds the rest
BAND_SHARES = (1 / 64, 1 / 16, 1 / 4)


def band_edges(df: DataFrame, score: str, shares: tuple[float, ...] = BAND_SHARES) -> list[float]:
    """Lower edges of the bands from the top, without the last; found by a mergeable sketch."""
    found = df.agg(F.percentile_approx(F.col(score).cast("double"), [1 - s for s in shares], 1000)).first()[0]
    return sorted({x for x in found or [] if x == x}, reverse=True)


def top_n(df: DataFrame, group: list[str], score: str, ties: list[str], n: int, limit_bytes: int = BROADCAST_BYTES, edges: list[float] | None = None) -> DataFrame:
    """(group.., score, ties..) of the n rows of each group with the highest score, equal scores by ties ascending.

    edges: the lower edges of the bands from the top, found by band_edges(df) if None. They steer the
    work only, so those of a table that df comes from do as well and spare computing df twice.
    """
    columns = list(dict.fromkeys([*group, score, *ties]))
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*group, score]])).select(*columns)
    edges = band_edges(rows, score) if edges is None else edges
    band = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        band = F.when(F.col(score).cast("double") >= e, i).otherwise(band)
    banded = materialize(rows.withColumn("_band", band), "bands", ["_band"])
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), *[F.col(t).asc_nulls_last() for t in ties])
    done: list[DataFrame] = []
    for b in range(len(edges) + 1):
        part = banded.where(F.col("_band") == b).drop("_band")
        if done:
            have = materialize(reduce(DataFrame.unionByName, done).groupBy(*group).agg(F.count(F.lit(1)).alias("_have")), "band-state")
            part = checked_join(part, have.where(F.col("_have") >= n).select(*group), group, "left_anti", columns, limit_bytes)
        ranked = part.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
        if done:
            ranked = checked_join(ranked, have.where(F.col("_have") < n), group, "left", columns, limit_bytes).where(F.col("_rank") + F.coalesce("_have", F.lit(0)) <= n)
        done.append(materialize(ranked.select(*columns), "band-top"))
        if len(done) > 1:
            discard(have)
    discard(banded)
    return reduce(DataFrame.unionByName, done)

"""A few keys holding most records: two-stage salted aggregation.

Keys that may hold more than a given share are found by a frequent-items sketch, which never misses
one. Their rows take a salt and are aggregated by key and salt; the partial results are then merged
by key. All other keys keep salt 0. The salt is a hash of the row, so a task that is run again gives
the same rows.

Defined cases: a null key is a group of its own; a null value counts for nothing in sum, min and
max; an empty table gives no rows; key columns may be several; columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: stage one and stage two of each measure
_STAGES = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "max": (F.max, F.max), "min": (F.min, F.min)}


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """Values of key that may hold at least this share of the rows; at most 1 / share of them, none missed."""
    found = df.select(F.col(key).alias("k")).where("k IS NOT NULL").stat.freqItems(["k"], share).first()
    return sorted(found[0]) if found and found[0] else []


def salted_aggregate(df: DataFrame, key: str, measures: dict[str, tuple[str, Column | str]], salt_from: Sequence[str] | None = None, more_keys: Sequence[str] = (), heavy: list | None = None, share: float = 0.01, salts: int = 32) -> DataFrame:
    """(key, more_keys.., measures..) per key.

    measures: result name -> (count | sum | max | min, column). heavy: the keys to salt, found by
    heavy_keys(share) if None. salt_from: columns whose hash is the salt, all that can be hashed if None.
    """
    if heavy is None:
        heavy = heavy_keys(df, key, share)
    hashed = salt_from or [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    row_salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashed]), F.lit(salts)).cast("int")
    salt = F.when(F.col(key).isin(heavy), row_salt).otherwise(F.lit(0)) if heavy else F.lit(0)
    keys = [key, *more_keys]
    values = {name: (F.expr(c) if isinstance(c, str) else c) for name, (_, c) in measures.items()}
    inner = df.select(*keys, salt.alias("_salt"), *[v.alias(f"_v_{n}") for n, v in values.items()])
    one = inner.groupBy(*keys, "_salt").agg(*[_STAGES[f][0](F.col(f"_v_{n}")).alias(n) for n, (f, _) in measures.items()])
    return one.groupBy(*keys).agg(*[_STAGES[f][1](F.col(n)).alias(n) for n, (f, _) in measures.items()])


def outsize_keys(df: DataFrame, key: str, percent: int, salt_from: Sequence[str] | None = None) -> DataFrame:
    """(key, n_rows): non-null keys that hold at least percent % of all rows, null keys counted in the total."""
    total = df.count()
    counts = salted_aggregate(df, key, {"n_rows": ("count", F.lit(1))}, salt_from, share=percent / 200)
    return counts.where(F.col(key).isNotNull() & (F.col("n_rows") * 100 >= percent * total))

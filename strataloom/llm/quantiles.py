"""Percentiles with bounded error that merge: quantile digests over a dyadic tree.

The universe is every double in order: its 64 bits, with the sign turned, are the leaf of a value. A
digest is a set of tree nodes (level, prefix of so many bits) with counts; the root has level 0, a
leaf level 64. Compression moves counts of sparse siblings to their parent as long as no inner node
exceeds n / k; merging adds the counts of equal nodes. Whatever the merges, a reported value has a
rank within error * n of the asked one, which is not a matter of chance and holds for numbers of any
size: a value that many rows share keeps a leaf of its own.

Counts per distinct value are aggregated by Spark before a digest is built. A group of more distinct
values than a task should hold is cut by hash into parts, each is compressed, and the parts are added
and compressed again, in as many rounds as it takes.

Defined cases: numbers are compared as doubles, so that integers beyond 2^53 that share a double are
one value; null and NaN values are not counted; a null group is a group; a group without values gives
no digest; infinities are values; -0.0 is 0.0; an empty table gives no rows; columns beyond those
named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import discard, materialize

LEVELS = 64
#: Nodes of one group that a task compresses at once.
MOST_NODES = 1 << 20
_SIGN = np.uint64(1 << 63)


def codes_of(value: np.ndarray) -> np.ndarray:
    """The leaf of each double, as an unsigned number in the order of the values."""
    bits = (np.asarray(value, np.float64) + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def values_of(code: np.ndarray) -> np.ndarray:
    """The double of each leaf."""
    code = np.asarray(code, np.uint64)
    return np.where(code & _SIGN, code ^ _SIGN, ~code).view(np.float64)


def _families(prefix: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct parents of sorted prefixes, the place of each prefix among them, and their sums."""
    parent = prefix >> np.uint64(1)
    first = np.concatenate([[True], parent[1:] != parent[:-1]])
    place = np.cumsum(first) - 1
    return parent[first], place, np.bincount(place, count, int(place[-1]) + 1).astype(np.int64)


def compress(level: np.ndarray, prefix: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digest with counts moved up from the leaves wherever a family holds at most n // k."""
    most = int(count.sum()) // k
    order = np.lexsort((prefix, level))
    level, prefix, count = level[order], prefix[order], count[order]
    if most == 0:
        return level, prefix, count
    starts = np.searchsorted(level, np.arange(LEVELS + 2))
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ids, own = prefix[starts[LEVELS] :], count[starts[LEVELS] :]
    for d in range(LEVELS, 0, -1):
        above, above_c = prefix[starts[d - 1] : starts[d]], count[starts[d - 1] : starts[d]]
        if not len(ids):
            ids, own = above, above_c
            continue
        parent, place, total = _families(ids, own)
        at = np.minimum(np.searchsorted(above, parent), max(len(above) - 1, 0))
        there = np.where(above[at] == parent, above_c[at], 0) if len(above) else np.zeros(len(parent), np.int64)
        moves = total + there <= most
        stays = ~moves[place]
        if stays.any():
            kept.append((np.full(int(stays.sum()), d), ids[stays], own[stays]))
        both, both_c = np.concatenate([above, parent[moves]]), np.concatenate([above_c, total[moves]])
        ids, inverse = np.unique(both, return_inverse=True)
        own = np.bincount(inverse, both_c, len(ids)).astype(np.int64)
    kept.append((np.zeros(len(ids), np.int64), ids, own))
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def read_quantile(level: np.ndarray, prefix: np.ndarray, count: np.ndarray, probs: list[float]) -> tuple[np.ndarray, np.ndarray, int]:
    """Least and greatest leaf of the node at the given shares of the ranks, and the number of values."""
    shift = np.minimum(LEVELS - level, 63).astype(np.uint64)
    whole = level == 0
    low = np.where(whole, np.uint64(0), prefix << shift)
    high = np.where(whole, ~np.uint64(0), low + ((np.uint64(1) << shift) - np.uint64(1)))
    order = np.lexsort((-level, high))
    total = np.cumsum(count[order])
    rank = np.maximum(1, np.ceil(np.asarray(probs) * total[-1]))
    at = order[np.searchsorted(total, rank)]
    return low[at], high[at], int(total[-1])


def _by_group(df: DataFrame, keys: list[str], run: Callable[[np.ndarray, np.ndarray, np.ndarray, bool], dict[str, np.ndarray]], out: dict[str, str]) -> DataFrame:
    """(keys.., out..) of run(levels, prefixes, counts, whole) per group.

    Groups arrive sorted, many in a batch, so that small groups cost no call each. Keys travel as text.
    """
    types = {k: df.schema[k].dataType for k in keys}
    marked = df.select(F.to_json(F.struct(*keys)).alias("_g"), *[F.col(k).cast("string").alias(k) for k in keys], F.col("whole").alias("_whole"), F.col("node_level").cast("bigint").alias("node_level"), "node", "node_count")
    names = [*keys, *out]

    def groups(b: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        level, node, count = b["node_level"].to_numpy(np.int64), b["node"].to_numpy(np.int64).view(np.uint64), b["node_count"].to_numpy(np.int64)
        whole = b["_whole"].to_numpy(bool)
        made = [run(level[i:j], node[i:j], count[i:j], bool(whole[i])) for i, j in zip(starts, [*starts[1:], len(b)], strict=True)]
        rows = np.repeat(starts, [len(m[next(iter(out))]) for m in made])
        columns = {k: b[k].to_numpy()[rows] for k in keys} | {c: np.concatenate([m[c] for m in made]) for c in out}
        return pd.DataFrame(columns, columns=names)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in frames:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            g = b["_g"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
            held = b.iloc[starts[-1] :].reset_index(drop=True)
            if len(starts) > 1:
                yield groups(b.iloc[: starts[-1]], starts[:-1])
        if held is not None and len(held):
            yield groups(held, np.array([0]))

    ready = marked.repartition("_g").sortWithinPartitions("_g")
    done = ready.mapInPandas(batches, ", ".join([*(f"`{k}` string" for k in keys), *(f"{c} {t}" for c, t in out.items())]))
    return done.select(*[F.col(k).cast(types[k]).alias(k) for k in keys], *out)


def _compressed(nodes: DataFrame, group: list[str], k: int) -> DataFrame:
    """Each group compressed once; a task gets the nodes of a group, or of a part of it beyond MOST_NODES."""
    keys = [*group, "whole"]
    counts = F.sum("node_count").alias("node_count")
    nodes = materialize(nodes, "digest-nodes")

    def one(level: np.ndarray, prefix: np.ndarray, count: np.ndarray, _: bool) -> dict[str, np.ndarray]:
        level, prefix, count = compress(level, prefix, count, k)
        return {"node_level": level, "node": prefix.view(np.int64), "node_count": count}

    out = {"node_level": "bigint", "node": "bigint", "node_count": "bigint"}
    while True:
        most = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= MOST_NODES:
            return _by_group(nodes, keys, one, out)
        parts = -(-most // MOST_NODES)
        part = nodes.withColumn("_part", F.pmod(F.xxhash64("node_level", "node"), F.lit(parts)).cast("int"))
        smaller = materialize(_by_group(part, [*keys, "_part"], one, out).groupBy(*keys, "node_level", "node").agg(counts), "digest-nodes")
        if smaller.count() >= nodes.count():  # what is left can't be moved up
            return smaller
        discard(nodes)
        nodes = smaller


def _k(error: float) -> int:
    return int(np.ceil(LEVELS / error))


def digests(df: DataFrame, group: list[str], measures: dict[str, Column | str], error: float = 0.005) -> DataFrame:
    """(group.., measure, whole, node_level, node, node_count): a digest per group and measure, in long form.

    whole: the measure is of an integer type, so that reported values are whole numbers.
    """
    columns = {name: F.expr(c) if isinstance(c, str) else c for name, c in measures.items()}
    types = df.select(*[c.alias(n) for n, c in columns.items()]).schema
    entry = lambda n, c: F.struct(F.lit(n).alias("measure"), F.lit(isinstance(types[n].dataType, T.IntegralType)).alias("whole"), c.cast("double").alias("_x"))
    long = df.select(*group, F.explode(F.array(*[entry(n, c) for n, c in columns.items()])).alias("_v")).select(*group, "_v.*").where("_x IS NOT NULL AND NOT isnan(_x)")
    counted = long.groupBy(*group, "measure", "whole", "_x").agg(F.count(F.lit(1)).alias("node_count"))
    return _compressed(_leaves(counted), [*group, "measure"], _k(error))


def _leaves(counted: DataFrame) -> DataFrame:
    """Distinct values with counts as leaves of the tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="_x").assign(node=codes_of(b["_x"].to_numpy(np.float64)).view(np.int64))

    keys = [f for f in counted.schema.fields if f.name not in ("_x", "node_count")]
    fields = T.StructType([T.StructField(f.name, T.StringType() if f.name != "whole" else f.dataType) for f in keys] + [T.StructField("node_count", T.LongType()), T.StructField("node", T.LongType())])
    asked = counted.select(*[F.col(f.name).cast("string").alias(f.name) if f.name != "whole" else F.col(f.name) for f in keys], "node_count", "_x")
    done = asked.mapInPandas(run, fields)
    return done.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in keys], F.lit(LEVELS).alias("node_level"), "node", "node_count")


def merge(parts: DataFrame, group: list[str], error: float = 0.005) -> DataFrame:
    """Digests of coarser groups (group is some of the group columns of parts), by adding the counts of equal nodes."""
    added = parts.groupBy(*group, "measure", "whole", "node_level", "node").agg(F.sum("node_count").alias("node_count"))
    return _compressed(added, [*group, "measure"], _k(error))


def percentiles(parts: DataFrame, group: list[str], probs: list[float], error: float = 0.005) -> DataFrame:
    """(group.., measure, p, value, value_low, n, max_rank_error) of each digest.

    value is the greatest value of the node found, value_low the least.
    """
    keys = [*group, "measure"]

    def one(level: np.ndarray, prefix: np.ndarray, count: np.ndarray, whole: bool) -> dict[str, np.ndarray]:
        low, high, n = read_quantile(level, prefix, count, probs)
        low, high = values_of(low), values_of(high)
        # the codes beyond the infinities are no numbers
        low, high = np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)
        if whole:
            low, high = np.ceil(low), np.floor(high)
        return {"p": np.array(probs, float), "value": high, "value_low": low, "n": np.full(len(probs), n), "max_rank_error": np.full(len(probs), int(error * n))}

    return _by_group(parts, keys, one, {"p": "double", "value": "double", "value_low": "double", "n": "bigint", "max_rank_error": "bigint"})


def true_ranks(df: DataFrame, found: DataFrame, group: list[str], measures: dict[str, Column | str]) -> DataFrame:
    """(group.., measure, p, n, rank_low, rank_high, within): the true ranks of reported values, counted over df.

    rank_low rows are below value, rank_high at most value; within: the asked rank is no further from
    that range than max_rank_error. A group's few reported values are one row that the rows are counted against.
    """
    entry = lambda n, c: F.struct(F.lit(n).alias("measure"), (F.expr(c) if isinstance(c, str) else c).cast("double").alias("_x"))
    long = df.select(*group, F.explode(F.array(*[entry(n, c) for n, c in measures.items()])).alias("_v")).select(*group, "_v.*").where("_x IS NOT NULL AND NOT isnan(_x)")
    counted = long.groupBy(*group, "measure", "_x").agg(F.count(F.lit(1)).alias("_c"))
    keys = [*group, "measure"]
    safe = lambda d: d.select("*", F.to_json(F.struct(*keys)).alias("_key"))
    asked = safe(found).groupBy("_key").agg(F.collect_list(F.struct("p", "value", "n", "max_rank_error")).alias("_asked"), *[F.first(k).alias(k) for k in keys])
    joined = safe(counted).select("_key", "_x", "_c").join(asked, "_key").select(*keys, "_x", "_c", F.explode("_asked").alias("_a")).select(*keys, "_a.*", "_x", "_c")
    ranks = joined.groupBy(*keys, "p", "value", "n", "max_rank_error").agg(F.sum(F.when(F.col("_x") < F.col("value"), F.col("_c")).otherwise(0)).alias("rank_low"), F.sum(F.when(F.col("_x") <= F.col("value"), F.col("_c")).otherwise(0)).alias("rank_high"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n")))
    return ranks.select(*keys, "p", "n", "rank_low", "rank_high", ((rank >= F.col("rank_low") + 1 - F.col("max_rank_error")) & (rank <= F.col("rank_high") + F.col("max_rank_error"))).alias("within"))

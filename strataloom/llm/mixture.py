"""Mixing sources to target weights by fitting token budgets.

Documents are counted by source and exact token length. The largest mixture that no source falls
short of sets each source's budget; whole passes over a source are taken first. For the rest of a
budget every length gives its even share of documents, and a bounded knapsack over the counts by length
closes the gap that is left, to the token where any subset can. Which documents of a length are used
is set by a seeded hash.

A task of the fit gets the counts of one source: a row per distinct length, not per document. The
documents of one source and length are ranked in hash buckets of bounded size.

Defined cases: null and empty texts have no tokens and are not used; sources that are null, have no
target, or a target of 0 are not used; targets of sources without tokens are shared out among the
others in proportion and reported with 0 reached; max_repeats null or below 1 counts as 0; repeated
rows are documents of their own; if the targets name a source twice, that is an error; empty tables
give no rows; columns beyond those named are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import checked_join, materialize, spread

#: Folder of the public tokenizer files.
TOKENIZERS = "/opt/tokenizers"
#: Tokens of the gap that the knapsack closes.
GAP = 1 << 15
#: Documents of one source and length that are ranked in one task, on average.
RANKED = 20_000
#: How the public byte-pair vocabularies split a text into pieces, as published with them.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _vocabulary(folder: str, name: str) -> dict[bytes, int]:
    with open(f"{folder}/{name}", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken", keep: tuple[str, ...] = ("doc_id", "source"), pattern: str = PATTERN) -> DataFrame:
    """(keep.., tokens): the tokens of each whole text under a public byte-pair vocabulary, 0 for null."""
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(_vocabulary(folder, name))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        coder = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for b in batches:
            out = b[list(keep)]
            yield out.assign(tokens=[len(coder.encode_ordinary(t)) if t else 0 for t in b["text"]])

    # ids travel through Python as text, which keeps every digit
    asked = spread(documents.select(*[F.col(c).cast("string").alias(c) for c in keep], "text"))
    counted = asked.mapInPandas(count, ", ".join(f"{c} string" for c in keep) + ", tokens bigint")
    return counted.select(*[F.col(c).cast(documents.schema[c].dataType).alias(c) for c in keep], "tokens")


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """length -> how many, with the greatest total not above budget and no more than counts of each."""
    reach, steps = 1, []
    mask = (1 << (budget + 1)) - 1
    for size, spare in zip(lengths, counts, strict=True):
        spare, piece = min(spare, budget // size if size else 0), 1
        while spare > 0 and not reach >> budget & 1:
            piece = min(piece, spare)
            after = (reach | reach << (size * piece)) & mask
            if after != reach:
                steps.append((reach, size, piece))
                reach = after
            spare, piece = spare - piece, piece * 2
    at, used = reach.bit_length() - 1, {}
    for before, size, piece in reversed(steps):
        if not before >> at & 1:
            used[size] = used.get(size, 0) + piece
            at -= size * piece
    return used


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int, gap: int = GAP) -> np.ndarray:
    """How many documents of each length to take so that their tokens come up to budget, never above."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((lengths * take).sum())
    for k in np.random.default_rng(seed).permutation(len(lengths)):
        if left <= gap:
            break
        if take[k] < counts[k] and lengths[k] <= left:
            take[k] += 1
            left -= int(lengths[k])
    # short lengths last, as they close the gap
    fits = np.flatnonzero((lengths <= left) & (take < counts))[::-1]
    for size, n in knapsack([int(lengths[k]) for k in fits], [int(counts[k] - take[k]) for k in fits], left).items():
        take[np.searchsorted(lengths, size)] += n
    return take


def _plan(totals: DataFrame, total_tokens: int | None) -> DataFrame:
    """(source, passes, rest): whole passes and tokens beyond them, per source that is used; two sums go to the driver."""
    live = totals.where("tokens > 0 AND repeats > 0 AND target_share > 0")
    room = F.col("tokens").cast("double") * F.col("repeats")
    whole, least = live.agg(F.sum("target_share"), F.min(room / F.col("target_share"))).first()
    size = (least or 0.0) * (whole or 0.0) if total_tokens is None else float(total_tokens)
    budget = F.least(F.col("tokens") * F.col("repeats"), F.rint(F.lit(size) * (F.col("target_share") / F.lit(whole or 1.0))).cast("bigint"))
    return live.select("source", budget.alias("budget"), "tokens").select("source", F.expr("budget div tokens").alias("passes"), (F.col("budget") % F.col("tokens")).alias("rest"))


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: doc_id, source, tokens, uses (how often the document is used, at most max_repeats).
    shares: source, target_share, max_repeats, available_tokens, mixed_tokens, actual_share.
    documents: doc_id, source, text. targets: source, target_share, max_repeats. total_tokens: size of
    the mixture, the largest that keeps the shares if None; a source that can't fill its budget then
    gives all it may. sized: doc_id, source, tokens, if they are counted already.
    """
    sized = materialize(token_counts(documents) if sized is None else sized, "sized")
    goal = targets.select("source", "target_share", F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("repeats")).where("source IS NOT NULL")
    per_length = sized.where("tokens > 0 AND source IS NOT NULL").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n"))
    lengths = materialize(per_length, "lengths")
    sums = lengths.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("tokens"))
    totals = materialize(goal.join(sums, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))), "totals")
    if totals.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("the targets name a source twice")
    plan = _plan(totals, total_tokens)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("tokens")
        take = fit_lengths(rows["tokens"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), int(rows["rest"].iloc[0]), seed)
        return rows[["source", "tokens", "n", "passes"]].assign(take=take)

    fitted = checked_join(lengths, plan, ["source"]).groupBy("source").applyInPandas(fit, "source string, tokens bigint, n bigint, passes bigint, take bigint")
    quotas = materialize(fitted.withColumn("buckets", F.ceil(F.col("n") / RANKED)), "quotas")
    order = F.xxhash64(F.lit(seed), "doc_id")
    rows = checked_join(sized, quotas, ["source", "tokens"], "inner", ["doc_id"]).withColumn("_h", order)
    rows = rows.withColumn("_bucket", F.floor(F.pmod("_h", F.lit(1 << 40)) * F.col("buckets") / F.lit(float(1 << 40))))
    bucket = ["source", "tokens", "_bucket"]
    sizes = rows.where("take > 0 AND take < n").groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source", "tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "buckets")
    joined = checked_join(rows, sizes, bucket, "left", ["doc_id"])
    need = F.col("take") - F.col("_before")
    sure = F.when(F.col("take") == 0, 0).when(F.col("take") >= F.col("n"), 1).when(need >= F.col("_n"), 1).when(need <= 0, 0)
    marked = joined.withColumn("_extra", sure)
    rank = F.row_number().over(Window.partitionBy(*bucket).orderBy("_h", "doc_id"))
    edge = marked.where("_extra IS NULL").withColumn("_extra", (rank <= need).cast("int"))
    uses = (F.col("passes") + F.col("_extra")).alias("uses")
    chosen = marked.where("_extra IS NOT NULL").select("doc_id", "source", "tokens", uses).unionByName(edge.select("doc_id", "source", "tokens", uses)).where("uses > 0")
    mixed = quotas.groupBy("source").agg(F.sum(F.col("tokens") * (F.col("n") * F.col("passes") + F.col("take"))).alias("mixed_tokens"))
    whole = mixed.agg(F.sum("mixed_tokens")).first()[0] or 0
    available = totals.select("source", "target_share", F.col("repeats").cast("bigint").alias("max_repeats"), F.col("tokens").alias("available_tokens"))
    reached = F.coalesce("mixed_tokens", F.lit(0))
    shares = available.join(mixed, "source", "left").select("source", "target_share", "max_repeats", "available_tokens", reached.alias("mixed_tokens"), F.when(F.lit(whole > 0), reached / F.lit(float(whole or 1))).otherwise(0.0).alias("actual_share"))
    return chosen, shares

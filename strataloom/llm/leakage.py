"""Evaluation texts leaking into training text, by greedy string tiling.

The corpus is read once, whatever the size of the evaluation set, and split into words once. Seeds are
runs of min_words words. A set of items up to block_bytes is sent to the tasks as a table of seeds, and
documents are never shuffled. A larger set becomes a table of seeds keyed by two 64-bit hashes; a filter
of fixed size, in which every seed has a bit, lets the tasks drop the runs of the corpus that are in no
item, and the rest is joined to the seeds, keys that hold much of them with salt.

For each pair with a common seed, greedy string tiling marks the longest common run of unmarked words,
again and again, until no run of min_words is left. The tiles found cover a part of the item; reordered
passages give several tiles. All words of a text are looked at.

Defined cases: null and empty texts hold no words; items shorter than min_words can't leak; repeated
items are tiled once; repeated documents are reported each; empty tables give no rows; columns beyond
those named are ignored.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checked_join, materialize, spread

#: Text bytes of the evaluation items up to which all their seeds are sent to the tasks.
BLOCK_BYTES = 8 << 20
#: Bits of the filter for larger sets; it is 32 MB whatever their size.
FILTER_BITS = 1 << 28
_WORD = re.compile(r"[^\W_]+")
_DROPPED = dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC, removal of invisible characters and lower-casing."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_DROPPED)
    return _WORD.findall(text.lower())


def _rolling(ids: np.ndarray, m: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of every run of m words."""
    n = len(ids) - m + 1
    h = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(m):
            h = h * base + ids[j : j + n].astype(np.uint64)
            h ^= h >> np.uint64(29)
    return h


class Seeds:
    """The seed table of one block of items."""

    def __init__(self, items: list[tuple[str | None, str]], m: int):
        self.m, self.vocabulary = m, {}
        parts, self.item_ids, starts, at = [], [], [], 0
        for item_id, text in items:
            words = words_of(text)
            if len(words) >= m:
                parts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
                self.item_ids.append(item_id)
                starts.append(at)
                at += len(words)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.starts = np.array([*starts, at], np.int64)
        places = np.concatenate([np.arange(s, s + len(p) - m + 1) for s, p in zip(starts, parts, strict=True)]) if parts else np.zeros(0, np.int64)
        hashes = np.concatenate([_rolling(p, m) for p in parts]) if parts else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], places[order]

    def matches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All (place in the document, place in the item words) where a run of m words is the same."""
        known = self.vocabulary
        ids = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
        none = np.zeros(0, np.int64)
        if len(ids) < self.m or not len(self.hashes):
            return none, none
        # runs of m words that all occur in the items
        alien = np.concatenate([[0], np.cumsum(ids == 0)])
        at = np.flatnonzero(alien[self.m :] == alien[: -self.m])
        if not len(at):
            return none, none
        h = _rolling(ids, self.m)[at]
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        count = high - low
        if not count.any():
            return none, none
        doc = np.repeat(at, count)
        item = self.places[np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
        same = np.ones(len(doc), bool)
        for j in range(self.m):
            same &= ids[doc + j] == self.words[item + j]
        return doc[same], item[same]


def tiles(doc: np.ndarray, item: np.ndarray, m: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from the seed matches of one pair: (place in doc, place in item, length) by length.

    Of equally long matches the first in the item, then in the document, is marked first.
    """
    order = np.lexsort((doc, doc - item))
    doc, item = doc[order], item[order]
    breaks = np.flatnonzero((np.diff(doc) != 1) | (np.diff(item) != 1)) + 1
    first, last = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(doc)]]) - 1
    todo = [(-(int(doc[b]) - int(doc[a]) + m), int(item[a]), int(doc[a])) for a, b in zip(first, last, strict=True)]
    heapq.heapify(todo)
    base_d, base_i = int(doc.min()), int(item.min())
    used_d = np.zeros(int(doc.max()) - base_d + m, bool)
    used_i = np.zeros(int(item.max()) - base_i + m, bool)
    found = []
    while todo:
        size, i, d = heapq.heappop(todo)
        size = -size
        taken = used_d[d - base_d : d - base_d + size] | used_i[i - base_i : i - base_i + size]
        if not taken.any():
            used_d[d - base_d : d - base_d + size] = True
            used_i[i - base_i : i - base_i + size] = True
            found.append((d, i, size))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], taken, [1]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= m:
                heapq.heappush(todo, (-int(b - a), i + int(a), d + int(a)))
    return found


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_tiles, longest, covered, item_words, coverage) of every pair that shares min_words words in a row.

    documents: doc_id, text. items: item_id, text. coverage: the share of the item's words in tiles.
    """
    spark = documents.sparkSession
    texts = items.select("item_id", "text").where("text IS NOT NULL").dropDuplicates()
    size = int(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    # ids travel through Python as text, which keeps every digit
    rows = spread(documents.select(F.col("doc_id").cast("string"), "text").where("text IS NOT NULL"))
    if size <= block_bytes:
        block = texts.orderBy("item_id").collect()
        shared = spark.sparkContext.broadcast(Seeds([(None if r[0] is None else str(r[0]), r[1]) for r in block], min_words))
        found = rows.mapInPandas(_tiler(shared, min_words), _FOUND)
    else:
        found = _by_join(rows, texts, min_words)
    return found.withColumns({"doc_id": F.col("doc_id").cast(documents.schema["doc_id"].dataType), "item_id": F.col("item_id").cast(items.schema["item_id"].dataType)})


_FOUND = "doc_id string, item_id string, n_tiles int, longest int, covered int, item_words int, coverage double"
_SEED = "id string, at int, h1 bigint, h2 bigint, n_words int"


def _runs(m: int, bits=None):
    """Rows (id, at, h1, h2, n_words) of the runs of m words of each text, those without a bit in the filter left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            out = []
            for key, text in zip(b["id"], b["text"], strict=True):
                words = words_of(text)
                if len(words) < m:
                    continue
                for w in words:
                    if w not in known:
                        if len(known) > 500_000:
                            known.clear()
                        known[w] = xxhash.xxh3_64_intdigest(w)
                ids = np.array([known.get(w) or xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
                h = _rolling(ids, m)
                at = np.arange(len(h))
                if bits is not None:
                    place = h % np.uint64(FILTER_BITS)
                    at = np.flatnonzero(bits.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1))
                if len(at):
                    out.append(pd.DataFrame({"id": key, "at": at.astype(np.int32), "h1": h[at].view(np.int64), "h2": _rolling(ids, m, _SECOND)[at].view(np.int64), "n_words": np.int32(len(words))}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": [], "at": [], "h1": [], "h2": [], "n_words": []}).astype({"id": str, "at": "int32", "h1": "int64", "h2": "int64", "n_words": "int32"})

    return run


def _by_join(rows: DataFrame, texts: DataFrame, m: int) -> DataFrame:
    """leaks by a filter and a join. A run of words is known by its two hashes, 128 bits."""
    spark = rows.sparkSession
    # a row is known by its number and id, as ids may be null or stand twice
    numbered = lambda df, key: df.select(F.to_json(F.struct(F.monotonically_increasing_id().alias("r"), F.col(key).cast("string").alias("k"))).alias("id"), "text")
    seeds = materialize(numbered(spread(texts), "item_id").mapInPandas(_runs(m), _SEED), "seeds")
    # the unsigned hash modulo a power of two is its low bits
    place = F.col("h1").bitwiseAND(FILTER_BITS - 1)
    words = seeds.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)
    hits = materialize(numbered(rows, "doc_id").mapInPandas(_runs(m, shared), _SEED), "seed-hits")
    joined = checked_join(hits.select("id", F.col("at").alias("d"), "h1", "h2"), seeds.select(F.col("id").alias("item_id"), F.col("at").alias("i"), "h1", "h2", "n_words"), ["h1", "h2"], "inner", ["id", "d"])

    def tile(pair: pd.DataFrame) -> pd.DataFrame:
        found = tiles(pair["d"].to_numpy(np.int64), pair["i"].to_numpy(np.int64), m)
        n_words, covered = int(pair["n_words"].iloc[0]), sum(t[2] for t in found)
        return pd.DataFrame([(pair["id"].iloc[0], pair["item_id"].iloc[0], len(found), found[0][2], covered, n_words, covered / n_words)], columns=[c.split()[0] for c in _FOUND.split(", ")])

    key = lambda c: F.get_json_object(c, "$.k").alias(c)
    return joined.groupBy("id", "item_id").applyInPandas(tile, _FOUND).withColumns({"doc_id": key("doc_id"), "item_id": key("item_id")})


def _tiler(shared, m: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = shared.value
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                doc, item = seeds.matches(words_of(text))
                if not len(doc):
                    continue
                number = np.searchsorted(seeds.starts, item, "right") - 1
                for k in np.unique(number):
                    mine = number == k
                    found = tiles(doc[mine], item[mine], m)
                    n_words = int(seeds.starts[k + 1] - seeds.starts[k])
                    covered = sum(t[2] for t in found)
                    out.append((doc_id, seeds.item_ids[k], len(found), found[0][2], covered, n_words, covered / n_words))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_tiles", "longest", "covered", "item_words", "coverage"])

    return run

"""Personal information inside free text: found, and replaced by typed placeholders.

High-recall generators propose overlapping spans of five kinds (pii_candidates). Boosted trees, one
forest per kind, judge each span by its format and context; their scores are calibrated on held-out
rows, where the thresholds are set as well. Of the spans above their threshold the most probable are
taken first, none overlapping another; addresses for mail go before names.

The forests are fitted on the driver on a bounded labelled sample (pii_sample); part of the known
names is hidden from the features meanwhile, as the list is not complete. The corpus is read once,
without a shuffle, and whole texts are judged.

Defined cases: null texts stay null and hold nothing, empty texts stay empty; line ends and all text
outside the spans stay as they are; repeated documents are each judged; an empty table gives no rows;
columns beyond those named are ignored; an empty list of names is allowed.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import estimated_bytes, spread
from .boosting import Forest, calibrate, fit
from .pii_candidates import KINDS, NameStats, candidates, fold
from .pii_sample import Sampler

#: Documents of the labelled sample.
SAMPLE = 3000
#: Bytes the list of names may have, as every task gets it.
NAMES_BYTES = 32 << 20
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
_FIRST = {"email": 0, "id_number": 1, "phone": 1, "address": 1, "name": 2}


@dataclass
class Detector:
    """Forests and thresholds by kind, and what the list of names says about words."""

    forests: dict[str, Forest]
    thresholds: dict[str, float]
    stats: NameStats

    def spans(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, probability) in the order of the text."""
        scored = []
        for kind, found in candidates(text, self.stats).items():
            if found and kind in self.forests:
                p = self.forests[kind].probability(np.array([f for _, _, f in found], float))
                scored += [(a, b, kind, float(x)) for (a, b, _), x in zip(found, p, strict=True) if x >= self.thresholds[kind]]
        return _without_overlaps(scored)

    def spans_of(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """spans for many texts, scored together."""
        scored: list[list] = [[] for _ in texts]
        every: dict[str, list] = {k: [] for k in KINDS}
        for i, text in enumerate(texts):
            if text:
                for kind, found in candidates(text, self.stats).items():
                    every[kind] += [(i, a, b, f) for a, b, f in found]
        for kind, found in every.items():
            if found and kind in self.forests:
                p = self.forests[kind].probability(np.array([f for *_, f in found], float))
                for (i, a, b, _), x in zip(found, p, strict=True):
                    if x >= self.thresholds[kind]:
                        scored[i].append((a, b, kind, float(x)))
        return [_without_overlaps(s) for s in scored]


def _without_overlaps(scored: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    taken: list[tuple[int, int, str, float]] = []
    for s in sorted(scored, key=lambda s: (_FIRST[s[2]], -round(s[3], 3), s[0] - s[1], s[0])):
        k = bisect.bisect_left(taken, (s[0],))
        if (k == 0 or taken[k - 1][1] <= s[0]) and (k == len(taken) or taken[k][0] >= s[1]):
            taken.insert(k, s)
    return taken


def train(names: list[tuple[str, str]], sample: int = SAMPLE, seed: int = 11) -> Detector:
    """Fits the detector on a labelled sample of so many documents. names: (text, given | family)."""
    given = sorted({n for n, part in names if n and part == "given"})
    family = sorted({n for n, part in names if n and part == "family"})
    r = random.Random(seed)
    shown = [{fold(n) for n in part if r.random() < 0.65} for part in (given, family)]
    sampler, stats = Sampler(given, family, seed), NameStats(*shown)
    rows: dict[str, tuple[list, list, list]] = {k: ([], [], []) for k in KINDS}
    for i in range(sample):
        text, spans = sampler.document()
        true = set(spans)
        for kind, found in candidates(text, stats).items():
            x, y, held = rows[kind]
            for a, b, f in found:
                x.append(f)
                y.append((a, b, kind) in true)
                held.append(i % 4 == 0)
    forests, thresholds = {}, {}
    for kind, (x, y, held) in rows.items():
        x, y, held = np.array(x, float), np.array(y, float), np.array(held)
        if len(x) and 0 < y.sum() < len(y):
            forests[kind], thresholds[kind] = calibrate(fit(x[~held], y[~held]), x[held], y[held])
    return Detector(forests, thresholds, NameStats({fold(n) for n in given}, {fold(n) for n in family}))


_TRAINED: dict[tuple, Detector] = {}


def detector_for(names: DataFrame, sample: int = SAMPLE) -> Detector:
    """The detector for a table of known names (name_text, name_part), fitted once per list and process."""
    known = names.select("name_text", "name_part").where("name_text IS NOT NULL AND name_part IS NOT NULL").distinct()
    if estimated_bytes(known) > NAMES_BYTES:
        raise ValueError("the list of names is larger than every task can hold")
    key = (sample, tuple(sorted(map(tuple, known.collect()))))
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = train(list(key[1]), sample)
    return _TRAINED[key]


def redact(documents: DataFrame, names: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, found array<struct<kind, at, found_text>>): texts with placeholders, and what they replace."""
    shared = documents.sparkSession.sparkContext.broadcast(detector_for(names, sample))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = shared.value
        for b in batches:
            texts, found = [], []
            for text, spans in zip(b["text"], detector.spans_of(list(b["text"])), strict=True):
                pieces, at = [], 0
                for a, e, kind, _ in spans:
                    pieces += [text[at:a], PLACEHOLDERS[kind]]
                    at = e
                texts.append(None if text is None else "".join(pieces) + text[at:])
                found.append([{"kind": k, "at": a, "found_text": text[a:e]} for a, e, k, _ in spans])
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts, "found": found})

    # ids travel through Python as text, which keeps every digit
    out = spread(documents.select(F.col("doc_id").cast("string"), "text")).mapInPandas(run, "doc_id string, text string, found array<struct<kind:string,at:int,found_text:string>>")
    return out.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))


def found_in(redacted: DataFrame) -> DataFrame:
    """(doc_id, kind, found_text): each distinct text found, per document and kind; doc_id is unique."""
    distinct = F.array_distinct(F.transform("found", lambda f: F.struct(f["kind"].alias("kind"), f["found_text"].alias("found_text"))))
    return redacted.select("doc_id", F.explode(distinct).alias("f")).select("doc_id", "f.kind", "f.found_text")


def restored(redacted: DataFrame) -> DataFrame:
    """(doc_id, text): redacted texts with what was found put back; as the spans stand in order, each is at its old place when its turn comes."""
    marks = F.create_map(*[F.lit(x) for k, m in PLACEHOLDERS.items() for x in (k, len(m))])
    put = lambda text, f: F.concat(F.substring(text, F.lit(1), f["at"]), f["found_text"], F.substr(text, f["at"] + 1 + F.try_element_at(marks, f["kind"])))
    return redacted.select("doc_id", F.aggregate("found", F.col("text"), put).alias("text"))

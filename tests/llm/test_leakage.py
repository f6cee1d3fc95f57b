import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm.leakage import leaks, tiles, words_of

from ..conftest import rows

M = 8


def _brute(docs, items):
    found = set()
    for d, text in docs:
        w = words_of(text)
        have = {tuple(w[k : k + M]) for k in range(len(w) - M + 1)}
        for i, item in items:
            v = words_of(item)
            if any(tuple(v[k : k + M]) in have for k in range(len(v) - M + 1)):
                found.add((d, i))
    return sorted(found, key=str)


def test_words():
    assert words_of("Ｔｅ​st—x2_y ﬁn­e! ÉTÉ") == ["test", "x2", "y", "fine", "été"]
    assert words_of(None) == words_of("") == words_of("_-…") == []


def _corpus():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([3, 8, 9, 20, 40])))) for i in range(30)] + [(30, None), (31, ""), (3, "a b c d e f g h"), (3, "a b c d e f g h")]
    docs = []
    for d in range(120):
        w = r.choices(vocabulary, k=r.choice([0, 5, 60]))
        if d % 3 == 0:
            v = words_of(r.choice(items)[1])
            a = r.randint(0, max(0, len(v) - 8))
            w += v[a : a + r.choice([7, 8, 12])] + r.choices(vocabulary, k=3)
        docs.append((d, r.choice([" ", " ", " - ", "\r\n"]).join(w)))
    return [*docs, (500, None), (501, ""), (502, "A, b. C d e-f (g) h"), (502, "A, b. C d e-f (g) h"), (None, "a b c d e f g h"), (503, "a b c d e f g " * 40_000 + "h")], items


def test_found_pairs_equal_brute_force(spark):
    docs, items = _corpus()
    d = spark.createDataFrame([(*x, "t") for x in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, doc_id int")
    want = _brute(docs, items)
    got = rows(leaks(d, i).select("doc_id", "item_id"))
    assert sorted(set(got), key=str) == want and len(want) > 15
    assert rows(leaks(d, i, block_bytes=0)) == rows(leaks(d, i))


def test_reordered_passages_are_covered(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen sixteen"
    d = spark.createDataFrame([(1, f"x {b} y {a} z"), (2, f"{a} nine ten")], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, f"{a} {b}")], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in leaks(d, i).collect()}
    assert (got[1]["n_tiles"], got[1]["covered"], got[1]["coverage"]) == (2, 16, 1.0)
    assert (got[2]["n_tiles"], got[2]["longest"], got[2]["coverage"]) == (1, 10, 10 / 16)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id bigint, text string")
    i = d.withColumnRenamed("doc_id", "item_id")
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0


def _greedy(doc, item, m):
    """Tiling by definition: the longest unmarked common run first; the first in the item, then in the document."""
    used_d, used_i, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and not used_i[i + k] and not used_d[d + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, d)
        if best[0] < m:
            return out
        k, i, d = best
        for x in range(k):
            used_i[i + x] = used_d[d + x] = True
        out.append((d, i, k))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25), st.integers(2, 4))
def test_tiles_equal_the_definition(doc, item, m):
    pairs = [(d, i) for d in range(len(doc) - m + 1) for i in range(len(item) - m + 1) if doc[d : d + m] == item[i : i + m]]
    got = tiles(*(np.array(x) for x in zip(*pairs, strict=True)), m) if pairs else []
    assert got == _greedy(doc, item, m)

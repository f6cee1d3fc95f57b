import random

import numpy as np
import pytest

from strataloom.llm import quantiles
from strataloom.llm.quantiles import LEVELS, codes_of, compress, digests, merge, percentiles, read_quantile, true_ranks, values_of
from strataloom.llm.topn import top_n

from ..conftest import rows


def _top(data, n):
    out, groups = [], {}
    for g, s, i, r in data:
        if g is not None and s is not None:
            groups.setdefault(g, []).append((s, i, r))
    for g, own in groups.items():
        own.sort(key=lambda x: (-x[0], x[1] is None, x[1] or "", x[2] is None, x[2] or ""))
        out += [(g, s, i, r) for s, i, r in own[:n]]
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_top_n_with_ties_nulls_and_a_hot_group(spark, limit):
    r = random.Random(3)
    data = [(r.choice(["hot", "hot", "hot", "a", "b", "c", None]), r.choice([None, *range(12)]), r.choice(["p", "q", "é", "Z", None]), r.choice(["x", "y"])) for _ in range(1500)] + [("one", 1, "i", "x"), ("low", 0, "i", "x"), ("low", 0, "i", "x")]
    df = spark.createDataFrame([(*d, 1, 2) for d in data], "g string, s bigint, i string, r string, _rank int, _band int")
    assert rows(top_n(df, ["g"], "s", ["i", "r"], 4, limit)) == _top(data, 4)


def test_top_n_of_equal_scores_and_of_nothing(spark):
    df = spark.createDataFrame([("g", 1, f"{i:04d}") for i in range(500)], "g string, s bigint, i string")
    assert [x[2] for x in rows(top_n(df, ["g"], "s", ["i"], 3))] == ["0000", "0001", "0002"]
    assert top_n(df.limit(0), ["g"], "s", ["i"], 3).count() == 0


def test_codes_keep_order_and_value():
    r = np.random.default_rng(2)
    values = np.unique(np.concatenate([[0.0, 1, -1, 2.0**53, 1e308, -1e308, 5e-324, np.inf, -np.inf], r.normal(size=500), r.integers(-(10**9), 10**9, 500)]))
    codes = codes_of(values)
    assert (codes[1:] > codes[:-1]).all() and (values_of(codes) == values).all() and codes_of(np.array([-0.0])) == codes_of(np.array([0.0]))


def _of(values):
    leaf, count = np.unique(codes_of(np.asarray(values, float)), return_counts=True)
    return np.full(len(leaf), LEVELS), leaf, count


@pytest.mark.parametrize("make", [lambda r: r.integers(10**6 - 200, 10**6 + 200, 5000), lambda r: r.random(5000), lambda r: r.pareto(1, 5000) * 10, lambda r: r.normal(size=5000) * 10.0 ** r.integers(-30, 30, 5000), lambda r: np.full(5000, 7), lambda r: r.integers(0, 3, 5000)])
def test_compressed_digests_keep_ranks_within_the_bound(make):
    r, k, parts, every = np.random.default_rng(5), 640, [], []
    for _ in range(6):
        v = make(r)
        part = compress(*_of(v), k)
        assert part[2].sum() == 5000 and len(part[0]) <= 3 * k + LEVELS
        parts.append(part)
        every.append(v)
    level, prefix, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, back = np.unique(np.stack([level.astype(np.uint64), prefix]), axis=1, return_inverse=True)
    node = compress(ids[0].astype(np.int64), ids[1], np.bincount(back.ravel(), count).astype(np.int64), k)
    values = np.sort(np.concatenate(every).astype(float))
    for p in (0.01, 0.5, 0.9, 0.99, 1.0):
        _, high, n = read_quantile(*node, [p])
        want = max(1, int(np.ceil(p * n)))
        value = values_of(high)[0]
        first, last = np.searchsorted(values, value, "left") + 1, np.searchsorted(values, value, "right")
        assert n == len(values) and max(0, first - want, want - last) <= LEVELS / k * n


def test_ranks_of_large_and_fractional_numbers_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST_NODES", 300)
    r = random.Random(4)
    data = [(r.choice("ab"), 10**6 + r.randint(0, 400), r.random(), 2**60 + r.randint(0, 2**50)) for _ in range(4000)]
    df = spark.createDataFrame(data, "g string, big bigint, share double, huge bigint")
    measures = {"big": "big", "share": "share", "huge": "huge"}
    found = percentiles(digests(df, ["g"], measures, 0.02), ["g"], [0.1, 0.5, 0.9, 1.0], 0.02)
    got = true_ranks(df, found, ["g"], measures).collect()
    assert len(got) == 24 and all(x["within"] for x in got)
    assert all(x["value"] == int(x["value"]) for x in found.where("measure = 'big'").collect())


def test_percentiles_merge_to_those_of_the_whole(spark):
    r = random.Random(9)
    data = [(r.choice(["en", "de", None]), r.randint(1, 4), r.choice([None, float("nan"), r.randint(0, 40), int(r.paretovariate(0.7))])) for _ in range(4000)] + [("none", 1, None)]
    df = spark.createDataFrame([(a, b, None if c is None else float(c), 7, 1) for a, b, c in data], "lang string, snap bigint, v double, node bigint, whole int")
    parts = digests(df, ["lang", "snap"], {"v": "v"}, 0.01)
    got = percentiles(merge(parts, ["lang"], 0.01), ["lang"], [0.5, 0.99], 0.01).collect()
    assert {(x["lang"], x["p"]) for x in got} == {(g, p) for g in ("en", "de", None) for p in (0.5, 0.99)}
    for x in got:
        own = sorted(c for a, _, c in data if a == x["lang"] and c is not None and c == c)
        want = int(np.ceil(x["p"] * len(own)))
        first, last = np.searchsorted(own, x["value_low"], "left") + 1, np.searchsorted(own, x["value"], "right")
        assert x["n"] == len(own) and max(0, first - want, want - last) <= x["max_rank_error"]
    assert percentiles(digests(df.limit(0), ["lang"], {"v": "v"}), ["lang"], [0.5]).count() == 0

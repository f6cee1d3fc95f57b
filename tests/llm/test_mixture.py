import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm.mixture import fit_lengths, knapsack, mixture, token_counts

from ..conftest import rows


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 60))
def test_knapsack_reaches_the_best_total(stock, budget):
    best = {0}
    for size, n in stock.items():
        best = {b + size * k for b in best for k in range(n + 1) if b + size * k <= budget}
    used = knapsack(list(stock), list(stock.values()), budget)
    assert sum(s * n for s, n in used.items()) == max(best) and all(n <= stock[s] for s, n in used.items())


def test_fit_comes_up_to_the_budget():
    r = np.random.default_rng(1)
    lengths, counts = np.arange(1, 400), r.integers(1, 30, 399)
    for budget in (0, 1, 5000, 400_000, int((lengths * counts).sum()) + 5):
        take = fit_lengths(lengths, counts, budget, 3, gap=5000)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((lengths * take).sum()) == min(budget, int((lengths * counts).sum()))


SIZED = "doc_id bigint, source string, tokens bigint, text string, n string"
TARGETS = "source string, target_share double, max_repeats bigint"


def _mix(spark, sized, targets, **more):
    s, t = spark.createDataFrame(sized, SIZED), spark.createDataFrame(targets, TARGETS)
    chosen, shares = mixture(s, t, sized=s.select("doc_id", "source", "tokens"), **more)
    return chosen.collect(), {r["source"]: r for r in shares.collect()}


def test_shares_caps_and_odd_sources(spark):
    sized = [(i, "big", 5 + i % 40, "", "") for i in range(900)] + [(1000 + i, "small", 10 + i % 7, "", "") for i in range(40)] + [(2000, None, 9, "", ""), (2001, "other", 9, "", ""), (2002, "big", 0, "", ""), (1, "big", 6, "", "")]
    targets = [("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), ("zero", 0.0, 2), ("capped", 0.0, None)]
    chosen, shares = _mix(spark, sized, targets)
    caps = {"big": 1, "small": 3}
    assert all(1 <= r["uses"] <= caps[r["source"]] for r in chosen)
    total = {s: sum(r["tokens"] * r["uses"] for r in chosen if r["source"] == s) for s in caps}
    assert total["small"] == 3 * sum(t for _, s, t, _, _ in sized if s == "small")
    assert total["big"] == round(total["small"] / 0.4 * 0.5)
    assert {s: r["mixed_tokens"] for s, r in shares.items()} == {**total, "absent": 0, "zero": 0, "capped": 0}
    assert abs(shares["big"]["actual_share"] - 5 / 9) < 1e-3 and shares["absent"]["actual_share"] == 0
    again, _ = _mix(spark, sized, targets)
    assert sorted(map(tuple, again)) == sorted(map(tuple, chosen))


def test_a_common_length_is_ranked_in_buckets(spark, monkeypatch):
    from strataloom.llm import mixture as module

    monkeypatch.setattr(module, "RANKED", 50)
    sized = [(i, "a", 10, "", "") for i in range(1000)] + [(5000 + i, "b", 10, "", "") for i in range(100)]
    chosen, _ = _mix(spark, sized, [("a", 0.5, 1), ("b", 0.5, 4)])
    own = [r["doc_id"] for r in chosen if r["source"] == "a"]
    assert len(own) == len(set(own)) == 400 and max(own) > 600


def test_given_total_and_nothing(spark):
    sized = [(i, "a", 7, "", "") for i in range(10)]
    chosen, shares = _mix(spark, sized, [("a", 1.0, 5)], total_tokens=100)
    assert sum(r["uses"] for r in chosen) == 14 and shares["a"]["mixed_tokens"] == 98
    chosen, shares = _mix(spark, [], [("a", 1.0, 5)])
    assert not chosen and shares["a"]["actual_share"] == 0
    assert _mix(spark, sized, []) == ([], {})
    with pytest.raises(ValueError):
        _mix(spark, sized, [("a", 0.5, 1), ("a", 0.5, 1)])


def test_token_counts_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "s", "hello world"), (2, None, None), (3, "s", ""), (2**60 + 1, "s", "word " * 50_000), (None, "s", "<|endoftext|>")], "doc_id bigint, source string, text string")
    got = dict((r[0], r[2]) for r in rows(token_counts(df)))
    assert got[1] == 2 and got[2] == got[3] == 0 and got[2**60 + 1] >= 50_000 and got[None] > 1

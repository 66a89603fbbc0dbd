"""Packing and mixing."""

from collections import Counter
from random import Random

import pytest

from larkspur.llm import mix, pack, tokens


@pytest.mark.parametrize("seed", range(6))
def test_histogram_is_placed_whole(seed):
    r = Random(seed)
    capacity = r.choice([10, 64, 2048])
    h = dict(Counter(min(capacity, 1 + int(r.expovariate(5 / capacity))) for _ in range(r.choice([0, 1, 50, 3000]))))
    patterns = pack.pack_histogram(h, capacity)
    placed: Counter = Counter()
    for count, pattern in patterns:
        assert count > 0 and sum(length * n for length, n in pattern) <= capacity
        for length, n in pattern:
            placed[length] += n * count
    assert placed == Counter(h)
    if sum(h.values()) >= 3000:
        containers = sum(c for c, _ in patterns)
        assert containers <= 1.06 * -(-sum(k * v for k, v in h.items()) // capacity) + 1


def test_packing(spark):
    r = Random(2)
    rows = [(k, r.choice([0, 5, 5, 5, 30, 64, 65, 300])) for k in range(500)]
    out = pack.pack_documents(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 64).collect()
    want = dict(rows)
    got: Counter = Counter()
    fill: Counter = Counter()
    for x in out:
        got[x.doc_id] += x.n_tokens
        fill[x.container_id] += x.n_tokens
    assert dict(got) == {k: v for k, v in want.items() if v}
    assert max(fill.values()) <= 64 and sorted(fill) == list(range(len(fill)))
    assert len({(x.container_id, x.place) for x in out}) == len(out)
    assert all(x.piece_no == 0 for x in out if want[x.doc_id] <= 64)
    spans: dict = {}
    for x in out:
        spans.setdefault(x.doc_id, []).append((x.first_token, x.n_tokens))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False))
    assert pack.pack_documents(spark.createDataFrame([], "doc_id long, n_tokens long"), 64).count() == 0


def test_weights():
    t = {"a": 800.0, "b": 150.0, "c": 50.0, "d": 0.0}
    assert mix.temperature_weights(t, 1.0)["a"] == pytest.approx(0.8)
    assert mix.temperature_weights(t, 0.0)["c"] == pytest.approx(1 / 3)
    goal = 0.9
    assert mix.entropy(mix.temperature_weights(t, mix.bisect_exponent(t, target_entropy=goal))) == pytest.approx(goal, abs=1e-6)
    x = mix.bisect_exponent(t, max_repeats={"c": 2.0}, budget=1000.0)
    assert mix.temperature_weights(t, x)["c"] * 1000 <= 100 + 1e-6
    assert mix.temperature_weights(t, x * 0.99)["c"] * 1000 > 100
    assert mix.temperature_weights({}, 1.0) == {} and mix.budgets({}, {"a": (1.0, 2)})[1] == 0.0


def test_exponents_above_one_and_what_cannot_be_met():
    t = {"a": 800.0, "b": 150.0, "c": 50.0}
    natural = mix.entropy(mix.temperature_weights(t, 1.0))
    x = mix.bisect_exponent(t, target_entropy=natural / 3)
    assert x > 1 and mix.entropy(mix.temperature_weights(t, x)) == pytest.approx(natural / 3, abs=1e-6)
    for bad in ({"target_entropy": 2.0}, {"target_entropy": -0.1}, {"max_repeats": {"a": 1.0}}, {}, {"max_repeats": dict.fromkeys("abc", 1.0), "budget": 1500.0}, {"max_repeats": {}, "budget": 1.0, "target_entropy": 0.5}):
        with pytest.raises(ValueError):
            mix.bisect_exponent(t, **bad)


def test_a_greater_budget_is_tilted_as_far_as_the_limits_allow():
    tokens, targets = {"a": 1000, "b": 100, "c": 10}, {"a": (0.2, 2), "b": (0.4, 2), "c": (0.4, 3)}
    x, whole, by_source = mix.budgets(tokens, targets)
    assert x == 1.0 and whole == pytest.approx(75.0) and by_source["b"] == pytest.approx(30.0)
    x, whole, by_source = mix.budgets(tokens, targets, 1200)
    assert 0 < x < 1 and sum(by_source.values()) == pytest.approx(1200)
    used = {s: by_source[s] / tokens[s] / targets[s][1] for s in tokens}
    assert max(used.values()) <= 1 + 1e-6 and max(used.values()) == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        mix.budgets(tokens, targets, 5000)


def test_mixture_reaches_its_shares(spark):
    r = Random(9)
    docs = [(k, r.choice(["a", "a", "a", "b", "c", None, "other"]), r.randint(1, 20)) for k in range(4000)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    uses, shares = mix.mix_sources(spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"), targets)
    rows, got = uses.collect(), {s.source: s for s in shares.collect()}
    for s, share, most in (("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)):
        assert got[s].reached_share == pytest.approx(share, abs=0.005)
        assert all(x.uses <= most for x in rows if x.source == s)
    assert len({x.doc_id for x in rows}) == len(rows) and {x.source for x in rows} == {"a", "b", "c"}
    # some source is used as often as it may be: the budget is the greatest that the limits allow
    assert any(sum(x.uses * x.n_tokens for x in rows if x.source == s) >= most * got[s].available_tokens * 0.99 for s, most in (("a", 1), ("b", 3), ("c", 2)))


@pytest.mark.parametrize("total", [None, 5000, 60_000])
def test_budgets_are_met_to_the_last_tokens(spark, total):
    """Many documents of the same hash digits, a few long ones: the rest of each budget is filled by what fits."""
    r = Random(3)
    docs = [(k, r.choice("abbb"), r.choice([1, 2, 3, 50, 400]), "clash") for k in range(2000)]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, place string")
    uses, shares = mix.mix_sources(df, targets, total)
    have = {s: sum(n for _, q, n, _ in docs if q == s) for s in "ab"}
    _, whole, budget = mix.budgets(have, {"a": (0.5, 2), "b": (0.5, 1)}, total)
    for x in shares.collect():
        assert 0 <= budget[x.source] - x.used_tokens < 2, (x, budget)
    assert all(x.uses <= {"a": 2, "b": 1}[x.source] for x in uses.collect())


def test_missing_source_makes_no_mixture(spark):
    df = spark.createDataFrame([(1, "a", 5)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    uses, shares = mix.mix_sources(df, targets)
    assert uses.count() == 0 and {s.used_tokens for s in shares.collect()} == {0}


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 9), (1, "a b c", "s", 9), (2, None, "s", 9), (3, " ", "s", 9), (None, "x", "s", 9), (4, "ü" * 1000, None, 9)], "doc_id long, text string, source string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()}
    assert got[1] == 3 and set(got) == {1, 4}

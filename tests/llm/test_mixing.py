import math

import pytest
from hypothesis import given, strategies as st

from citeloom.llm.mixing import mix_sources, sainte_lague, shard_quotas, shares_reached


def slow(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


@given(st.lists(st.integers(1, 1000), min_size=1, max_size=8), st.integers(0, 200))
def test_apportionment(weights, seats):
    assert sainte_lague(weights, seats) == slow(weights, seats)


@given(st.lists(st.integers(1, 50), min_size=2, max_size=5), st.integers(0, 60))
def test_limits(weights, seats):
    limits = [w // 2 for w in weights]
    got = sainte_lague(weights, seats, limits)
    assert all(g <= x for g, x in zip(got, limits)) and sum(got) == min(seats, sum(limits))


@given(st.lists(st.integers(1, 50), min_size=1, max_size=6), st.integers(0, 80))
def test_limits_step_by_step(weights, seats):
    limits = [(w * 7) % 11 for w in weights]
    got = [0] * len(weights)
    for _ in range(min(seats, sum(limits))):
        k = max((i for i in range(len(weights)) if got[i] < limits[i]), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    assert sainte_lague(weights, seats, limits) == got


def taken(quotas):
    out = {}
    for source, _, most in quotas:
        out[source] = out.get(source, 0) + most
    return out


def test_no_source_is_too_small():
    """A source of 1e9 tokens among 25e12, with and without a cap that binds, and one of less than one block."""
    shard = 16_000_000
    held = {"huge": {k: 25 * 10**12 // 16_384 for k in range(16_384)}, "tiny": {k: 10**9 // 63 for k in range(63)}, "less": {0: 900}}
    got = taken(shard_quotas([("huge", 0.99, 1), ("tiny", 0.009, 4), ("less", 0.001, 3)], held, 25e12))
    assert got["tiny"] == 4 * sum(held["tiny"].values()) and got["less"] == 2700
    assert got["huge"] == pytest.approx(0.99 * 25e12, rel=1e-6)
    got = taken(shard_quotas([("huge", 0.9999, 1), ("tiny", 0.0001, 4)], held, 1e9))
    assert got["tiny"] == pytest.approx(1e5, rel=0.01) and got["huge"] == pytest.approx(0.9999e9, rel=0.001)
    few = shard_quotas([("tiny", 0.0001, 4), ("huge", 0.9999, 1)], held, 1e9, shard_tokens=shard)
    assert len([1 for s, _, _ in few if s == "tiny"]) <= 4  # a little is not spread over all shards


@given(st.lists(st.tuples(st.integers(1, 10**6), st.integers(1, 100), st.integers(1, 5)), min_size=1, max_size=6), st.floats(0.01, 3))
def test_quotas_keep_shares_and_caps(sources, ratio):
    shares = [w for _, w, _ in sources]
    rows = [(f"s{i}", w / sum(shares), cap) for i, (_, w, cap) in enumerate(sources)]
    held = {f"s{i}": {k: t // 3 + 1 for k in range(3)} for i, (t, _, _) in enumerate(sources)}
    size = ratio * sum(sum(h.values()) for h in held.values())
    got = taken(shard_quotas(rows, held, size))
    for s, share, cap in rows:
        wanted = min(share * size, cap * sum(held[s].values()))
        assert got.get(s, 0) <= cap * sum(held[s].values())
        assert abs(got.get(s, 0) - wanted) <= 6 + 0.05 * wanted


def test_no_weights():
    assert sainte_lague([], 5) == [] and sainte_lague([0.0], 5) == [0]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "one two three four five six seven", "big", 1) for i in range(3000)] + [(5000 + i, "one two three", "small", 1) for i in range(60)]
    rows += [(9000, None, "small", 1), (9001, "", "big", 1), (9002, "x y", None, 1), (0, "one two three four five six seven", "big", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), "mix_name string, source string, target_share double, max_repeats int, size_ratio double")


def test_shares_caps_and_shards(spark, corpus):
    wanted = targets(spark, ("m", "big", 0.7, 1, 0.1), ("m", "small", 0.2, 4, 0.1), ("m", "absent", 0.1, 2, 0.1), ("n", "small", 1.0, 2, 0.5))
    for shard in (16_000_000, 2_000):
        chosen = mix_sources(corpus, wanted, shard_tokens=shard)
        rows = {(r.mix_name, r.source): r for r in shares_reached(chosen, wanted).collect()}
        total = 7 * 3001 + 3 * 60 + 2
        assert rows["m", "big"].mix_tokens == pytest.approx(0.07 * total, abs=40)
        assert rows["m", "small"].mix_tokens == pytest.approx(0.02 * total, abs=12) and rows["m", "small"].most_repeats <= 4
        assert rows["n", "small"].mix_tokens == 360 and rows["n", "small"].most_repeats == 2
        assert rows["m", "absent"].mix_tokens == 0 and rows["m", "absent"].share == 0.0
        assert math.isclose(sum(r.share for k, r in rows.items() if k[0] == "m"), 1.0)


def test_shares_against_the_mixture(spark, corpus):
    """Shares, caps and copies worked out again from the chosen rows by plain Python."""
    wanted = targets(spark, ("m", "big", 0.9, 1, 0.4), ("m", "small", 0.1, 2, 0.4), ("n", "small", 1.0, 3, 0.001))
    chosen = mix_sources(corpus, wanted)
    rows = chosen.collect()
    caps = {(r.mix_name, r.source): r.max_repeats for r in wanted.collect()}
    lengths = {r.doc_id: len(r.text.split()) for r in corpus.where("text <> ''").collect()}
    assert all(r.repeats <= caps[r.mix_name, r.source] and r.tokens == lengths[r.doc_id] for r in rows)
    for got in shares_reached(chosen, wanted).collect():
        own = [r for r in rows if (r.mix_name, r.source) == (got.mix_name, got.source)]
        whole = sum(r.tokens * r.repeats for r in rows if r.mix_name == got.mix_name)
        assert got.mix_tokens == sum(r.tokens * r.repeats for r in own) and got.documents == len(own) and got.copies == sum(r.repeats for r in own)
        assert got.share == pytest.approx(got.mix_tokens / whole)


def test_refill_seed_and_empty(spark, corpus):
    wanted = targets(spark, ("m", "big", 0.5, 1, 0.5), ("m", "small", 0.5, 1, 0.5))
    full = {r.source: r.mix_tokens for r in shares_reached(mix_sources(corpus, wanted, refill=True), wanted).collect()}
    assert full["small"] == pytest.approx(180, abs=4) and full["big"] == pytest.approx(0.5 * (7 * 3001 + 182) - 180, rel=0.02)
    one, two = ({r.doc_id for r in mix_sources(corpus, wanted, seed=s).collect()} for s in (1, 2))
    assert one != two and one == {r.doc_id for r in mix_sources(corpus, wanted, seed=1).collect()}
    assert mix_sources(corpus.limit(0), wanted).count() == 0 and mix_sources(corpus, wanted.limit(0)).count() == 0

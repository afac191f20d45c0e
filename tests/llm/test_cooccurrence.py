import itertools
import math
import random

import numpy as np
import pytest

from citeloom.llm import cooccurrence
from citeloom.llm.cooccurrence import ConfigurationModel, cooccurrences, poisson_binomial_tail


def brute(rows, min_count, min_lift):
    sets, items = {}, {}
    for b, i in rows:
        if b is not None and i is not None:
            sets.setdefault(b, set()).add(i)
            items.setdefault(i, set()).add(b)
    n = len(sets)
    out = {}
    for x, y in itertools.combinations(sorted(items), 2):
        k = len(items[x] & items[y])
        if k >= min_count and (min_lift is None or k * n >= min_lift * len(items[x]) * len(items[y])):
            out[x, y] = (k, len(items[x]), len(items[y]), n)
    return out


def table(spark, rows):
    return spark.createDataFrame([(b, i, 1, "x") for b, i in rows], "doc_id long, full_ref string, n int, lift string")


@pytest.mark.parametrize("min_lift", [None, 2.0])
@pytest.mark.parametrize("block", [256, 4])
def test_counts_are_exact(spark, monkeypatch, min_lift, block):
    monkeypatch.setattr(cooccurrence, "BLOCK", block)
    rng = random.Random(5)
    rows = [(b, "hot") for b in range(120)]  # in every basket
    for b in range(120):
        for i in rng.sample(range(25), rng.randint(0, 9)):
            rows.append((b, f"i{i:02}"))
    rows += [(0, f"i{i:02}") for i in range(25)] + rows[:30] + [(None, "i01"), (3, None)]
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_baskets) for r in cooccurrences(table(spark, rows), "doc_id", "full_ref", 4, min_lift).collect()}
    assert got == brute(rows, 4, min_lift)


def test_empty(spark):
    assert cooccurrences(table(spark, []), "doc_id", "full_ref").count() == 0
    assert cooccurrences(table(spark, [(1, "a"), (1, "b")]), "doc_id", "full_ref").count() == 0


def test_poisson_binomial():
    q, times = np.array([0.1, 0.3, 0.7]), np.array([3.0, 2.0, 1.0])
    p = [0.1] * 3 + [0.3] * 2 + [0.7]
    for n in range(8):
        exact = sum(math.prod(x if on else 1 - x for x, on in zip(p, mask)) for mask in itertools.product((0, 1), repeat=6) if sum(mask) >= n)
        assert poisson_binomial_tail(q, times, n) == pytest.approx(exact, abs=1e-12)
    assert 0 < poisson_binomial_tail(np.array([1e-4]), np.array([1e6]), 400) < 1e-60


@pytest.mark.parametrize("n", [250, 300, 320, 380])
def test_saddlepoint_agrees(n):
    q, times = np.array([0.02, 0.3, 0.001]), np.array([10_000.0, 333.0, 5_000.0])
    mean = float(q @ times)
    assert cooccurrence._saddlepoint_tail(q, times, n, mean) == pytest.approx(poisson_binomial_tail(q, times, n), rel=2e-3)


def test_model_keeps_degrees():
    items, baskets = [(1, 3.0, 40), (2, 10.0, 8)], [(1, 2.0, 60), (2, 8.0, 10)]
    m = ConfigurationModel.fit(items, baskets)
    assert m.p @ m.baskets == pytest.approx([3.0, 10.0], rel=1e-4)
    assert (np.array([40, 8])[:, None] * m.p).sum(0) == pytest.approx([2.0, 8.0], rel=1e-4)


def test_surprise(spark):
    rng = random.Random(1)
    rows = [(b, f"i{i}") for b in range(300) for i in rng.sample(range(60), 4)]
    rows += [(b, x) for b in range(20) for x in ("pair1", "pair2")]
    marked = {(r.item_a, r.item_b) for r in cooccurrences(table(spark, rows), "doc_id", "full_ref", 3).where("surprising").collect()}
    assert ("pair1", "pair2") in marked and len(marked) < 6


def test_false_discoveries_exactly(spark):
    from citeloom.llm.cooccurrence import _benjamini_hochberg

    rng = random.Random(5)
    for spread in (1.0, 3.0, 30.0):
        rows = [(10.0 ** -(rng.random() * spread), rng.randint(1, 9)) for _ in range(300)] + [(0.0, 2)]
        tests = 3 * sum(k for _, k in rows)
        want, below = 0.0, 0
        for p, k in sorted(rows):
            below += k
            if p <= 0.05 * below / tests:
                want = below
        bound = _benjamini_hochberg(spark.createDataFrame(rows, "p_value double, k long"), tests, 0.05)
        assert sum(k for p, k in rows if p <= bound) == want


def test_model_with_certain_meetings():
    """An item of all baskets and a basket of all items."""
    model = ConfigurationModel.fit([(10, 10.0, 1), (3, 3.0, 4)], [(5, 5.0, 1), (2, 17 / 9, 9)])
    assert np.allclose(model.p[0], 1.0) and np.allclose(model.p[:, 0], 1.0)
    assert np.allclose(model.p @ model.baskets, [10.0, 3.0], rtol=1e-4)

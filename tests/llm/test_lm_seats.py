"""Every customer is reseated in every sweep: numbers of tables against exact posteriors."""

import itertools
import math

import numpy as np
import pytest

from barscope.llm import lm


def log_stirling(c, d):
    """Generalised Stirling numbers of c customers at 1 to c tables."""
    row = np.full(c + 1, -np.inf)
    row[0] = 0
    for i in range(1, c + 1):
        more = i - 1 - d * np.arange(1, i + 1)
        stay = np.where(more > 0, np.log(np.maximum(more, 1e-300)) + row[1 : i + 1], -np.inf)
        row[1 : i + 1], row[0] = np.logaddexp(row[:i], stay), -np.inf
    return row[1:]


@pytest.mark.parametrize("a", [0.05, 3.0, 300.0, 1000.0, 20_000.0])
def test_one_sweep_reseats_all_customers_of_large_dishes(a):
    d, c, n = 0.75, 3000, 1500
    t = np.arange(1, c + 1)
    p = log_stirling(c, d) + t * math.log(a)
    p = np.exp(p - p.max())
    p /= p.sum()
    mean = (p * t).sum()
    spread = math.sqrt((p * t * t).sum() - mean * mean)
    got = lm.seated(np.full(n, c), d, lambda t, at: np.full(len(t), a), np.random.default_rng(3), 0, 1)[0]
    assert abs(got.mean() - mean) < 4 * spread / math.sqrt(n) and got.std() == pytest.approx(spread, rel=0.15)
    assert got.min() >= 1 and got.max() <= c


@pytest.mark.parametrize("d", [0.6, 0.75])
def test_ways_to_seat_many_customers(d):
    for c in (65, 700, 2000):
        t = np.arange(1.0, c + 1)
        exact = log_stirling(c, d) - math.lgamma(c + 1) + np.array([math.lgamma(x + 1) for x in t]) + t * math.log(d)
        assert np.abs(lm._log_ways(np.full(c, float(c)), t, d) - exact).max() < 1e-4
    x = np.array([0.25, 1.0, 3.3, 2e6])
    assert np.allclose(lm._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
    # One table of ten million customers: d Gamma(c - d) / (Gamma(1 - d) c!).
    (one,) = lm._log_ways(np.array([1e7]), np.array([1.0]), d)
    assert one == pytest.approx(math.log(d) - math.lgamma(1 - d) - (1 + d) * math.log(1e7), abs=1e-5)


def test_dishes_of_a_restaurant_depend_on_each_other():
    """Two dishes and a table that never changes: joint weight of t1 and t2 is the restaurant's rising strength times both dishes' own."""
    d, strength = lm.CONTEXT
    customers, base, n = (4, 3), (0.6, 0.3), 40_000
    ways = [np.exp(log_stirling(c, d)) for c in customers]
    exact = np.zeros(customers)
    for t in itertools.product(*(range(1, c + 1) for c in customers)):
        rise = math.prod(strength + d * k for k in range(1 + sum(t)))
        exact[t[0] - 1, t[1] - 1] = rise * math.prod(p**k * w[k - 1] for p, k, w in zip(base, t, ways))
    exact /= exact.sum()
    got = lm._seats(np.ones(n), np.repeat(np.arange(n), 2), np.tile(customers, n), np.ones(n), np.tile(base, n), np.random.default_rng(1))
    seen = np.zeros(customers)
    np.add.at(seen, (got[::2] - 1, got[1::2] - 1), 1 / n)
    assert np.abs(seen - exact).max() < 0.01


def test_sizes_between_the_table_and_the_integral():
    """Dishes just below and above ``SMALL`` customers agree, beside others of any size."""
    customers = np.concatenate([np.full(4000, lm.SMALL), np.full(4000, lm.SMALL + 1), [0, 1, 2, 10**7]])
    got = lm.seated(customers, 0.75, lambda t, at: np.full(len(t), 40.0), np.random.default_rng(2), 1, 1)[0]
    assert got[:4000].mean() == pytest.approx(got[4000:8000].mean(), rel=0.02) and got[8000:].tolist()[:2] == [0, 1]
    assert ((got >= 1) == (customers >= 1)).all() and (got <= customers).all()

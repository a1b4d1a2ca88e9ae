"""Exact sums and products against rational arithmetic, under many partitionings."""

import math
import random
from fractions import Fraction

import pytest

from panelspark.operators import exact as E


def values(rng, n):
    return [rng.choice([rng.uniform(-1, 1), rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30), float(rng.randint(-9, 9)), 2.0 ** rng.randint(-60, 60), 1e16, -1e16, 0.1]) for _ in range(n)]


def test_sums_are_the_exact_ones_in_any_layout(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), x) for x in values(rng, 4000)] + [("c", None), ("d", 1.0), ("d", 1e100), ("d", -1e100)]
    results = []
    for n in (1, 7, 200):
        shuffled = rows[:]
        rng.shuffle(shuffled)
        df = spark.createDataFrame(shuffled, "k string, x double").repartition(n)
        results.append({r.k: r.s for r in E.exact_sums(df, ["k"], {"s": "x"}).collect()})
    assert all(math.copysign(1, v or 0) == math.copysign(1, results[0][k] or 0) and v == results[0][k] for r in results[1:] for k, v in r.items())
    for k in ("a", "b", None):
        exact = sum(Fraction(x) for key, x in rows if key == k)
        assert abs(Fraction(results[0][k]) - exact) <= abs(exact) * Fraction(2) ** -52
    assert results[0]["c"] is None and results[0]["d"] == 1.0


def test_extremes(spark):
    tiny, huge = 5e-324, 1.7e308
    df = spark.createDataFrame([(1, tiny), (1, 2.0 ** -900), (2, huge), (2, -huge), (2, 3.5), (3, math.nan), (4, math.inf), (4, 1.0), (5, math.inf), (5, -math.inf), (6, 0.0), (6, -0.0), (7, 2.0 ** 24), (7, 2.0 ** 24 - 2 ** -28)], "k int, x double")
    got = {r.k: r.s for r in E.exact_sums(df, ["k"], {"s": "x"}).collect()}
    assert got[1] == 2.0 ** -900 and got[2] == 3.5 and math.isnan(got[3]) and got[4] == math.inf and math.isnan(got[5]) and got[6] == 0.0
    assert got[7] == 2.0 ** 25 - 2 ** -28
    assert E.exact_sums(df.limit(0), ["k"], {"s": "x"}).count() == 0


def test_several_sums_and_no_key(spark):
    df = spark.createDataFrame([(1, 0.1, 1.0), (1, 0.2, None), (2, 0.3, 4.0)], "k int, x double, y double")
    r = E.exact_sums(df, [], {"sx": "x", "sy": "y"}).first()
    assert r.sx == math.fsum([0.1, 0.2, 0.3]) and r.sy == 5.0


@pytest.mark.parametrize("n", [1, 13])
def test_products(spark, n):
    rng = random.Random(3)
    rows = [(k, 1 + rng.uniform(-.5, .5) * rng.choice([1, -4])) for k in range(4) for _ in range(60)] + [(10, 2.0), (10, None), (11, 0.0), (11, -3.0), (12, -2.0), (None, 3.0)]
    got = {r.k: r.p for r in E.exact_products(spark.createDataFrame(rows, "k int, x double").repartition(n), ["k"], {"p": "x"}).collect()}
    for k in range(4):
        want = math.prod(Fraction(x) for key, x in rows if key == k)
        assert abs(Fraction(got[k]) - want) <= abs(want) * Fraction(1, 10 ** 13)
    assert got[10] is None and got[11] == 0.0 and math.isclose(got[12], -2.0, rel_tol=1e-14) and math.isclose(got[None], 3.0, rel_tol=1e-14)
    test_products.seen = getattr(test_products, "seen", got)
    assert got == test_products.seen  # bit-equal under both layouts

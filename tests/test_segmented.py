"""The two-level (segmented) scans equal the single-window scans, with one hot key
spread over many range partitions."""

import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import panel as P


def skewed(spark, seed=11):
    rnd = random.Random(seed)
    rows = []
    # key 0 holds about half of all rows; the others are short histories
    for k, n in [(0, 600)] + [(k, rnd.randint(1, 9)) for k in range(1, 80)]:
        y = 1000
        for _ in range(n):
            x = None if rnd.random() < 0.5 else round(rnd.uniform(-3, 40), 3)
            g = rnd.choice([None, 0.1, -0.02, 0.3])
            rows.append((k, y, x, rnd.random() < 0.7, g))
            y += rnd.choice([1, 1, 2, 4])
    df = spark.createDataFrame(rows, "k long, y int, x double, f boolean, g double")
    return df.withColumn("lx", F.when(F.col("x") > 0, F.log("x")).otherwise(F.col("x")))


def same(a, b, cols):
    ra = sorted(tuple(r[c] for c in cols) for r in a.collect())
    rb = sorted(tuple(r[c] for c in cols) for r in b.collect())
    assert len(ra) == len(rb)
    for x, y in zip(ra, rb):
        for u, v in zip(x, y):
            if isinstance(u, (int, float)) and isinstance(v, (int, float)):
                assert abs(u - v) < 1e-9, (x, y)
            else:
                assert u == v, (x, y)


@pytest.mark.parametrize("segments", [3, 7, True])
def test_segmented_equals_window(spark, segments):
    df = skewed(spark)
    cols = ["k", "y", "x"]
    same(P.nearest_fill(df, "k", ["y"], "x", when=F.col("f")),
         P.nearest_fill(df, "k", ["y"], "x", when=F.col("f"), segments=segments), cols)
    same(P.nearest_fill(df, "k", ["y"], "x", era=F.col("y") >= 1100),
         P.nearest_fill(df, "k", ["y"], "x", era=F.col("y") >= 1100, segments=segments), cols)
    same(P.row_index(df, "k", ["y"], "c"), P.row_index(df, "k", ["y"], "c", segments=segments), ["k", "y", "c"])
    same(P.bfill(df, "k", ["y"], ["x", "g"], suffix="_b"),
         P.bfill(df, "k", ["y"], ["x", "g"], suffix="_b", segments=segments), ["k", "y", "x_b", "g_b"])
    same(P.densify_years(df, "k", "y", src="s"), P.densify_years(df, "k", "y", src="s", segments=segments),
         ["k", "y", "s", "x"])
    same(P.backcast_rates(df, "k", ["y"], "x", "lx", "g"),
         P.backcast_rates(df, "k", ["y"], "x", "lx", "g", segments=segments), ["k", "y", "lx"])
    same(P.backcast_constant(df, "k", ["y"], "lx", 0.05),
         P.backcast_constant(df, "k", ["y"], "lx", 0.05, segments=segments), ["k", "y", "lx"])
    same(P.pivot_zero_fill(df, "k", "y", "x", 1010),
         P.pivot_zero_fill(df, "k", "y", "x", 1010, segments=segments), cols)


def test_job_hot_mode_equals_plain(spark):
    """The capital-stock job gives the same stocks with its hot-key layout."""
    from panelspark.operators import intangibles as I
    from panelspark.plans import testviews as V
    from .conftest import SF001
    args = (V.panel(spark, SF001), V.company(spark, SF001), V.founding(spark, SF001))
    kw = dict(exclude=V.EXCLUDED_FIRMS, pivot_year=V.PIVOT_YEAR)
    a = I.intangible_stocks(*args, segments=None, **kw)
    b = I.intangible_stocks(*args, segments=4, **kw)
    same(a, b, ["gvkey", "fyear", "kcap_v2", "ocap_v2"])


@pytest.mark.parametrize("block", [12, 40])   # 700 rows: three and two levels
def test_blocked_recurrence_matches_loop(spark, block):
    rnd = random.Random(5)
    rows = []
    for k, n in [(0, 700), (1, 3), (2, 60)]:
        for t in range(n):
            rows.append((k, t, rnd.choice([0.3, 0.42, 0.8, 1.0]), None if rnd.random() < 0.002 else rnd.uniform(0, 9)))
    df = spark.createDataFrame(rows, "k long, t int, a double, b double")
    rec = {"s": (F.col("a"), F.col("b")), "u": (F.lit(0.8), F.col("a") * 2)}
    got = {(r.k, r.t): (r.s, r.u) for r in P.linear_recurrence(df, "k", ["t"], rec, block_rows=block, segments=4).collect()}
    base = {(r.k, r.t): (r.s, r.u) for r in P.linear_recurrence(df, "k", ["t"], rec).collect()}
    assert set(got) == set(base)
    for kk in (0, 1, 2):
        s = u = 0.0
        for (k, t, a, b) in [r for r in rows if r[0] == kk]:
            if t == 0:
                s = u = 0.0
            else:
                s = None if (s is None or b is None) else a * s + b
                u = 0.8 * u + 2 * a
            for res in (got, base):
                gs, gu = res[(k, t)]
                assert (gs is None and s is None) or abs(gs - s) < 1e-9 * max(1.0, abs(s))
                assert abs(gu - u) < 1e-9 * max(1.0, abs(u))


from hypothesis import HealthCheck, given, settings, strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.one_of(st.none(), st.integers(0, 40)),
                               st.one_of(st.none(), st.floats(-5, 5, allow_nan=False))),
                     min_size=1, max_size=60),
       segments=st.integers(2, 6))
def test_segmented_property(spark, data, segments):
    """Composite keys, null order values, random segment counts: same as one window."""
    rows = [(a, b, y, x, i) for i, (a, b, y, x) in enumerate(data)]
    df = spark.createDataFrame(rows, "a int, b int, y int, x double, i long")
    keys, order = ["a", "b"], ["y", "i"]          # i breaks ties
    same(P.nearest_fill(df, keys, order, "x"), P.nearest_fill(df, keys, order, "x", segments=segments),
         ["i", "x"])
    same(P.row_index(df, keys, order, "c"), P.row_index(df, keys, order, "c", segments=segments), ["i", "c"])
    same(P.bfill(df, keys, order, "x", suffix="_b"), P.bfill(df, keys, order, "x", suffix="_b", segments=segments),
         ["i", "x_b"])


def test_segmented_timestamp_ntz_order(spark):
    """Wall-clock timestamps across a DST change keep their order in segments."""
    import datetime as dt
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        base = dt.datetime(2021, 3, 14, 0, 0)
        rows = [(1, base + dt.timedelta(minutes=7 * i), None if i % 3 else float(i)) for i in range(80)]
        df = spark.createDataFrame(rows, "k long, t timestamp_ntz, x double")
        same(P.nearest_fill(df, "k", ["t"], "x"), P.nearest_fill(df, "k", ["t"], "x", segments=5), ["t", "x"])
        same(P.row_index(df, "k", ["t"], "c"), P.row_index(df, "k", ["t"], "c", segments=5), ["t", "c"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_segmented_splits_on_second_column_when_first_is_tied(spark):
    from panelspark.operators import segmented

    from panelspark.operators.segmented import SEG
    rows = [(1, 2000, i, None if i % 4 else float(i)) for i in range(90)]   # one year, many rows
    df = spark.createDataFrame(rows, "k long, y int, i long, x double")
    same(P.nearest_fill(df, "k", ["y", "i"], "x"), P.nearest_fill(df, "k", ["y", "i"], "x", segments=6), ["i", "x"])
    t = segmented.segmented_scan(df, ["k"], ["y", "i"], 6)
    assert t.select("__rn").distinct().count() == 90
    # no segment holds the whole key
    ranged = df.repartitionByRange(6, "k", "y", "i").withColumn(SEG, F.spark_partition_id())
    assert ranged.groupBy(SEG).count().agg(F.max("count")).first()[0] < 45

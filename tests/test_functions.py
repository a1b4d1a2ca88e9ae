"""Hand-computed cases for the scalar functions (FIXTURES §4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.functions import columns as C


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_link_dates(spark):
    rows = [(" B ",), ("E",), ("0",), ("19990131 ",)]
    got = one(spark, rows, "s string", C.clean_link_date("s", "B", C.SINCE_EVER_DATE))
    assert got[0] == dt.date(1700, 1, 1)
    assert got[2] is None and got[3] == dt.date(1999, 1, 31)
    got_end = one(spark, rows, "s string", C.clean_link_date("s", "E", C.OPEN_END_DATE))
    assert got_end[1] == dt.date(2260, 1, 1)


def test_malformed_date_is_null(spark):
    assert one(spark, [("2001x",), ("20010230",)], "s string", C.parse_yyyymmdd("s")) == [None, None]


def test_fiscal_year(spark):
    rows = [(dt.date(2001, 5, 31),), (dt.date(2001, 6, 1),)]
    assert one(spark, rows, "d date", C.fiscal_year("d")) == [2000, 2001]


def test_clip(spark):
    assert one(spark, [(-3,), (4,), (None,)], "a int", C.clip_low("a", 0)) == [0, 4, None]


def test_net_sga(spark):
    rows = [(50.0, 20.0, 5.0, 0.0), (50.0, 60.0, None, 100.0), (50.0, 60.0, None, 40.0), (None, 20.0, 0.0, 0.0)]
    got = one(spark, rows, "s double, r double, p double, c double", C.net_sga("s", "r", "p", "c"))
    assert got == [25.0, 50.0, -10.0, 0.0]


def test_sic_rates(spark):
    rows = [(4812,), (4811,), (2835,), (2825,), (9999,), (None,)]
    d = one(spark, rows, "s int", C.sic_rate("s", "delta"))
    g = one(spark, rows, "s int", C.sic_rate("s", "gamma"))
    assert d == [0.33, 0.46, 0.34, 0.42, 0.30, 0.30]
    assert g == [0.19, 0.44, 0.49, 0.22, 0.34, 0.34]


def test_sic_groups_overlap_only_where_expected():
    seen = {}
    for g in C.SIC_GROUP_ORDER:
        for lo, hi in C.SIC_GROUPS[g]:
            for s in range(lo, hi + 1):
                seen.setdefault(s, []).append(g)
    overlaps = sorted(s for s, gs in seen.items() if len(gs) > 1)
    assert overlaps == [4812, 4813, 4832, 4833, 4841]


def test_guarded_log_and_back(spark):
    rows = [(0.0,), (-2.0,), (float(2.718281828459045),)]
    lg = one(spark, rows, "x double", C.guarded_log("x"))
    assert lg[0] == 0.0 and lg[1] == -2.0 and abs(lg[2] - 1.0) < 1e-12
    df = spark.createDataFrame([(0.0, 0.0)], "x double, l double")
    assert df.select(C.level_from_log("x", "l")).first()[0] == 1.0
    assert df.select(C.level_from_log("x", "l", "keep_zero")).first()[0] == 0.0


def test_code_prefix_keeps_null(spark):
    assert one(spark, [(3714,), (None,)], "s int", C.code_prefix("s", 3)) == ["371", None]


def test_l2_and_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(C.l2_normalize("a").alias("n"), C.cosine("a", "b").alias("c")).collect()
    assert got[0].n == [0.6, 0.8] and abs(got[0].c - 0.96) < 1e-12
    assert got[1].n is None and got[1].c is None


def test_null_if_in(spark):
    got = one(spark, [(-99.0,), (0.1,), (-66.0,)], "r double", C.null_if_in("r", [-66.0, -77.0, -88.0, -99.0]))
    assert got == [None, 0.1, None]

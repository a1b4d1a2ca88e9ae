"""Link tables, interval joins and returns (FIXTURES §4 cases, brute-force checks)."""

import datetime as dt
import random

from pyspark.sql import functions as F

from panelspark.operators import links, returns


def d(s):
    return dt.date.fromisoformat(s)


def test_interval_join_bounds(spark):
    filings = spark.createDataFrame([(1, d("2000-01-01"), 10), (1, d("2000-12-31"), 11), (2, d("2000-06-01"), 12)],
                                    "cik long, rdate date, fname long")
    lk = spark.createDataFrame([(1, 7, d("2000-01-01"), d("2000-12-31")), (2, 8, None, d("2001-01-01"))],
                               "cik long, gvkey long, link_start date, link_end date")
    got = sorted(r.fname for r in links.interval_join(filings, lk, "cik", "rdate").collect())
    assert got == [10, 11]  # both bounds inclusive; a null start never matches


def test_interval_join_matches_brute_force(spark):
    rnd = random.Random(3)
    base = d("2000-01-01")
    fl = [(rnd.randint(1, 6), base + dt.timedelta(days=rnd.randint(0, 900)), i) for i in range(300)]
    lk = []
    for c in range(1, 7):
        for g in range(rnd.randint(0, 3)):
            s = base + dt.timedelta(days=rnd.randint(0, 600))
            e = s + dt.timedelta(days=rnd.randint(0, 400))
            lk.append((c, 100 * c + g, s if rnd.random() > 0.1 else None, e))
    f_df = spark.createDataFrame(fl, "cik long, rdate date, fname long")
    l_df = spark.createDataFrame(lk, "cik long, gvkey long, link_start date, link_end date")
    exp = sorted((f[2], l[1]) for f in fl for l in lk
                 if f[0] == l[0] and l[2] is not None and l[2] <= f[1] <= l[3])
    for buckets in (False, True):
        j = links.interval_join(f_df, l_df.where(F.col("link_start").isNotNull()) if buckets else l_df,
                                "cik", "rdate", year_buckets=buckets)
        got = sorted((r.fname, r.gvkey) for r in j.collect())
        assert got == exp


def test_containment_cases(spark):
    panel = spark.createDataFrame([(1, 2000), (2, 2000), (3, 2000), (4, 2000), (5, 2000)], "gvkey long, fyear int")
    lk = spark.createDataFrame([
        (1, d("1999-12-30"), d("2001-01-01"), False),   # kept
        (2, d("1999-12-31"), d("2001-01-01"), False),   # start not strictly before -> dropped
        (3, None, d("2001-01-01"), False),              # missing start passes
        (4, d("1990-01-01"), None, False),              # plain missing end fails
        (5, d("1990-01-01"), None, True),               # open end passes
    ], "gvkey long, link_start date, link_end date, end_open boolean")
    got = sorted(r.gvkey for r in links.containing_links(panel, lk).collect())
    assert got == [1, 3, 5]


def test_clean_links(spark):
    raw = spark.createDataFrame([(1, 1, " B ", "E"), (2, 2, "0", "20011231 "), (None, 3, "19990101", "0")],
                                "cik long, gvkey long, link_start_date string, link_end_date string")
    got = {r.cik: r for r in links.clean_links(raw).collect()}
    assert set(got) == {1, 2}
    assert got[1].link_start == d("1700-01-01") and got[1].link_end == d("2260-01-01") and got[1].end_open
    assert got[2].link_start is None and got[2].link_end == d("2001-12-31")


def test_filing_panel_threshold_strict(spark):
    lf = spark.createDataFrame([(1, 1, 2000, 10), (1, 1, 2001, 11)], "cik long, gvkey long, fyear int, fname long")
    p = spark.createDataFrame([(1, 2000, 5.0), (1, 2001, 5.01)], "gvkey long, fyear int, sale double")
    assert [r.fname for r in links.filing_panel(lf, p).collect()] == [11]


def test_compound_return(spark):
    df = spark.createDataFrame([(1, 2000, 0.1), (1, 2000, -0.1), (2, 2000, 0.1), (2, 2000, -99.0)],
                               "permno long, yr int, ret double")
    out = returns.compound_return(returns.clean_returns(df), ["permno", "yr"])
    got = {r.permno: r.ret for r in out.collect()}
    assert abs(got[1] - (-0.01)) < 1e-12 and got[2] is None


def test_first_seen_and_age(spark):
    df = spark.createDataFrame([(1, d("2001-03-01")), (1, d("1999-07-01")), (2, d("2005-01-01"))], "k long, dt date")
    got = {(r.k, r.dt): r.first for r in returns.first_seen(df, "k", "dt", "first").collect()}
    assert got[(1, d("2001-03-01"))] == d("1999-07-01") and got[(2, d("2005-01-01"))] == d("2005-01-01")
    a = spark.createDataFrame([(2000, None, d("2003-01-01"), None, None), (2000, 1990, None, None, None),
                               (2000, None, None, None, None)],
                              "fyear int, founding int, ipodate date, crsp_first_date date, comp_first_date date")
    ages = [r.age for r in returns.firm_age(a).collect()]
    assert ages == [0, 10, None]   # clipped at 0; null stays null

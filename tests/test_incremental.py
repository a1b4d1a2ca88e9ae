"""Retries by state and timer, updates of the capital-stock job, the filing index as a data source."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from panelspark.operators import intangibles as I
from panelspark.operators.links import filing_index
from panelspark.plans import testviews as V
from panelspark.sources import filing_index as X
from panelspark.streaming import retry as R
from panelspark.streaming.incremental_stocks import StockTables, merged_rates, moved_rates

from .conftest import SF001


def flaky(text, tries):
    if text is None or tries <= int(text):
        raise ValueError(f"try {tries}")
    return text * 2


def test_no_filing_is_lost_or_repeated(spark, tmp_dir):
    def run(attempt=flaky):
        out = R.retry_extraction(spark, f"{tmp_dir}/in", "k long, body string", "k", "body", attempt, f"{tmp_dir}/log", f"{tmp_dir}/cp", tries=3, delay_ms=5)
        return {int(r.key): (r.tries, r.status, r.error, r.found) for r in out.collect()}

    def arrive(rows):
        spark.createDataFrame(rows, "k long, body string").write.mode("append").parquet(f"{tmp_dir}/in")

    want = {0: (1, "done", None, "00"), 1: (2, "done", None, "11"), 2: (3, "done", None, "22"), 3: (3, "given_up", "ValueError: try 3", None), 4: (3, "given_up", "ValueError: try 3", None)}
    arrive([(0, "0"), (1, "1"), (2, "2"), (3, "9"), (4, None), (None, "0")])
    assert run() == want
    tried = R.log(spark, f"{tmp_dir}/log").count()
    # a restart with nothing new, then with filings that came before and new ones
    assert run() == want and R.log(spark, f"{tmp_dir}/log").count() == tried
    arrive([(0, "0"), (3, "0"), (5, "1")])
    assert run() == want | {5: (2, "done", None, "11")} and R.log(spark, f"{tmp_dir}/log").count() == tried + 2


def write_index(root, year, quarter, rows, by_company=False):
    os.makedirs(f"{root}/{year}/QTR{quarter}")
    cols = [("Company Name", 62), ("Form Type", 12)] if by_company else [("Form Type", 12), ("Company Name", 62)]
    line = lambda v: "".join(f"{v[c]:<{w}}" for c, w in [*cols, ("CIK", 12), ("Date Filed", 12)]) + v["File Name"]
    names = {c: c for c in ("Form Type", "Company Name", "CIK", "Date Filed", "File Name")}
    with open(f"{root}/{year}/QTR{quarter}/form.idx", "w") as f:
        f.write("Description: index\n\n" + line(names) + "\n" + "-" * 120 + "\n")
        for form, company, cik, day, name in rows:
            f.write(line({"Form Type": form, "Company Name": company, "CIK": cik, "Date Filed": day, "File Name": name}) + "\n")


def test_quarters_left_out_are_not_opened(spark, tmp_dir):
    write_index(tmp_dir, 1995, 1, [("10-K", "ACME INC", 17, "1995-02-03", "edgar/a.txt"), ("8-K", "B", 18, "1995-02-04", "b.txt"), ("10-K405", "C", 19, "1995-03-31", "c.txt")])
    write_index(tmp_dir, 1995, 2, [("10-K", "ÄRGER AG", 20, "19950402", "d.txt"), ("10-K", "no date", 21, "", "e.txt"), ("10-K", "no cik", "x", "1995-04-05", "")], by_company=True)
    os.makedirs(f"{tmp_dir}/1996/QTR1")
    with open(f"{tmp_dir}/1996/QTR1/form.idx", "w") as f:
        f.write("no header here\n")
    os.makedirs(f"{tmp_dir}/notes")
    index = X.read_filing_index(spark, tmp_dir)
    got = index.where("date < '1996-01-01'").orderBy("date").collect()
    assert [(r.form, r.company, r.cik, r.date.isoformat(), r.fname, r.year, r.quarter) for r in got] == [
        ("10-K", "ACME INC", 17, "1995-02-03", "edgar/a.txt", 1995, 1), ("8-K", "B", 18, "1995-02-04", "b.txt", 1995, 1), ("10-K405", "C", 19, "1995-03-31", "c.txt", 1995, 1),
        ("10-K", "ÄRGER AG", 20, "1995-04-02", "d.txt", 1995, 2), ("10-K", "no cik", None, "1995-04-05", None, 1995, 2)]
    with pytest.raises(Exception, match="header"):
        index.count()  # opens the broken quarter
    annual = filing_index(index).where("year = 1995 and quarter in (1, 2)")
    plain = spark.createDataFrame(got).where(F.col("form").isin("10-K", "10-K405"))
    assert sorted(map(str, annual.collect())) == sorted(map(str, plain.collect()))
    assert index.where(F.col("date") == dt.date(1995, 4, 2)).rdd.getNumPartitions() == 1
    assert index.where("year = 1990").count() == 0 and index.where("form = '10-K' and form = '8-K' and year = 1995").count() == 0


def stocks(rows):
    return {(r.gvkey, r.fyear): (r.kcap_v2, r.ocap_v2) for r in rows.select("gvkey", "fyear", "kcap_v2", "ocap_v2").collect()}


def close(a, b):
    return a.keys() == b.keys() and all(x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9)) for k in a for x, y in zip(a[k], b[k]))


def test_updates_equal_the_full_job(spark, tmp_dir):
    accounts, company, founding = V.panel(spark, SF001), V.company(spark, SF001), V.founding(spark, SF001)
    tables = StockTables(spark, f"{tmp_dir}/t", buckets=4)
    full = lambda rows: stocks(I.intangible_stocks(rows, company, founding, pivot_year=V.PIVOT_YEAR, segments=None))
    first, later = accounts.where("fyear < 1998 or gvkey % 4 <> 0"), accounts.where("fyear >= 1998 and gvkey % 4 = 0")
    tables.update(0, first, company, founding, pivot_year=V.PIVOT_YEAR)
    assert close(stocks(tables.update(1, later, company, founding, pivot_year=V.PIVOT_YEAR)), full(accounts))
    # the same update again, as after a crash, changes nothing
    assert close(stocks(tables.update(1, later, company, founding, pivot_year=V.PIVOT_YEAR)), full(accounts))
    # a firm without an IPO year moves no rate: it alone is recomputed
    firm = company.where("ipo_year is null").join(accounts, "gvkey", "left_semi").select(F.min("gvkey")).first()[0]
    more = accounts.where(F.col("gvkey") == firm).withColumn("fyear", F.col("fyear") + 20).withColumn("datadate", F.add_months("datadate", 240))
    got = stocks(tables.update(2, more, company, founding, pivot_year=V.PIVOT_YEAR))
    assert tables.recomputed == 1 and close(got, full(accounts.unionByName(more)))
    assert close(stocks(tables.update(3, more.limit(0), company, founding, pivot_year=V.PIVOT_YEAR)), got) and tables.recomputed == 0
    with pytest.raises(ValueError):
        tables.update(4, more, company, founding, age_mode="recomputed")


def test_rates_move_only_where_the_bits_do(spark):
    parts = spark.createDataFrame([(f, "xrd", a, 1, math.log(f + a + 2)) for f in range(5) for a in range(-1, 4)], "gvkey int, value string, age int, n long, s double")
    one, two = merged_rates(parts.repartition(1)), merged_rates(parts.orderBy(F.desc("gvkey")).repartition(9))
    assert moved_rates(one, two).count() == 0 and moved_rates(None, one).count() == 4
    changed = merged_rates(parts.withColumn("s", F.when((F.col("gvkey") == 2) & (F.col("age") == 3), F.col("s") + 1e-9).otherwise(F.col("s"))))
    assert [(r.value, r.age) for r in moved_rates(one, changed).collect()] == [("xrd", 3)]


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_dir):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k"}
    was = {c: spark.conf.get(c) for c in conf}
    rows = spark.range(0, 40000, 1, 8).select(F.col("id").alias("gvkey"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        tables = StockTables(spark, f"{tmp_dir}/b", buckets=2)
        written = tables.replace("rows", rows, rows.select("gvkey"))
        files = lambda: written.select("__bucket", F.input_file_name().alias("file")).distinct().groupBy("__bucket").agg(F.count("*").alias("n")).collect()
        assert all(r.n > 3 for r in files()) and written.drop("__bucket").exceptAll(rows).count() == 0 and written.count() == 40000
        # the rows of some firms: the others stay, in both buckets
        some = rows.where("gvkey < 100").withColumn("x", F.lit("new"))
        again = tables.replace("rows", some, some.select("gvkey"))
        assert again.count() == 40000 and again.where("x = 'new'").count() == 100
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)


def test_founding_list_and_rates_do_not_shuffle_the_panel_again(spark):
    parts = spark.createDataFrame([(f, "xrd", a, 1, 1.0) for f in range(3) for a in range(3)] + [(9, "xrd", 0, 1, 1.0), (9, "xrd", 2, 1, 9.0)], "gvkey int, value string, age int, n long, s double")
    plan = merged_rates(parts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LOG2") == 1  # ages met by a window; the cells of a value worked out once
    assert [(r.value, r.age, r.grate) for r in merged_rates(parts).orderBy("age").collect()] == [("xrd", 1, 0.0), ("xrd", 2, 0.0)]  # firm 9 skips an age

"""The command line runs the jobs on landed files and gives the library's results."""

from pyspark.sql import functions as F

from panelspark import cli
from panelspark.operators import intangibles as I
from panelspark.plans import testviews as V

from .conftest import SF001


def test_capital_stocks_cli(spark, tmp_dir):
    p = V.panel(spark, SF001)
    c = V.company(spark, SF001)
    funda = (p.join(c.select("gvkey", "cusip", "seq"), "gvkey", "left")
              .withColumnRenamed("assets", "at").withColumn("indfmt", F.lit("INDL")).withColumn("datafmt", F.lit("STD")))
    funda.write.parquet(f"{tmp_dir}/funda")
    c.select("gvkey", "sic", "ipodate", "cusip").write.parquet(f"{tmp_dir}/company")
    V.founding(spark, SF001).write.parquet(f"{tmp_dir}/founding")
    cli.main(["capital-stocks", "--funda", f"{tmp_dir}/funda", "--company", f"{tmp_dir}/company",
              "--founding", f"{tmp_dir}/founding", "--out", f"{tmp_dir}/out", "--pivot-year", "1998",
              "--exclude", "1"])
    got = spark.read.parquet(f"{tmp_dir}/out")
    exp = I.intangible_stocks(p, c, V.founding(spark, SF001), exclude=[1], pivot_year=1998)
    a = sorted((r.gvkey, r.fyear, round(r.kcap_v2, 6), round(r.ocap_v2, 6)) for r in got.collect())
    b = sorted((r.gvkey, r.fyear, round(r.kcap_v2, 6), round(r.ocap_v2, 6)) for r in exp.collect())
    assert a == b and len(a) > 0


def test_part_files_cli(spark, tmp_dir):
    spark.read.parquet(f"{SF001}/documents.parquet").write.parquet(f"{tmp_dir}/docs")
    cli.main(["part-files", "--input", f"{tmp_dir}/docs", "--order", "doc_id", "--rows", "50", "--out", f"{tmp_dir}/parts"])
    back = spark.read.parquet(f"{tmp_dir}/parts")
    assert back.count() == 200 and back.select("chunk").distinct().count() == 4


def _rows(df, cols):
    return sorted((tuple(None if r[c] is None else (round(r[c], 6) if isinstance(r[c], float) else r[c])
                         for c in cols) for r in df.collect()), key=repr)


def test_returns_and_filing_panel_cli(spark, tmp_dir):
    from panelspark.operators import jobs
    acc = V.accounts(spark, SF001).withColumnRenamed("assets", "at").withColumn("revt", F.col("sale"))
    acc.write.parquet(f"{tmp_dir}/acc")
    V.ccm(spark, SF001).write.parquet(f"{tmp_dir}/ccm")
    V.monthly(spark, SF001).write.parquet(f"{tmp_dir}/monthly")
    V.founding(spark, SF001).write.parquet(f"{tmp_dir}/founding")
    V.filings(spark, SF001).withColumn("fname", F.col("fname").cast("string")).write.parquet(f"{tmp_dir}/filings")
    V.links_raw(spark, SF001).write.parquet(f"{tmp_dir}/links")
    cli.main(["returns-panel", "--accounts", f"{tmp_dir}/acc", "--ccm", f"{tmp_dir}/ccm", "--monthly",
              f"{tmp_dir}/monthly", "--founding", f"{tmp_dir}/founding", "--out", f"{tmp_dir}/rp"])
    exp = jobs.panel_with_returns(V.accounts(spark, SF001), V.ccm(spark, SF001), V.monthly(spark, SF001),
                                  V.founding(spark, SF001))
    cols = ["gvkey", "fyear", "ret", "firstyear", "age"]
    assert _rows(spark.read.parquet(f"{tmp_dir}/rp"), cols) == _rows(exp, cols)
    cli.main(["filing-panel", "--filings", f"{tmp_dir}/filings", "--links", f"{tmp_dir}/links", "--accounts",
              f"{tmp_dir}/acc", "--out", f"{tmp_dir}/fp"])
    exp = jobs.filing_firm_panel(V.filings(spark, SF001), V.links_raw(spark, SF001), V.accounts(spark, SF001))
    cols = ["cik", "gvkey", "fyear", "naics3"]
    got = spark.read.parquet(f"{tmp_dir}/fp")
    assert _rows(got, cols) == _rows(exp, cols) and got.count() > 0


def test_embed_cli(spark, tmp_dir):
    ft = V.filing_text(spark, SF001).withColumn("fname", F.col("fname").cast("string"))
    ft.write.parquet(f"{tmp_dir}/sections")
    cli.main(["embed", "--sections", f"{tmp_dir}/sections", "--out", f"{tmp_dir}/emb", "--compression", "zstd"])
    out = spark.read.parquet(f"{tmp_dir}/emb")
    assert out.count() == ft.count()
    assert {"fname", "text", "item1_na", "embfull", "emb1"} <= set(out.columns)
    assert out.where(F.col("embfull").isNull()).count() == 0

"""Map the driver's TPC-H-style tables onto the source's data model.

Each view exists twice: as DataFrame code (what the Spark queries read) and as
a DuckDB CTE (what the oracle SQL reads). Money is summed in integer cents so
both engines get bit-identical inputs whatever their summation order.

Views: panel (firm-year accounts), company, founding (listed founding years),
monthly (security returns), filings (filing index), links_raw (filer-firm link
file with date codes), filing_text (three sections per filing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The R&D pivot year on this data (orders span 1995-2001).
PIVOT_YEAR = 1998
# Firm excluded by key, as the source excluded one firm with data issues.
EXCLUDED_FIRMS = [1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cents = _cents("o_totalprice")
    pr = F.col("o_orderpriority")

    def amount(cond):
        return (F.sum(F.when(cond, cents)).cast("double") / 100000.0)

    return (o.groupBy(F.col("o_custkey").alias("gvkey"),
                      F.year("o_orderdate").cast("int").alias("fyear"))
             .agg(F.max("o_orderdate").cast("date").alias("datadate"),
                  amount(F.col("o_orderstatus") == "O").alias("assets"),
                  amount(pr.isin("1-URGENT", "2-HIGH")).alias("xsga"),
                  amount(pr == "3-MEDIUM").alias("xrd"),
                  amount(pr == "4-NOT SPECIFIED").alias("rdip"),
                  amount(pr == "5-LOW").alias("cogs"),
                  (F.sum(cents).cast("double") / 100000.0).alias("sale")))


def company(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ipo_year = F.when(k % 5 != 0, (F.lit(1994) + k % 6).cast("int"))
    return c.select(k.alias("gvkey"), F.col("c_name").alias("cusip"),
                    F.col("c_nationkey").cast("int").alias("seq"),
                    F.when(k % 11 != 0, ((k * 37) % 9000).cast("int")).alias("sic"),
                    ipo_year.alias("ipo_year"),
                    F.make_date(ipo_year, F.lit(7), F.lit(1)).alias("ipodate"))


def founding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    m = k % 10
    code = (F.when(m == 0, -99).when(m == 1, -9).when(m == 2, 201).when(m == 3, 0)
             .otherwise(F.lit(1980) + k % 25)).cast("int")
    perm = F.when(k % 4 == 0, F.lit(".")).otherwise((k % 50).cast("string"))
    return c.select(F.col("c_name").alias("cusip"), code.alias("founding"), perm.alias("crsp_perm"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    disc = F.round(F.col("l_discount") * 100).cast("long")
    ret = F.when(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)) == 0, F.lit(-99.0)) \
        .otherwise(F.sum(disc).cast("double") / F.count(F.lit(1)).cast("double") / 100.0 - 0.05)
    return (li.groupBy(F.col("l_suppkey").alias("permno"),
                       (F.col("l_suppkey") % 50).alias("permco"),
                       F.year("l_shipdate").cast("int").alias("yr"),
                       F.month("l_shipdate").cast("int").alias("mo"))
              .agg(ret.alias("ret"))
              .withColumn("date", F.make_date("yr", "mo", F.lit(1))))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pr = F.col("o_orderpriority")
    form = (F.when(pr == "1-URGENT", "10-K").when(pr == "2-HIGH", "10-K405")
             .when(pr == "3-MEDIUM", "10-K/A").otherwise("8-K"))
    return o.select(F.col("o_custkey").alias("cik"), F.col("o_orderdate").cast("date").alias("rdate"),
                    F.col("o_orderkey").alias("fname"), form.alias("form"))


def links_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey")
    ymd = lambda c: F.date_format(c, "yyyyMMdd")
    start = (F.when(k % 7 == 0, F.lit(" B ")).when(k % 13 == 0, F.lit("0"))
              .otherwise(F.concat(F.lit(" "), ymd(F.min("o_orderdate")))))
    end = (F.when(k % 7 == 1, F.lit("E")).when(k % 17 == 0, F.lit("0"))
            .otherwise(F.concat(ymd(F.max("o_orderdate")), F.lit(" "))))
    own = o.groupBy(k).agg(start.alias("link_start_date"), end.alias("link_end_date"), F.max("o_custkey").alias("cik"))
    own = own.select("cik", F.col("cik").alias("gvkey"), "link_start_date", "link_end_date")
    # every third filer has a second, wider link to its firm, every fifth one to the next firm
    again = own.where(F.col("cik") % 3 == 0).select("cik", "gvkey", F.lit("B").alias("link_start_date"), F.lit("20500101").alias("link_end_date"))
    other = own.where(F.col("cik") % 5 == 0).select("cik", (F.col("gvkey") + 1).alias("gvkey"), F.lit("19960101").alias("link_start_date"), F.lit("E").alias("link_end_date"))
    return own.unionByName(again).unionByName(other)


def filing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    a = d.select(F.col("doc_id").alias("fname"), F.col("text").alias("item1"))
    b = d.select((F.col("doc_id") - 1).alias("fname"), F.col("text").alias("item1a"))
    c = d.select((F.col("doc_id") - 2).alias("fname"), F.col("text").alias("item7"))
    # the last two documents have no next ones: empty sections
    return a.join(b, "fname", "left").join(c, "fname", "left").na.fill("", ["item1a", "item7"])


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firm-year accounts as the first job reads them (panel + company header)."""
    c = company(spark, sf_dir).select("gvkey", "cusip", "ipodate", F.col("sic").cast("string").alias("naicsh"))
    return panel(spark, sf_dir).join(c, "gvkey", "left").withColumn("year", F.col("fyear"))


def ccm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account-security links covering each firm-year (the link filter job's output):
    permno = the filer id, permco = permno % 50 (as in ``monthly``)."""
    from ..operators.dedup import keep_first
    from ..operators.links import clean_links, containing_links
    lk = clean_links(links_raw(spark, sf_dir)).select("cik", "gvkey", "link_start", "link_end", "end_open")
    c = containing_links(panel(spark, sf_dir).select("gvkey", "fyear", "datadate"), lk)
    c = c.select("gvkey", "datadate", "fyear", F.col("cik").alias("permno"), (F.col("cik") % 50).alias("permco"),
                 F.col("link_start").alias("linkdt"), F.col("link_end").alias("linkenddt"))
    return keep_first(c, ["permco", "gvkey", "datadate"], ["permno", "linkdt", "linkenddt"])


SPARK_VIEWS = {
    "panel": panel, "company": company, "founding": founding, "monthly": monthly,
    "filings": filings, "links_raw": links_raw, "filing_text": filing_text,
}

# --------------------------------------------------------------------------- DuckDB forms

SQL_VIEWS = {
    "panel": """
select o_custkey as gvkey, cast(year(o_orderdate) as integer) as fyear,
  cast(max(o_orderdate) as date) as datadate,
  cast(sum(case when o_orderstatus = 'O' then cast(round(o_totalprice * 100) as bigint) end) as double) / 100000.0 as assets,
  cast(sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then cast(round(o_totalprice * 100) as bigint) end) as double) / 100000.0 as xsga,
  cast(sum(case when o_orderpriority = '3-MEDIUM' then cast(round(o_totalprice * 100) as bigint) end) as double) / 100000.0 as xrd,
  cast(sum(case when o_orderpriority = '4-NOT SPECIFIED' then cast(round(o_totalprice * 100) as bigint) end) as double) / 100000.0 as rdip,
  cast(sum(case when o_orderpriority = '5-LOW' then cast(round(o_totalprice * 100) as bigint) end) as double) / 100000.0 as cogs,
  cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100000.0 as sale
from orders group by o_custkey, cast(year(o_orderdate) as integer)""",
    "company": """
select c_custkey as gvkey, c_name as cusip, cast(c_nationkey as integer) as seq,
  case when c_custkey % 11 <> 0 then cast((c_custkey * 37) % 9000 as integer) end as sic,
  case when c_custkey % 5 <> 0 then cast(1994 + c_custkey % 6 as integer) end as ipo_year,
  case when c_custkey % 5 <> 0 then make_date(cast(1994 + c_custkey % 6 as integer), 7, 1) end as ipodate
from customer""",
    "founding": """
select c_name as cusip, cast(case c_custkey % 10 when 0 then -99 when 1 then -9 when 2 then 201
  when 3 then 0 else 1980 + c_custkey % 25 end as integer) as founding,
  case when c_custkey % 4 = 0 then '.' else cast(c_custkey % 50 as varchar) end as crsp_perm
from customer""",
    "monthly": """
select l_suppkey as permno, l_suppkey % 50 as permco, cast(year(l_shipdate) as integer) as yr,
  cast(month(l_shipdate) as integer) as mo,
  case when sum(case when l_returnflag = 'R' then 1 else 0 end) = 0 then -99.0
       else cast(sum(cast(round(l_discount * 100) as bigint)) as double) / cast(count(*) as double) / 100.0 - 0.05 end as ret,
  make_date(cast(year(l_shipdate) as integer), cast(month(l_shipdate) as integer), 1) as date
from lineitem group by l_suppkey, l_suppkey % 50, cast(year(l_shipdate) as integer), cast(month(l_shipdate) as integer)""",
    "filings": """
select o_custkey as cik, cast(o_orderdate as date) as rdate, o_orderkey as fname,
  case o_orderpriority when '1-URGENT' then '10-K' when '2-HIGH' then '10-K405'
    when '3-MEDIUM' then '10-K/A' else '8-K' end as form
from orders""",
    "links_raw": """
select o_custkey as cik, o_custkey as gvkey,
  case when o_custkey % 7 = 0 then ' B ' when o_custkey % 13 = 0 then '0'
    else concat(' ', strftime(min(o_orderdate), '%Y%m%d')) end as link_start_date,
  case when o_custkey % 7 = 1 then 'E' when o_custkey % 17 = 0 then '0'
    else concat(strftime(max(o_orderdate), '%Y%m%d'), ' ') end as link_end_date
from orders group by o_custkey
union all select distinct o_custkey, o_custkey, 'B', '20500101' from orders where o_custkey % 3 = 0
union all select distinct o_custkey, o_custkey + 1, '19960101', 'E' from orders where o_custkey % 5 = 0""",
    "filing_text": """
select a.doc_id as fname, a.text as item1, coalesce(b.text, '') as item1a, coalesce(c.text, '') as item7
from documents a left join documents b on b.doc_id = a.doc_id + 1 left join documents c on c.doc_id = a.doc_id + 2""",
}

"""Queries for sources, sinks and the jobs around them; each writes what it reads back from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import capture, filing_url, has_date_code, parse_yyyymmdd
from ..operators import intangibles as I
from ..operators import links, panel as P, text
from ..session import scratch_path
from ..sources import io
from . import testviews as V
from .catalog import query

# =========================================================================== CSV


@query("csv_by_header", """
select o_orderkey as orderkey, o_custkey as custkey, cast(o_orderdate as date) as day, o_totalprice as price, o_orderpriority as priority from orders""")
def q_csv_by_header(spark, d):
    """Columns in another order than the schema's, upper-case names, an extra one, coded dates."""
    path = scratch_path(spark, "orders_csv")
    o = V.table(spark, d, "orders")
    o.select(F.col("o_orderpriority").alias("PRIORITY"), F.col("o_totalprice").alias("PRICE"), F.col("o_orderstatus").alias("UNUSED"),
             F.date_format("o_orderdate", "yyyyMMdd").alias("DAY"), F.col("o_custkey").alias("CUSTKEY"), F.col("o_orderkey").alias("ORDERKEY")).write.option("header", True).csv(path)
    return io.read_table(spark, path, "orderkey bigint, custkey bigint, day date, price double, priority string", "csv")


@query("csv_bad_bytes", "select c_custkey as custkey, c_name || chr(65533) as name from customer")
def q_csv_bad_bytes(spark, d):
    path = scratch_path(spark, "customer_csv")
    V.table(spark, d, "customer").select(F.concat("c_name", F.lit("\xe9")).alias("name"), F.col("c_custkey").alias("custkey")) \
        .write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return io.read_table(spark, path, "custkey bigint, name string", "csv")


@query("csv_corrupt_cells", """
select o_orderkey as orderkey, case when o_orderkey % 7 <> 0 then o_totalprice end as price, case when o_orderkey % 5 <> 0 then cast(o_orderdate as date) end as day,
  nullif(concat_ws(',', case when o_orderkey % 7 = 0 then 'price' end, case when o_orderkey % 5 = 0 then 'day' end), '') as wrong
from orders""")
def q_csv_corrupt_cells(spark, d):
    path = scratch_path(spark, "corrupt_csv")
    k = F.col("o_orderkey")
    V.table(spark, d, "orders").select(
        F.when(k % 5 == 0, F.lit("20201399")).otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"), k.alias("orderkey"),
        F.when(k % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("price")).write.option("header", True).csv(path)
    return io.read_csv(spark, path, "orderkey bigint, price double, day date", corrupt="wrong")


def _sheet(spark, d):
    """The founding list as landed: an unnamed index, missing offer dates, CUSIPs listed twice."""
    c = V.table(spark, d, "customer")
    k = F.col("c_custkey")
    one = c.select(k.alias("Unnamed: 0"), F.col("c_name").alias("CUSIP"), F.when(k % 8 != 0, F.lit("19990101")).alias("offer date"),
                   F.when(k % 9 == 0, -99).when(k % 9 == 1, 201).otherwise(F.lit(1980) + k % 25).cast("int").alias("Founding"))
    return one.unionByName(one.where(F.col("Unnamed: 0") % 10 == 0))


SHEET_SQL = """
select c_custkey as k, c_name as cusip, case when c_custkey % 8 <> 0 then '19990101' end as offer_date,
  cast(case when c_custkey % 9 = 0 then -99 when c_custkey % 9 = 1 then 201 else 1980 + c_custkey % 25 end as integer) as founding
from customer"""
SHEET_SQL = f"{SHEET_SQL} union all select * from ({SHEET_SQL}) s where k % 10 = 0"


@query("founding_sheet", f"select cusip, offer_date, founding from ({SHEET_SQL}) t")
def q_founding_sheet(spark, d):
    path = scratch_path(spark, "sheet_csv")
    io.write_table(_sheet(spark, d), path, "csv")
    return io.read_founding(spark, path)


@query("founding_complete", f"""
select cusip, cast(case when founding = 201 then 2013 else founding end as integer) as founding
from ({SHEET_SQL}) t where offer_date is not null and founding <> -99""")
def q_founding_complete(spark, d):
    """Rows without an offer date go although that column isn't kept; repeated CUSIPs keep their rows."""
    path = scratch_path(spark, "sheet_csv")
    io.write_table(_sheet(spark, d), path, "csv")
    return I.clean_founding(io.read_founding(spark, path)).select("cusip", "founding")


@query("drop_unnamed", "select c_name as CUSIP, case when c_custkey % 8 <> 0 then '19990101' end as \"offer date\" from customer where c_custkey % 10 <> 0")
def q_drop_unnamed(spark, d):
    once = _sheet(spark, d).where(F.col("Unnamed: 0") % 10 != 0)
    return io.drop_matching(once, "^Unnamed").drop("Founding")


@query("required_columns", "select count(*) as n from orders")
def q_required_columns(spark, d):
    return io.require_columns(V.table(spark, d, "orders"), ["o_orderkey", "o_custkey"]).agg(F.count("*").alias("n"))


@query("date_codes", """
select o_orderkey, cast(o_orderdate as date) as day from orders where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0""")
def q_date_codes(spark, d):
    """Integer dates, some cut to a month and some with a stray character."""
    k = F.col("o_orderkey")
    code = F.date_format("o_orderdate", "yyyyMMdd")
    o = V.table(spark, d, "orders").select(k, F.when(k % 5 == 0, F.substring(code, 1, 6)).when(k % 7 == 0, F.concat(code, F.lit("x"))).otherwise(code).alias("code"))
    return o.where(has_date_code("code")).select("o_orderkey", parse_yyyymmdd("code").alias("day"))


# =========================================================================== files


@query("parquet_zstd", "select doc_id, md5(text) as text_md5 from documents")
def q_parquet_zstd(spark, d):
    path = scratch_path(spark, "zstd")
    io.write_table(V.table(spark, d, "documents"), path, compression="zstd")
    return io.read_table(spark, path).select("doc_id", F.md5("text").alias("text_md5"))


@query("part_files", """
select chunk, count(*) as n, min(c_name) as first, max(c_name) as last, true as in_order
from (select c_name, (row_number() over (order by c_name) - 1) // 100 as chunk from customer) t group by chunk""")
def q_part_files(spark, d):
    """Part files of 100 rows by a text key, read back with their rows' order in the file."""
    path = scratch_path(spark, "part_files")
    io.write_row_chunks(V.table(spark, d, "customer").select("c_name", "c_acctbal"), path, ["c_name"], 100)
    rows = spark.read.parquet(path).select(F.col("chunk").cast("long").alias("chunk"), "c_name", F.col("_metadata.row_index").alias("at"))
    own = F.collect_list(F.struct("at", "c_name"))  # 100 rows
    names = F.transform(F.array_sort(own), lambda r: r["c_name"])
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min("c_name").alias("first"), F.max("c_name").alias("last"), (names == F.array_sort(names)).alias("in_order"))


@query("row_chunks_by_date", """
select o_orderkey, cast((row_number() over (order by o_orderdate, o_orderkey) - 1) // 1516 as bigint) as chunk from orders""")
def q_row_chunks_by_date(spark, d):
    o = V.table(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    return io.row_chunks(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "chunk")


@query("files_by_time", "select o_orderkey, cast(case when o_orderkey % 2 = 0 then 1 else 2 end as integer) as nth from orders")
def q_files_by_time(spark, d):
    """Rows of files written one after the other, numbered by their files' times."""
    path = scratch_path(spark, "by_time")
    o = V.table(spark, d, "orders").select("o_orderkey")
    for batch, rows in ((1, o.where("o_orderkey % 2 = 0")), (2, o.where("o_orderkey % 2 <> 0"))):
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)
    parts = io.read_parts(spark, path)
    times = parts.groupBy("batch").agg(F.min("file_mtime").alias("at"))  # one row a write
    later = times.select(F.col("batch").alias("other"), F.col("at").alias("other_at"))
    nth = times.join(later, F.col("other_at") <= F.col("at")).groupBy("batch").agg(F.count("*").cast("int").alias("nth"))
    return parts.join(nth, "batch").select("o_orderkey", "nth")


@query("dead_letters", "select page_id, url like 'https://%' as sound from pages")
def q_dead_letters(spark, d):
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    io.write_split(V.table(spark, d, "pages").select("page_id", F.col("url").like("https://%").alias("ok")), "ok", good, bad)
    return spark.read.parquet(good).withColumn("sound", F.lit(True)).unionByName(spark.read.parquet(bad).withColumn("sound", F.lit(False)))


# =========================================================================== texts


@query("two_texts", "select fname from filing_text where length(item1a) > 0 and length(item7) > 0")
def q_two_texts(spark, d):
    return V.filing_text(spark, d).where((F.length("item1a") > 0) & (F.length("item7") > 0)).select("fname")


@query("filing_urls", """
select o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || o_orderkey || '.txt' as url, cast(o_orderkey as varchar) as name from orders""")
def q_filing_urls(spark, d):
    o = V.table(spark, d, "orders")
    path = F.concat(F.lit("edgar/data/"), "o_custkey", F.lit("/"), "o_orderkey", F.lit(".txt"))
    return o.select("o_orderkey", filing_url(path).alias("url")).withColumn("name", capture("url", r"/([^/]+)\.txt$"))


FILING_LINKS_SQL = """
select doc_id as fname, doc_id % 50 as gvkey from documents union all select doc_id, doc_id % 50 + 1000 from documents where doc_id % 4 = 0"""


@query("filing_texts", f"""
with b as (select doc_id as fname, chr(10) || text as item1, chr(10) || source as item1a, chr(10) || lang || ' ' || text as item7 from documents where doc_id % 6 <> 0)
select l.fname, l.gvkey, cast(length(item1) < 900 as integer) as item1_na, md5(item1
    || case when length(item1) >= 900 and length(item1a) < 900 then '' else item1a end
    || case when length(item1) >= 900 and length(item7) < 900 then '' else item7 end) as text_md5
from ({FILING_LINKS_SQL}) l join b on l.fname = b.fname""")
def q_filing_texts(spark, d):
    """The filing-text job on plain-text filings; every sixth one lacks item 1A, and some are linked to two firms."""
    doc = V.table(spark, d, "documents")
    k = F.col("doc_id")
    risk = F.when(k % 6 != 0, F.concat(F.lit("\nITEM 1A - RISK FACTORS\n"), "source")).otherwise(F.lit(""))
    body = F.concat(F.lit("cover\nItem 1. Business\n"), "text", risk, F.lit("\n  Item 2. Properties\nnone\nItem 7: Management\n"), "lang", F.lit(" "), "text", F.lit("\nItem 8 end"))
    own = doc.select(k.alias("fname"), (k % 50).alias("gvkey"))
    linked = own.unionByName(own.where(F.col("fname") % 4 == 0).withColumn("gvkey", F.col("gvkey") + 1000))
    out, _ = text.filing_texts(linked, doc.select(k.alias("fname"), body.alias("body")), min_chars=900)
    return out.select("fname", "gvkey", "item1_na", F.md5("text").alias("text_md5"))


# =========================================================================== link filter and security history

ACCOUNT_SQL = """
select gvkey, fyear, datadate, case when gvkey % 11 = 0 then 'FS' else 'INDL' end as indfmt, case when fyear % 5 = 0 and gvkey % 3 = 0 then 'SUMM_STD' else 'STD' end as datafmt,
  case when gvkey % 13 = 0 then 'I' else 'D' end as popsrc, 'C' as consol, case when gvkey % 17 = 0 then 'CAD' else 'USD' end as curcd, case when gvkey % 19 = 0 then 'CAN' else 'USA' end as fic, sale
from panel"""


def _flagged(spark, d):
    k, y = F.col("gvkey"), F.col("fyear")
    return V.panel(spark, d).select(
        "gvkey", "fyear", "datadate", F.when(k % 11 == 0, "FS").otherwise("INDL").alias("indfmt"), F.when((y % 5 == 0) & (k % 3 == 0), "SUMM_STD").otherwise("STD").alias("datafmt"),
        F.when(k % 13 == 0, "I").otherwise("D").alias("popsrc"), F.lit("C").alias("consol"), F.when(k % 17 == 0, "CAD").otherwise("USD").alias("curcd"),
        F.when(k % 19 == 0, "CAN").otherwise("USA").alias("fic"), "sale")


HISTORY_SQL = """
select c_custkey as gvkey, case n when 0 then 'LU' when 1 then 'LC' when 2 then 'LU' else 'LX' end as linktype, case when (c_custkey + n) % 7 = 0 then 'N' when n = 1 then 'C' else 'P' end as linkprim,
  c_custkey * 10 + n as lpermno, c_custkey % 40 + n // 2 as lpermco,
  case when n <> 1 or c_custkey % 2 = 0 then make_date(cast(1990 + n * 3 as integer), 1, 1) end as linkdt, case when n <> 2 then make_date(cast(1996 + c_custkey % 6 as integer), 6, 30) end as linkenddt
from customer, (select unnest(range(4)) as n) r"""


def _history(spark, d):
    k, n = F.col("c_custkey"), F.col("n")
    return V.table(spark, d, "customer").select("c_custkey", F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("n")).select(
        k.alias("gvkey"), F.when(n == 1, "LC").when(n == 3, "LX").otherwise("LU").alias("linktype"),
        F.when((k + n) % 7 == 0, "N").when(n == 1, "C").otherwise("P").alias("linkprim"),
        (k * 10 + n).alias("lpermno"), (k % 40 + F.floor(n / 2)).alias("lpermco"),
        F.when((n != 1) | (k % 2 == 0), F.make_date(F.lit(1990) + n * 3, F.lit(1), F.lit(1))).alias("linkdt"),
        F.when(n != 2, F.make_date((F.lit(1996) + k % 6).cast("int"), F.lit(6), F.lit(30))).alias("linkenddt"))


@query("security_links", f"""
select permco, gvkey, datadate, fyear, linktype, linkprim, permno, linkdt, linkenddt from (
  select a.*, h.linktype, h.linkprim, h.lpermno as permno, h.lpermco as permco, h.linkdt, h.linkenddt,
    row_number() over (partition by h.lpermco, a.gvkey, a.datadate order by a.fyear, h.linktype, h.linkprim, h.lpermno, h.linkdt nulls first, h.linkenddt nulls first) as rn
  from ({ACCOUNT_SQL}) a join ({HISTORY_SQL}) h on a.gvkey = h.gvkey
  where indfmt = 'INDL' and datafmt = 'STD' and popsrc = 'D' and consol = 'C' and linktype in ('LU', 'LC') and linkprim in ('P', 'C') and fyear between 1950 and 2020
    and (linkdt is null or (year(linkdt) <= 2021 and linkdt < make_date(fyear - 1, 12, 31)))
    and (linkenddt is null or (year(linkenddt) >= 1949 and linkenddt > make_date(fyear, 12, 31)))) t
where rn = 1""")
def q_security_links(spark, d):
    out = links.security_links(_history(spark, d), _flagged(spark, d).drop("curcd", "fic", "sale"))
    return out.select("permco", "gvkey", "datadate", "fyear", "linktype", "linkprim", "permno", "linkdt", "linkenddt")


@query("domestic_accounts", f"""
select a.gvkey, a.fyear, a.datadate, cast(year(a.datadate) as integer) as year, c.cusip from ({ACCOUNT_SQL}) a join company c on a.gvkey = c.gvkey
where indfmt = 'INDL' and datafmt = 'STD' and popsrc = 'D' and consol = 'C' and curcd = 'USD' and fic = 'USA'""")
def q_domestic_accounts(spark, d):
    out = links.domestic_accounts(_flagged(spark, d), V.company(spark, d).select("gvkey", "cusip"))
    return out.select("gvkey", "fyear", "datadate", "year", "cusip")


@query("common_shares", f"""
with h as (
  select s_suppkey as permno, make_date(cast(1992 + n * 3 as integer), 1, 1) as first, make_date(cast(1994 + n * 3 + s_suppkey % 2 as integer), 12, 31) as last,
    case when (s_suppkey + n) % 5 = 0 then 'AD' else 'NS' end as sharetype, case when (s_suppkey + n) % 7 = 0 then 'REIT' else 'CORP' end as issuertype,
    case (s_suppkey + n) % 4 when 0 then 'N' when 1 then 'A' when 2 then 'Q' else 'X' end as primaryexch, cast(s_suppkey % 9000 as integer) as siccd, n
  from supplier, (select unnest(range(3)) as n) r)
select m.permno, m.date, h.primaryexch, h.siccd from monthly m join h on m.permno = h.permno and m.date between h.first and h.last
where sharetype = 'NS' and issuertype in ('ACOR', 'CORP') and primaryexch in ('N', 'A', 'Q')""")
def q_common_shares(spark, d):
    k, n = F.col("s_suppkey"), F.col("n")
    history = V.table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("n")).select(
        k.alias("permno"), F.make_date(F.lit(1992) + n * 3, F.lit(1), F.lit(1)).alias("secinfostartdt"),
        F.make_date((F.lit(1994) + n * 3 + k % 2).cast("int"), F.lit(12), F.lit(31)).alias("secinfoenddt"),
        F.when((k + n) % 5 == 0, "AD").otherwise("NS").alias("sharetype"), F.lit("EQTY").alias("securitytype"), F.lit("COM").alias("securitysubtype"), F.lit("Y").alias("usincflg"),
        F.when((k + n) % 7 == 0, "REIT").otherwise("CORP").alias("issuertype"),
        F.element_at(F.array(*(F.lit(x) for x in "NAQX")), ((k + n) % 4 + 1).cast("int")).alias("primaryexch"),
        F.lit("RW").alias("conditionaltype"), F.lit("A").alias("tradingstatusflg"), (k % 9000).cast("int").alias("siccd"))
    return links.monthly_common_shares(V.monthly(spark, d).select("permno", "date"), history).select("permno", "date", "primaryexch", "siccd")


# =========================================================================== ties


@query("nearest_fill_ties", """
with o as (
  select o_custkey as gvkey, cast(date_trunc('year', o_orderdate) as date) as datadate, o_orderkey as k, case when o_orderpriority not in ('1-URGENT', '5-LOW') then o_totalprice end as x from orders),
n as (select *, row_number() over (partition by gvkey order by datadate, k) as rn from o),
w as (
  select *, max(case when x is not null then rn end) over (partition by gvkey order by rn) as p,
    min(case when x is not null then rn end) over (partition by gvkey order by rn rows between current row and unbounded following) as q from n)
select w.gvkey, w.k, w.rn - 1 as nth, coalesce(w.x, case when p is null then b.x when q is null or w.rn - p <= q - w.rn then a.x else b.x end) as x
from w left join n a on a.gvkey = w.gvkey and a.rn = w.p left join n b on b.gvkey = w.gvkey and b.rn = w.q""")
def q_nearest_fill_ties(spark, d):
    """Several accounts of a firm on one date: the other columns decide their order."""
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("gvkey"), F.trunc("o_orderdate", "year").alias("datadate"), F.col("o_orderkey").alias("k"),
                                           F.when(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), F.col("o_totalprice")).alias("x"))
    return P.nearest_fill(P.row_index(o, "gvkey", ["datadate"], "nth"), "gvkey", ["datadate"], "x").select("gvkey", "k", "nth", "x")

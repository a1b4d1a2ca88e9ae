"""The query catalog: one Spark plan per operator of the survey's inventory, each
paired (where SQL can say it) with an equivalent DuckDB query over the same
tables. Spark plans call the library; the SQL is written independently.

Doubles are rounded to ``ROUND`` decimals on both sides before comparison.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import code_prefix, fiscal_year, net_sga
from ..operators import dedup, links, panel as P, returns, text, vectors
from ..operators import intangibles as I
from ..operators import jobs
from ..sources import io
from ..session import scratch_path
from . import testviews as V
from .testviews import EXCLUDED_FIRMS, PIVOT_YEAR, SQL_VIEWS

ROUND = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def r(c, digits: int = ROUND):
    """The plain rounded value."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def single(c: str):
    """The value to single precision. Capital stocks are sums of products of cents and rates, which lie on
    decimal ties, and pass through exp(log(x)), whose last bits differ between math libraries."""
    return F.col(c).cast("float").cast("double").alias(c)


def oracle_sql() -> dict[str, str]:
    """Each query's SQL with the test views it reads prepended as CTEs."""
    return {name: with_views(sql) for name, sql in SQL.items()}


def with_views(sql: str) -> str:
    body = sql.strip()
    recursive = False
    own = ""
    m = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if m:
        recursive = bool(m.group(1))
        own = body[m.end():]
        body = ""
    used = [v for v in SQL_VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = [f"{v} as ({SQL_VIEWS[v].strip()})" for v in used]
    head = "with recursive " if recursive else "with "
    if own:
        return head + ",\n".join(ctes + [own])
    if not ctes:
        return body
    return head + ",\n".join(ctes) + "\n" + body


# =========================================================================== shared SQL pieces

LINK_CLEAN_SQL = """
select cik, gvkey,
  cast(try_strptime(case when trim(link_start_date) = '0' then null
                         when trim(link_start_date) = 'B' then '17000101'
                         else trim(link_start_date) end, '%Y%m%d') as date) as link_start,
  cast(try_strptime(case when trim(link_end_date) = '0' then null
                         when trim(link_end_date) = 'E' then '22600101'
                         else trim(link_end_date) end, '%Y%m%d') as date) as link_end,
  trim(link_end_date) = 'E' as end_open
from links_raw where cik is not null and gvkey is not null"""

LINKED_FILINGS_SQL = f"""
select cik, gvkey, rdate, fname,
  cast(year(rdate) - case when month(rdate) < 6 then 1 else 0 end as integer) as fyear
from (
  select f.cik, l.gvkey, f.rdate, f.fname,
    row_number() over (partition by f.cik, l.gvkey, f.rdate order by f.fname, f.form) as rn2
  from (select cik, rdate, fname, form,
          row_number() over (partition by cik, rdate order by fname, form) as rn
        from filings where form like '10-K%' and form in ('10-K', '10-K405')) f
  join ({LINK_CLEAN_SQL}) l
    on f.cik = l.cik and f.rdate >= l.link_start and f.rdate <= l.link_end
  where f.rn = 1) j
where rn2 = 1"""

ANNUAL_RETURN_SQL = """
select permno, yr, crsp_first_date,
  case when count(*) = count(ret) then product(1 + ret) - 1 end as ret
from (select permno, yr, ret, min(date) over (partition by permco) as crsp_first_date
      from (select permno, permco, yr, date,
              case when ret in (-66.0, -77.0, -88.0, -99.0) then null else ret end as ret
            from monthly) m) m2
group by permno, yr, crsp_first_date"""

AGE_SQL = """
select p.*, p.fyear - c.ipo_year as age
from panel p left join company c on p.gvkey = c.gvkey"""


def growth_sql(value: str, age_filter: str) -> str:
    return f"""
select a.age, count(*) as n, avg(ln(a.{value}) - ln(b.{value})) as grate
from ({AGE_SQL}) a join ({AGE_SQL}) b on a.gvkey = b.gvkey and a.age = b.age + 1
where {age_filter} and a.{value} > 0 and b.{value} > 0
group by a.age"""


#: The industry groups' SIC codes and rates, stated again in SQL (the first group that fits counts).
SIC_SQL = """case
  when {c} between 100 and 999 or {c} between 2000 and 2399 or {c} between 2500 and 2519 or {c} between 2590 and 2599 or {c} between 2700 and 2749 or {c}
    between 2770 and 2799 or {c} between 3100 and 3199 or {c} between 3630 and 3659 or {c} between 3710 and 3711 or {c} = 3714 or {c} = 3716 or {c}
    between 3750 and 3751 or {c} = 3792 or {c} between 3900 and 3999 or {c} between 4812 and 4813 or {c} between 4832 and 4833 or {c} = 4841 or {c}
    between 5000 and 5999 or {c} between 7200 and 7299 or {c} between 7600 and 7699 or {c} between 8000 and 8099
    then {g1}
  when {c} between 1200 and 1399 or {c} between 2520 and 2589 or {c} between 2600 and 2699 or {c} between 2750 and 2769 or {c} between 2800 and 2829 or {c}
    between 2840 and 3099 or {c} between 3200 and 3569 or {c} between 3580 and 3621 or {c} between 3623 and 3629 or {c} between 3700 and 3709 or {c}
    between 3712 and 3713 or {c} = 3715 or {c} between 3717 and 3749 or {c} between 3752 and 3791 or {c} between 3793 and 3799 or {c} between 3860 and
    3899 or {c} between 4900 and 4949
    then {g2}
  when {c} between 3570 and 3579 or {c} = 3622 or {c} between 3660 and 3692 or {c} between 3694 and 3699 or {c} between 3810 and 3839 or {c} between 4800 and
    4899 or {c} between 7370 and 7379 or {c} = 7391 or {c} between 8730 and 8734
    then {g3}
  when {c} between 2830 and 2839 or {c} = 3693 or {c} between 3840 and 3859
    then {g4}
  else {other} end"""
SIC_SQL_RATES = {"delta": {"g1": 0.33, "g2": 0.42, "g3": 0.46, "g4": 0.34, "other": 0.30},
                 "gamma": {"g1": 0.19, "g2": 0.22, "g3": 0.44, "g4": 0.49, "other": 0.34}}


def sic_case_sql(col: str, which: str) -> str:
    return SIC_SQL.format(c=col, **{g: f"cast({v} as double)" for g, v in SIC_SQL_RATES[which].items()})


FOUNDING_CLEAN_SQL = """
select cusip, founding from (
  select cusip, cast(case when founding in (-99, -9, 0) then null when founding = 201 then 2013
                          else founding end as integer) as founding
  from founding) t
where cusip is not null and founding is not null"""


# =========================================================================== S1, K1 scans and sinks

@query("scan_csv", "select r_regionkey, r_name from region")
def q_scan_csv(spark, d):
    path = scratch_path(spark, "scan_csv")
    io.write_table(V.table(spark, d, "region"), path, fmt="csv")
    schema = "r_regionkey int, r_name string"
    return io.read_table(spark, path, schema, fmt="csv")


@query("filter_like_in", """
select cik, rdate, fname, form from filings
where form like '10-K%' and form in ('10-K', '10-K405')""")
def q_filter_like_in(spark, d):
    return links.filing_index(V.filings(spark, d)).select("cik", "rdate", "fname", "form")


@query("distinct_keys", "select distinct fname from filings")
def q_distinct_keys(spark, d):
    return V.filings(spark, d).select("fname").distinct()


@query("row_chunks", """
select doc_id, cast((row_number() over (order by doc_id) - 1) // 1516 as bigint) as chunk
from documents""")
def q_row_chunks(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id")
    return io.row_chunks(docs, ["doc_id"], io.ROWS_PER_PART)


# =========================================================================== panel preparation

@query("panel_prepare", f"""
select p.gvkey, p.fyear, c.sic as sich,
  cast(min(p.fyear) over (partition by p.gvkey) as integer) as firstcomp,
  cast(row_number() over (partition by p.gvkey order by p.datadate, p.fyear) - 1 as bigint) as "count",
  cast(case when p.assets is null then 1 else 0 end as integer) as atnan
from panel p left join company c on p.gvkey = c.gvkey
where p.gvkey not in ({', '.join(map(str, EXCLUDED_FIRMS))}) and p.fyear is not null""")
def q_panel_prepare(spark, d):
    p = V.panel(spark, d).join(V.company(spark, d).select("gvkey", F.col("sic").alias("sich")), "gvkey", "left")
    p = p.where(~F.col("gvkey").isin(EXCLUDED_FIRMS))
    p = returns.first_seen(p, "gvkey", "fyear", "firstcomp").where(F.col("fyear").isNotNull())
    p = P.row_index(p, "gvkey", ["datadate", "fyear"], "count")
    return p.select("gvkey", "fyear", "sich", F.col("firstcomp").cast("int").alias("firstcomp"), "count",
                    F.col("assets").isNull().cast("int").alias("atnan"))


@query("founding_clean", FOUNDING_CLEAN_SQL)
def q_founding_clean(spark, d):
    return I.clean_founding(V.founding(spark, d)).select("cusip", "founding")


@query("first_seen", """
select cik, fname, rdate, min(rdate) over (partition by cik) as first_date
from filings where length(strftime(rdate, '%Y%m%d')) = 8""")
def q_first_seen(spark, d):
    f = V.filings(spark, d).where(F.length(F.date_format("rdate", "yyyyMMdd")) == 8)
    return returns.first_seen(f, "cik", "rdate", "first_date").select("cik", "fname", "rdate", "first_date")


# =========================================================================== joins

@query("panel_link", """
select p.gvkey, p.fyear, p.datadate, f.fname
from panel p left join filings f
  on p.gvkey = f.cik and p.fyear = cast(year(f.rdate) as integer) and p.datadate = f.rdate""")
def q_panel_link(spark, d):
    f = V.filings(spark, d).select(F.col("cik").alias("gvkey"), F.year("rdate").cast("int").alias("fyear"),
                                   F.col("rdate").alias("datadate"), "fname")
    return V.panel(spark, d).join(f, ["gvkey", "fyear", "datadate"], "left") \
        .select("gvkey", "fyear", "datadate", "fname")


def _annual_return(spark, d):
    return returns.annual_returns(returns.clean_returns(V.monthly(spark, d)), "yr")


@query("annual_return", f"""
select permno, yr, crsp_first_date, round(ret, {ROUND}) as ret from ({ANNUAL_RETURN_SQL}) a""")
def q_annual_return(spark, d):
    return _annual_return(spark, d).select("permno", "yr", "crsp_first_date", r("ret").alias("ret"))


@query("panel_returns", f"""
select p.gvkey, p.fyear, round(a.ret, {ROUND}) as ret
from panel p left join ({ANNUAL_RETURN_SQL}) a on a.permno = p.gvkey and a.yr = p.fyear""")
def q_panel_returns(spark, d):
    a = _annual_return(spark, d).select(F.col("permno").alias("gvkey"), F.col("yr").alias("fyear"), "ret")
    return V.panel(spark, d).join(a, ["gvkey", "fyear"], "left").select("gvkey", "fyear", r("ret").alias("ret"))


@query("link_clean", LINK_CLEAN_SQL)
def q_link_clean(spark, d):
    return links.clean_links(V.links_raw(spark, d)).select("cik", "gvkey", "link_start", "link_end", "end_open")


def _linked_filings(spark, d):
    f = links.annual_filings(V.filings(spark, d))
    lk = links.clean_links(V.links_raw(spark, d)).select("cik", "gvkey", "link_start", "link_end")
    return links.link_filings(f, lk).select("cik", "gvkey", "rdate", "fname", "fyear")


@query("interval_join", LINKED_FILINGS_SQL)
def q_interval_join(spark, d):
    return _linked_filings(spark, d)


@query("link_contain", f"""
select gvkey, fyear, cik, link_start, link_end from (
  select p.gvkey, p.fyear, l.cik, l.link_start, l.link_end,
    row_number() over (partition by p.gvkey, p.fyear order by l.cik, l.link_start nulls first, l.link_end nulls first) as rn
  from panel p join ({LINK_CLEAN_SQL}) l
    on p.gvkey = l.gvkey
   and (l.link_start is null or l.link_start < make_date(p.fyear - 1, 12, 31))
   and (coalesce(l.end_open, false) or l.link_end > make_date(p.fyear, 12, 31))
  where p.fyear between 1950 and 2020) t
where rn = 1""")
def q_link_contain(spark, d):
    lk = links.clean_links(V.links_raw(spark, d)).select("cik", "gvkey", "link_start", "link_end", "end_open")
    c = links.containing_links(V.panel(spark, d).select("gvkey", "fyear"), lk)
    c = c.select("gvkey", "fyear", "cik", "link_start", "link_end")
    return dedup.keep_first(c, ["gvkey", "fyear"], ["cik", "link_start", "link_end"])


@query("filing_panel", f"""
select l.cik, l.gvkey, l.fyear, l.fname, round(p.sale, {ROUND}) as sale
from ({LINKED_FILINGS_SQL}) l join panel p on l.gvkey = p.gvkey and l.fyear = p.fyear
where p.sale > 5""")
def q_filing_panel(spark, d):
    fp = links.filing_panel(_linked_filings(spark, d), V.panel(spark, d).select("gvkey", "fyear", "sale"))
    return fp.select("cik", "gvkey", "fyear", "fname", r("sale").alias("sale"))


# =========================================================================== dedup

@query("dedup_first", """
select cik, yr, rdate, fname, form from (
  select cik, cast(year(rdate) as integer) as yr, rdate, fname, form,
    row_number() over (partition by cik, year(rdate) order by rdate, fname, form) as rn
  from filings) t
where rn = 1""")
def q_dedup_first(spark, d):
    f = V.filings(spark, d).withColumn("yr", F.year("rdate").cast("int"))
    return dedup.keep_first(f, ["cik", "yr"], ["rdate", "fname"]).select("cik", "yr", "rdate", "fname", "form")


def _ipo_anchors(spark, d):
    p = V.panel(spark, d).join(V.company(spark, d).select("gvkey", "ipo_year", "cusip"), "gvkey", "left")
    return (p.where(F.col("fyear") - F.col("ipo_year") > 0).groupBy("gvkey")
             .agg(F.max("ipo_year").alias("fyear"), F.min("cusip").alias("cusip")))


IPO_ANCHORS_SQL = """
select p.gvkey, max(c.ipo_year) as fyear, min(c.cusip) as cusip
from panel p join company c on p.gvkey = c.gvkey
where p.fyear - c.ipo_year > 0 group by p.gvkey"""


@query("dedup_last", f"""
select gvkey, fyear, datadate, assets, cusip from (
  select *, row_number() over (partition by gvkey, fyear
                               order by datadate desc nulls last, assets desc nulls last, cusip desc nulls last) as rn
  from (select gvkey, fyear, datadate, round(assets, {ROUND}) as assets, cast(null as varchar) as cusip from panel
        union all
        select gvkey, fyear, cast(null as date), cast(null as double), cusip from ({IPO_ANCHORS_SQL}) a) u) t
where rn = 1""")
def q_dedup_last(spark, d):
    base = V.panel(spark, d).select("gvkey", "fyear", "datadate", r("assets").alias("assets"))
    u = P.add_anchor_rows(base, _ipo_anchors(spark, d))
    return dedup.keep_last(u, ["gvkey", "fyear"], ["datadate"]).select("gvkey", "fyear", "datadate", "assets", "cusip")


@query("synthetic_rows", f"""
select gvkey, fyear, round(assets, {ROUND}) as assets, cast(null as varchar) as cusip from panel
union all
select gvkey, fyear, cast(null as double), cusip from ({IPO_ANCHORS_SQL}) a""")
def q_synthetic_rows(spark, d):
    base = V.panel(spark, d).select("gvkey", "fyear", r("assets").alias("assets"))
    return P.add_anchor_rows(base, _ipo_anchors(spark, d)).select("gvkey", "fyear", "assets", "cusip")


# =========================================================================== scalar functions

@query("fiscal_year", """
select fname, cast(year(rdate) - case when month(rdate) < 6 then 1 else 0 end as integer) as fyear
from filings""")
def q_fiscal_year(spark, d):
    return V.filings(spark, d).select("fname", fiscal_year("rdate").alias("fyear"))


@query("code_prefix", """
select gvkey, substring(cast(sic as varchar), 1, 3) as sic3, substring(cast(sic as varchar), 1, 2) as sic2
from company""")
def q_code_prefix(spark, d):
    return V.company(spark, d).select("gvkey", code_prefix("sic", 3).alias("sic3"), code_prefix("sic", 2).alias("sic2"))


@query("firm_age", f"""
select gvkey, fyear, firstyear,
  cast(case when fyear - firstyear < 0 then 0 else fyear - firstyear end as integer) as age
from (
  select p.gvkey, p.fyear,
    cast(coalesce(fc.founding, year(coalesce(c.ipodate, a.crsp_first_date, cf.comp_first_date))) as integer) as firstyear
  from panel p
  left join company c on p.gvkey = c.gvkey
  left join ({ANNUAL_RETURN_SQL}) a on a.permno = p.gvkey and a.yr = p.fyear
  left join (select gvkey, min(datadate) as comp_first_date from panel group by gvkey) cf on cf.gvkey = p.gvkey
  left join ({FOUNDING_CLEAN_SQL}) fc on fc.cusip = c.cusip) t""")
def q_firm_age(spark, d):
    p = V.panel(spark, d)
    p = returns.first_seen(p, "gvkey", "datadate", "comp_first_date")
    a = _annual_return(spark, d).select(F.col("permno").alias("gvkey"), F.col("yr").alias("fyear"), "crsp_first_date")
    c = V.company(spark, d).select("gvkey", "cusip", "ipodate")
    fc = I.clean_founding(V.founding(spark, d))
    t = p.join(c, "gvkey", "left").join(a, ["gvkey", "fyear"], "left").join(fc, "cusip", "left")
    return returns.firm_age(t).select("gvkey", "fyear", "firstyear", "age")


@query("sga_net", f"""
select gvkey, fyear, round(case when xsga is null then 0.0::double
  when coalesce(cogs, 0.0::double) > coalesce(xrd, 0.0::double) and coalesce(xrd, 0.0::double) > coalesce(xsga, 0.0::double) then coalesce(xsga, 0.0::double)
  else coalesce(xsga, 0.0::double) - coalesce(xrd, 0.0::double) - coalesce(rdip, 0.0::double) end, {ROUND}) as xsga_net
from panel""")
def q_sga_net(spark, d):
    return V.panel(spark, d).select("gvkey", "fyear", r(net_sga("xsga", "xrd", "rdip", "cogs")).alias("xsga_net"))


@query("sic_rates", f"""
select gvkey, sic, {sic_case_sql('sic', 'delta')} as theta_g2, {sic_case_sql('sic', 'gamma')} as gamma_o2
from company""")
def q_sic_rates(spark, d):
    return I.attach_sic_rates(V.company(spark, d).select("gvkey", "sic"), "sic")


# =========================================================================== panel windows

@query("rd_pivot_rule", f"""
select gvkey, fyear, round(case when xrd is null and (fyear >= {PIVOT_YEAR}
      or (fyear < {PIVOT_YEAR} and has_p = 1 and (p_val is null or p_val = 0))) then 0.0::double else xrd end, {ROUND}) as xrd
from (select *, max(case when fyear = {PIVOT_YEAR} then 1 end) over (partition by gvkey) as has_p,
             max(case when fyear = {PIVOT_YEAR} then xrd end) over (partition by gvkey) as p_val
      from panel) t""")
def q_rd_pivot_rule(spark, d):
    p = P.pivot_zero_fill(V.panel(spark, d), "gvkey", "fyear", "xrd", PIVOT_YEAR)
    return p.select("gvkey", "fyear", r("xrd").alias("xrd"))


def nearest_fill_sql(col: str, order: str, flag: str) -> str:
    w_prev = f"partition by gvkey order by rn rows between unbounded preceding and current row"
    w_next = f"partition by gvkey order by rn rows between 1 following and unbounded following"
    return f"""
select gvkey, fyear, round(case when {col} is null and {flag} then
    case when prn is null then nv when nrn is null then pv when rn - prn <= nrn - rn then pv else nv end
  else {col} end, {ROUND}) as {col}
from (select *,
        max(case when {col} is not null then rn end) over ({w_prev}) as prn,
        last_value({col} ignore nulls) over ({w_prev}) as pv,
        min(case when {col} is not null then rn end) over ({w_next}) as nrn,
        first_value({col} ignore nulls) over ({w_next}) as nv
      from (select *, row_number() over (partition by gvkey order by {order}) as rn from panel) b) c"""


@query("nearest_fill", nearest_fill_sql("xsga", "datadate, fyear", "assets is null"))
def q_nearest_fill(spark, d):
    p = P.nearest_fill(V.panel(spark, d), "gvkey", ["datadate", "fyear"], "xsga", when=F.col("assets").isNull())
    return p.select("gvkey", "fyear", r("xsga").alias("xsga"))


@query("bfill", f"""
select gvkey, fyear, round(first_value(xrd ignore nulls) over (partition by gvkey order by fyear
  rows between current row and unbounded following), {ROUND}) as xrd_bfill
from panel""")
def q_bfill(spark, d):
    p = P.bfill(V.panel(spark, d), "gvkey", ["fyear"], "xrd", suffix="_bfill")
    return p.select("gvkey", "fyear", r("xrd_bfill").alias("xrd_bfill"))


@query("densify", f"""
select gvkey, cast(unnest(generate_series(fyear, coalesce(nx - 1, fyear))) as integer) as fyear, src_year, assets, xrd
from (select gvkey, fyear, fyear as src_year, round(assets, {ROUND}) as assets, round(xrd, {ROUND}) as xrd,
        lead(fyear) over (partition by gvkey order by fyear) as nx from panel) t""")
def q_densify(spark, d):
    p = V.panel(spark, d).select("gvkey", "fyear", r("assets").alias("assets"), r("xrd").alias("xrd"))
    return P.densify_years(p, "gvkey", "fyear", src="src_year").select("gvkey", "fyear", "src_year", "assets", "xrd")


def _aged_panel(spark, d):
    c = V.company(spark, d).select("gvkey", "ipo_year")
    return V.panel(spark, d).join(c, "gvkey", "left") \
        .withColumn("ageipo", (F.col("fyear") - F.col("ipo_year")).cast("int"))


@query("growth_by_age", f"""
select cast(age as integer) as age, n, round(grate, {ROUND}) as grate from ({growth_sql('xsga', 'a.age >= 1')}) g""")
def q_growth_by_age(spark, d):
    g = I.growth_by_age(_aged_panel(spark, d), "xsga")
    return g.select("age", "n", r("grate").alias("grate"))


@query("growth_pre", f"""
select round(avg(grate), {ROUND}) as grate_pre from ({growth_sql('xsga', 'a.age between -1 and 0')}) g""")
def q_growth_pre(spark, d):
    return I.growth_pre(_aged_panel(spark, d), "xsga").select(r("grate_pre").alias("grate_pre"))


@query("backcast_age", f"""
select gvkey, fyear, round(case when xrd is null then nlx - (nc - cc) else lx end, {ROUND}) as logxrd
from (select *,
        first_value(case when xrd is not null then lx end ignore nulls) over
          (partition by gvkey order by fyear rows between 1 following and unbounded following) as nlx,
        first_value(case when xrd is not null then cc end ignore nulls) over
          (partition by gvkey order by fyear rows between 1 following and unbounded following) as nc
      from (select *, sum(coalesce(grate, 0.0::double)) over
                (partition by gvkey order by fyear rows between unbounded preceding and current row) as cc
            from (select t.gvkey, t.fyear, t.xrd, g.grate,
                    case when t.xrd > 0 then ln(t.xrd) else t.xrd end as lx
                  from ({AGE_SQL}) t left join ({growth_sql('xrd', 'a.age >= 1')}) g on t.age = g.age) u) v) w""")
def q_backcast_age(spark, d):
    p = _aged_panel(spark, d)
    g = I.growth_by_age(p, "xrd").select(F.col("age").alias("ageipo"), "grate")
    p = p.join(g, "ageipo", "left").withColumn("logxrd", I.guarded_log("xrd"))
    p = P.backcast_rates(p, "gvkey", ["fyear"], "xrd", "logxrd", "grate")
    return p.select("gvkey", "fyear", r("logxrd").alias("logxrd"))


@query("backcast_pre", f"""
select gvkey, fyear,
  round(case when lx is null then nlx - coalesce((select avg(grate) from ({growth_sql('xsga', 'a.age between -1 and 0')}) g), 0.0::double)
                                        * cast(nrn - rn as double)
             else lx end, {ROUND}) as logxsga
from (select *,
        first_value(case when lx is not null then lx end ignore nulls) over
          (partition by gvkey order by fyear rows between 1 following and unbounded following) as nlx,
        first_value(case when lx is not null then rn end ignore nulls) over
          (partition by gvkey order by fyear rows between 1 following and unbounded following) as nrn
      from (select gvkey, fyear, case when xsga > 0 then ln(xsga) else xsga end as lx,
              row_number() over (partition by gvkey order by fyear) as rn
            from panel) u) w""")
def q_backcast_pre(spark, d):
    p = _aged_panel(spark, d)
    s = I.growth_pre(p, "xsga").select(F.coalesce("grate_pre", F.lit(0.0)))
    # one-row global aggregate, attached as a scalar subquery (no join)
    p = p.withColumn("__s", s.scalar())
    p = p.withColumn("logxsga", I.guarded_log("xsga"))
    p = P.backcast_constant(p, "gvkey", ["fyear"], "logxsga", F.col("__s"))
    return p.select("gvkey", "fyear", r("logxsga").alias("logxsga"))


@query("founding_year", f"""
select gvkey, cast(coalesce(case when not (founding > firstcomp) or firstcomp is null then founding end,
    case when ipo is not null then case when firstcomp <= ipo - 8 then firstcomp else ipo - 8 end end,
    firstcomp) as integer) as founding_year
from (select fc.gvkey, fc.firstcomp, year(c.ipodate) as ipo, l.founding
      from (select gvkey, min(fyear) as firstcomp from panel group by gvkey) fc
      left join company c on fc.gvkey = c.gvkey
      left join (select cusip, min(founding) as founding from ({FOUNDING_CLEAN_SQL}) x group by cusip) l
        on c.cusip = l.cusip) t""")
def q_founding_year(spark, d):
    return I.founding_year(V.panel(spark, d), V.company(spark, d), V.founding(spark, d))


@query("capital_stock", f"""
with recursive b as (
  select p.gvkey, p.fyear, coalesce(p.xrd, 0.0::double) as rd, coalesce(p.xsga, 0.0::double) as sg,
    {sic_case_sql('c.sic', 'delta')} as dl, {sic_case_sql('c.sic', 'gamma')} as gm,
    row_number() over (partition by p.gvkey order by p.fyear) as rn
  from panel p left join company c on p.gvkey = c.gvkey),
rec as (
  select gvkey, fyear, rn, 0.0::double as k, 0.0::double as o from b where rn = 1
  union all
  select b.gvkey, b.fyear, b.rn, (1.0::double - b.dl) * rec.k + b.rd, 0.8::double * rec.o + b.gm * b.sg
  from rec join b on b.gvkey = rec.gvkey and b.rn = rec.rn + 1)
select gvkey, fyear, cast(cast(k as float) as double) as kcap, cast(cast(o as float) as double) as ocap from rec""")
def q_capital_stock(spark, d):
    p = V.panel(spark, d).join(V.company(spark, d).select("gvkey", "sic"), "gvkey", "left")
    p = I.attach_sic_rates(p.select("gvkey", "fyear", I.zero_if_null("xrd").alias("xrd"),
                                    I.zero_if_null("xsga").alias("xsga"), "sic"), "sic")
    s = I.capital_stocks(p.drop("sic"), kout="kcap", oout="ocap")
    return s.select("gvkey", "fyear", single("kcap"), single("ocap"))


@query("intangible_stocks")
def q_intangible_stocks(spark, d):
    s = I.intangible_stocks(V.panel(spark, d), V.company(spark, d), V.founding(spark, d),
                            exclude=EXCLUDED_FIRMS, pivot_year=PIVOT_YEAR)
    return s.select("gvkey", "fyear", single("kcap_v2"), single("ocap_v2"))


# =========================================================================== text

FLAGS_SQL = """
select fname, item1, item1a, item7,
  cast(length(item1) < 10000 as integer) as item1_na,
  cast(length(item1a) < 10000 as integer) as item1a_na,
  cast(length(item7) < 10000 as integer) as item7_na
from filing_text"""


@query("text_flags", f"select fname, item1_na, item1a_na, item7_na from ({FLAGS_SQL}) t")
def q_text_flags(spark, d):
    return text.text_flags(V.filing_text(spark, d)).select("fname", "item1_na", "item1a_na", "item7_na")


@query("text_missing_share", f"select round(avg(cast(item1_na as double)), {ROUND}) as item1_na_share from ({FLAGS_SQL}) t")
def q_text_missing_share(spark, d):
    s = text.missing_share(text.text_flags(V.filing_text(spark, d)))
    return s.select(r("item1_na_share").alias("item1_na_share"))


CONCAT_SQL = f"""
select fname, item1, case
    when item1_na = 0 and item1a_na = 0 and item7_na = 1 then item1 || item1a
    when item1_na = 0 and item1a_na = 1 and item7_na = 0 then item1 || item7
    when item1_na = 0 and item1a_na = 1 and item7_na = 1 then item1
    else item1 || item1a || item7 end as text
from ({FLAGS_SQL}) t"""


@query("text_concat", f"""
select fname, cast(length(text) as bigint) as n_chars, md5(text) as text_md5 from ({CONCAT_SQL}) c""")
def q_text_concat(spark, d):
    t = text.concat_sections(text.text_flags(V.filing_text(spark, d)))
    return t.select("fname", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


SECTION_PATTERNS = {
    "h1": r"(?s)<h1>(.*?)</h1>",
    "nav": r"(?s)<nav>(.*?)</nav>",
    "article": r"(?s)<article>(.*?)</article>",
}
# a heading that only some pages have: pages whose title starts with a vowel
PARTIAL_PATTERNS = {"title": r"<title>([AEIOUÉaeiou][^<]*)</title>", "h1": r"(?s)<h1>(.*?)</h1>"}


def _sections(spark, d):
    pages = V.table(spark, d, "pages").select("page_id", "url", "html")
    return text.extract_sections(pages, "page_id", "html", SECTION_PATTERNS)


def _ok_cond_sql() -> str:
    return " and ".join(f"regexp_matches(html, '{p}')" for p in SECTION_PATTERNS.values())


@query("sections", f"""
select page_id, url, regexp_extract(html, '{SECTION_PATTERNS['h1']}', 1) as h1,
  cast(length(regexp_extract(html, '{SECTION_PATTERNS['nav']}', 1)) as bigint) as nav_chars,
  cast(length(regexp_extract(html, '{SECTION_PATTERNS['article']}', 1)) as bigint) as article_chars,
  md5(regexp_extract(html, '{SECTION_PATTERNS['article']}', 1)) as article_md5
from pages where {_ok_cond_sql()}""")
def q_sections(spark, d):
    ok, _ = _sections(spark, d)
    return _section_summary(ok)


def _section_summary(ok: DataFrame) -> DataFrame:
    return ok.select("page_id", "url", "h1", F.length("nav").cast("long").alias("nav_chars"),
                     F.length("article").cast("long").alias("article_chars"), F.md5("article").alias("article_md5"))


@query("sections_errors", f"""
select page_id, url from pages
where not (regexp_matches(html, '{PARTIAL_PATTERNS['title']}') and regexp_matches(html, '{PARTIAL_PATTERNS['h1']}'))""")
def q_sections_errors(spark, d):
    pages = V.table(spark, d, "pages").select("page_id", "url", "html")
    _, err = text.extract_sections(pages, "page_id", "html", PARTIAL_PATTERNS)
    return err.select("page_id", "url")


def chunk_sql(source: str, key: str, textcol: str) -> str:
    return f"""
select {key}, chunk_no, cast(length(chunk) as bigint) as n_chars, md5(chunk) as chunk_md5
from ({chunk_text_sql(source, key, textcol)}) c"""


CHUNK_WS = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CHUNK_NON_WS = CHUNK_WS.replace("[", "[^", 1)


def chunk_text_sql(source: str, key: str, textcol: str) -> str:
    # literal white space classes and cap, written apart from the library's
    ws, nws = CHUNK_WS, CHUNK_NON_WS
    return f"""
select {key}, cast(chunk_no as bigint) as chunk_no, chunk
from (select {key}, unnest(chunks) as chunk, unnest(range(len(chunks))) as chunk_no
      from (select {key}, list_filter(flatten(list_transform(
                list_transform(string_split({textcol}, chr(10)), lambda p: regexp_replace(p, '{ws}{{2,}}', ' ', 'g')),
                lambda p: case when length(p) > 2048
                               then string_split(regexp_replace(p, '([.!?]){ws}+', '\\1' || chr(1), 'g'), chr(1))
                               else [p] end)),
              lambda c: regexp_matches(c, '{nws}')) as chunks
            from {source} where length({textcol}) > 0) q) u"""


@query("chunk_docs", chunk_sql("documents", "doc_id", "text"))
def q_chunk_docs(spark, d):
    c = text.chunk_docs(V.table(spark, d, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_no", "n_chars", F.md5("chunk").alias("chunk_md5"))


# =========================================================================== vectors

POOL_SQL = """
select m.label, m.i, m.m / n.nrm as v
from (select label, i, sum(w * x) / sum(w) as m
      from (select label, cast(vec_id % 7 + 1 as double) as w, cast(unnest(embedding) as double) as x,
              unnest(range(len(embedding))) as i from embeddings) e
      group by label, i) m
join (select label, sqrt(sum(m * m)) as nrm
      from (select label, i, sum(w * x) / sum(w) as m
            from (select label, cast(vec_id % 7 + 1 as double) as w, cast(unnest(embedding) as double) as x,
                    unnest(range(len(embedding))) as i from embeddings) e
            group by label, i) mm
      group by label) n on m.label = n.label
where n.nrm > 0"""


def _weighted_embeddings(spark, d):
    e = V.table(spark, d, "embeddings")
    return e.withColumn("w", (F.col("vec_id") % 7 + 1).cast("double"))


@query("pool_vectors", f"""
select label, cast(i as bigint) as i, round(v, {ROUND}) as v from ({POOL_SQL}) p""")
def q_pool_vectors(spark, d):
    pooled = vectors.pool_vectors(_weighted_embeddings(spark, d), "label", "embedding", "w")
    return vectors.explode_vector(pooled, "label", "vec").select("label", "i", r("v").alias("v"))


@query("cosine_to_pooled", f"""
select vec_id, label, round(case when nx > 0 and np > 0 then dt / (nx * np) end, {ROUND}) as cosine
from (select e.vec_id, e.label, sum(e.x * p.v) as dt, sqrt(sum(e.x * e.x)) as nx, sqrt(sum(p.v * p.v)) as np
      from (select vec_id, label, cast(unnest(embedding) as double) as x, unnest(range(len(embedding))) as i
            from embeddings) e
      join ({POOL_SQL}) p on e.label = p.label and e.i = p.i
      group by e.vec_id, e.label) t""")
def q_cosine_to_pooled(spark, d):
    c = vectors.cosine_to_pooled(_weighted_embeddings(spark, d), "label", "embedding", "w")
    return c.select("vec_id", "label", r("cosine").alias("cosine"))


LETTERS = "aeiounrst"


class LetterCounts:
    """Encoder that SQL can express: how often each of a few letters occurs."""

    def encode(self, texts):
        return [[t.count(c) for c in LETTERS] for t in texts]


def pooled_letters_sql(source: str, field: str) -> str:
    """(fname, field, i, v): unit vector of the letter counts of a text's chunks, weighted by length."""
    ws = r"[\x09\x0A\x0B\x0C\x0D\x20]"
    counts = ", ".join(f"length(chunk) - length(replace(chunk, '{c}', ''))" for c in LETTERS)
    return f"""
select fname, '{field}' as field, i, s / sqrt(sum(s * s) over (partition by fname)) as v
from (select fname, i, cast(sum(n * x) as double) as s
      from (select fname, length(chunk) as n, unnest([{counts}]) as x, unnest(range({len(LETTERS)})) as i
            from ({chunk_text_sql(source, 'fname', field)}) c) u
      group by fname, i) t"""


EMBED_SQL = f"""
with concat_text as ({CONCAT_SQL}),
pooled as ({pooled_letters_sql('concat_text', 'text')} union all {pooled_letters_sql('concat_text', 'item1')})
select fname, field, cast(i as bigint) as i, round(v, {ROUND}) as v from pooled where v is not null and not isnan(v)"""


@query("embed_docs", EMBED_SQL)
def q_embed_docs(spark, d):
    t = text.concat_sections(text.text_flags(V.filing_text(spark, d))).select("fname", "text", "item1")
    t = t.where((F.length("text") > 0) & (F.length("item1") > 0))  # P13: both texts
    e = vectors.embed_docs(t, "fname", {"text": "text", "item1": "item1"}, factory=LetterCounts)
    both = e.select("fname", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("vec")) for c in ("text", "item1")))).alias("e"))
    return vectors.explode_vector(both.select("fname", "e.*"), ["fname", "field"], "vec").withColumn("v", r("v"))


@query("encode_chunks", f"""
select doc_id, chunk_no, cast(unnest([{', '.join(f"length(chunk) - length(replace(chunk, '{c}', ''))" for c in LETTERS)}]) as double) as v,
  cast(unnest(range({len(LETTERS)})) as bigint) as i
from ({chunk_text_sql('documents', 'doc_id', 'text')}) c""")
def q_encode_chunks(spark, d):
    c = text.chunk_docs(V.table(spark, d, "documents"), "doc_id", "text")
    e = vectors.embed_chunks(c, "chunk", "vec", factory=LetterCounts, keep_text=False)
    return vectors.explode_vector(e, ["doc_id", "chunk_no"], "vec").withColumn("v", F.col("v").cast("double"))


# =========================================================================== incremental

@query("anti_unprocessed", """
select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)""")
def q_anti_unprocessed(spark, d):
    from ..streaming.incremental import unprocessed
    return unprocessed(V.table(spark, d, "documents").select("doc_id"),
                       V.table(spark, d, "labels").select("doc_id"), "doc_id")


# =========================================================================== job C oracle

NEAREST_PICK_SQL = "case when prn is null then nv when nrn is null then pv when rn - prn <= nrn - rn then pv else nv end"


def _nearest_cte(src: str, col: str, part: str, order: str, flag: str) -> str:
    wp = f"partition by {part} order by rn rows between unbounded preceding and current row"
    wn = f"partition by {part} order by rn rows between 1 following and unbounded following"
    return f"""
select * exclude (rn, prn, pv, nrn, nv) replace (case when {col} is null and ({flag}) then {NEAREST_PICK_SQL} else {col} end as {col})
from (select *,
        max(case when {col} is not null then rn end) over ({wp}) as prn,
        last_value({col} ignore nulls) over ({wp}) as pv,
        min(case when {col} is not null then rn end) over ({wn}) as nrn,
        first_value({col} ignore nulls) over ({wn}) as nv
      from (select *, row_number() over (partition by {part} order by {order}) as rn from {src}) a) b"""


def _growth_cte(src: str, value: str, age_filter: str) -> str:
    return f"""
select a.ageipo as age, avg(ln(a.{value}) - ln(b.{value})) as grate
from {src} a join {src} b on a.gvkey = b.gvkey and a.ageipo = b.ageipo + 1
where {age_filter} and a.{value} > 0 and b.{value} > 0 group by a.ageipo"""


def _densify_cte(src: str) -> str:
    return f"""
select * exclude (nx, fy0), cast(fy0 as integer) as fyear
from (select * exclude (fyear), unnest(generate_series(fyear, coalesce(nx - 1, fyear))) as fy0
      from (select *, lead(fyear) over (partition by gvkey order by fyear) as nx from {src}) a) b"""


P_ = PIVOT_YEAR
JOB_C_SQL = f"""
with recursive
s1 as (
  select p.gvkey, p.fyear, p.datadate, p.assets, p.xsga, p.xrd, p.rdip, p.cogs,
    cast(c.sic as integer) as sich, c.ipodate, c.cusip, c.seq
  from panel p left join company c on p.gvkey = c.gvkey
  where p.gvkey not in ({', '.join(map(str, EXCLUDED_FIRMS))})),
s1b as (
  select *, cast(min(fyear) over (partition by gvkey) as integer) as firstcomp,
    case when assets is null then 1 else 0 end as atnan
  from s1 where fyear is not null),
s2 as ({_nearest_cte('s1b', 'xsga', 'gvkey', 'datadate, fyear', 'atnan = 1')}),
s3 as ({_nearest_cte('s2', 'xrd', 'gvkey, (fyear >= ' + str(P_) + ')', 'datadate, fyear', f'atnan = 1 and fyear >= {P_}')}),
s4 as (
  select * exclude (has_p, p_val) replace (
    case when xrd is null and (fyear >= {P_} or (has_p = 1 and (p_val is null or p_val = 0))) then 0.0::double else xrd end as xrd)
  from (select *, max(case when fyear = {P_} then 1 end) over (partition by gvkey) as has_p,
               max(case when fyear = {P_} then xrd end) over (partition by gvkey) as p_val from s3) t),
s5 as (
  select * replace (case when xsga is null then 0.0::double
      when coalesce(cogs, 0.0::double) > coalesce(xrd, 0.0::double) and coalesce(xrd, 0.0::double) > coalesce(xsga, 0.0::double)
        then coalesce(xsga, 0.0::double)
      else coalesce(xsga, 0.0::double) - coalesce(xrd, 0.0::double) - coalesce(rdip, 0.0::double) end as xsga)
  from s4),
s6 as (
  select *, cast(row_number() over (partition by gvkey order by fyear, datadate) - 1 as bigint) as cnt,
    cast(fyear - year(ipodate) as integer) as ageipo
  from s5),
g_rd as ({_growth_cte('s6', 'xrd', 'a.ageipo >= 1')}),
g_sga as ({_growth_cte('s6', 'xsga', 'a.ageipo >= 1')}),
pre as (
  select (select avg(grate) from ({_growth_cte('s6', 'xrd', 'a.ageipo between -1 and 0')}) x) as pre_xrd,
         (select avg(grate) from ({_growth_cte('s6', 'xsga', 'a.ageipo between -1 and 0')}) y) as pre_xsga),
s7 as (
  select *, max(case when fyear = {P_} then xrd end) over (partition by gvkey) > 0 as pivot_pos from s6),
s8 as ({_nearest_cte('s7', 'xrd', 'gvkey, (fyear <= ' + str(P_) + ')', 'fyear, datadate', f'coalesce(pivot_pos, false) and fyear <= {P_}')}),
s9 as (
  select * exclude (pivot_pos) replace (coalesce(xsga, 0.0::double) as xsga, coalesce(xrd, 0.0::double) as xrd) from s8),
s10u as (
  select *, 0 as src from s9
  union all by name
  select gvkey, max(year(ipodate))::integer as fyear, min(cusip) as cusip, 1 as src from s9 where ageipo > 0 group by gvkey),
s10d as (
  select * exclude (rk) from (
    select *, row_number() over (partition by gvkey, fyear order by datadate desc nulls last, seq desc nulls last, src desc) as rk
    from s10u) t where rk = 1),
s10 as ({_densify_cte('s10d')}),
s11a as (
  select s10.*, g_rd.grate as grate_xrd, g_sga.grate as grate_xsga,
    case when s10.xsga > 0 then ln(s10.xsga) else s10.xsga end as logxsga,
    case when s10.xrd > 0 then ln(s10.xrd) else s10.xrd end as logxrd
  from s10 left join g_rd on s10.ageipo = g_rd.age left join g_sga on s10.ageipo = g_sga.age),
s11b as (
  select *,
    sum(coalesce(grate_xrd, 0.0::double)) over (partition by gvkey order by fyear rows between unbounded preceding and current row) as c_rd,
    sum(coalesce(grate_xsga, 0.0::double)) over (partition by gvkey order by fyear rows between unbounded preceding and current row) as c_sg
  from s11a),
s11 as (
  select * exclude (c_rd, c_sg, n_lrd, n_crd, n_lsg, n_csg) replace (
      case when xrd is null then n_lrd - (n_crd - c_rd) else logxrd end as logxrd,
      case when xsga is null then n_lsg - (n_csg - c_sg) else logxsga end as logxsga)
  from (select *,
          first_value(case when xrd is not null then logxrd end ignore nulls) over w as n_lrd,
          first_value(case when xrd is not null then c_rd end ignore nulls) over w as n_crd,
          first_value(case when xsga is not null then logxsga end ignore nulls) over w as n_lsg,
          first_value(case when xsga is not null then c_sg end ignore nulls) over w as n_csg
        from s11b
        window w as (partition by gvkey order by fyear rows between 1 following and unbounded following)) t),
listed as (select cusip, min(founding) as listed from ({FOUNDING_CLEAN_SQL}) x group by cusip),
s12a as (
  select s11.*, listed.listed,
    cast(coalesce(case when not (listed.listed > s11.firstcomp) or s11.firstcomp is null then listed.listed end,
                  case when year(s11.ipodate) is not null then
                    case when s11.firstcomp <= year(s11.ipodate) - 8 then s11.firstcomp else year(s11.ipodate) - 8 end end,
                  s11.firstcomp) as integer) as est
  from s11 left join listed on s11.cusip = listed.cusip),
fy as (
  select gvkey, arg_min(est, fyear) as fy from s12a where cnt is not null and est is not null group by gvkey),
s13u as (
  select * exclude (listed, est) from s12a
  union all by name
  select s.gvkey, fy.fy as fyear, min(s.cusip) as cusip, 2 as src
  from s12a s join fy on s.gvkey = fy.gvkey group by s.gvkey, fy.fy),
s13d as (
  select * exclude (rk) from (
    select *, row_number() over (partition by gvkey, fyear order by cnt desc nulls last, src desc) as rk from s13u) t
  where rk = 1),
s13e as ({_densify_cte('s13d')}),
s13 as (
  select * replace (
    first_value(firstcomp ignore nulls) over w as firstcomp,
    first_value(ipodate ignore nulls) over w as ipodate)
  from s13e window w as (partition by gvkey order by fyear rows between current row and unbounded following)),
s14a as (select *, row_number() over (partition by gvkey order by fyear) as rn from s13, pre),
s14 as (
  select * exclude (n_lrd, n_rrd, n_lsg, n_rsg) replace (
      case when logxrd is null then n_lrd - coalesce(pre_xrd, 0.0::double) * cast(n_rrd - rn as double) else logxrd end as logxrd,
      case when logxsga is null then n_lsg - coalesce(pre_xsga, 0.0::double) * cast(n_rsg - rn as double) else logxsga end as logxsga)
  from (select *,
          first_value(case when logxrd is not null then logxrd end ignore nulls) over w as n_lrd,
          first_value(case when logxrd is not null then rn end ignore nulls) over w as n_rrd,
          first_value(case when logxsga is not null then logxsga end ignore nulls) over w as n_lsg,
          first_value(case when logxsga is not null then rn end ignore nulls) over w as n_rsg
        from s14a
        window w as (partition by gvkey order by fyear rows between 1 following and unbounded following)) t),
s15 as (
  select * replace (
      case when not (xsga < 0) or xsga is null then exp(logxsga) else xsga end as xsga,
      case when not (xrd < 0) or xrd is null then exp(logxrd) else xrd end as xrd)
  from s14),
s16 as (
  select gvkey, fyear, cnt, xrd, xsga, {sic_case_sql('sich', 'delta')} as dl, {sic_case_sql('sich', 'gamma')} as gm,
    row_number() over (partition by gvkey order by fyear) as rn
  from s15),
rec as (
  select gvkey, fyear, rn, cnt, 0.0::double as k, 0.0::double as o from s16 where rn = 1
  union all
  select b.gvkey, b.fyear, b.rn, b.cnt, (1.0::double - b.dl) * rec.k + b.xrd, 0.8::double * rec.o + b.gm * b.xsga
  from rec join s16 b on b.gvkey = rec.gvkey and b.rn = rec.rn + 1)
select gvkey, fyear, cast(cast(k as float) as double) as kcap_v2, cast(cast(o as float) as double) as ocap_v2 from rec where cnt is not null"""

SQL["intangible_stocks"] = JOB_C_SQL

# age_mode='recomputed' (quirk Q5): after the first densify every row's age is
# its year minus the firm's IPO year, so gap and IPO-year rows get their own rate
JOB_C_RECOMPUTED_SQL = JOB_C_SQL.replace(
    "s10 as (" + _densify_cte("s10d") + "),",
    "s10r as (" + _densify_cte("s10d") + "),\n"
    "s10 as (select * replace (cast(fyear - max(year(ipodate)) over (partition by gvkey) as integer) as ageipo)"
    " from s10r),")
assert JOB_C_RECOMPUTED_SQL != JOB_C_SQL


@query("intangible_stocks_recomputed_age", JOB_C_RECOMPUTED_SQL)
def q_intangible_stocks_recomputed_age(spark, d):
    s = I.intangible_stocks(V.panel(spark, d), V.company(spark, d), V.founding(spark, d),
                            exclude=EXCLUDED_FIRMS, pivot_year=PIVOT_YEAR, age_mode="recomputed")
    return s.select("gvkey", "fyear", single("kcap_v2"), single("ocap_v2"))


# =========================================================================== streaming

@query("sections_stream", SQL["sections"])
def q_sections_stream(spark, d):
    """Section extraction as a file-source stream over landed page files
    (``availableNow``); the result must equal the batch query."""
    from pyspark.sql import types as T

    from ..streaming.incremental import incremental_sections

    base = scratch_path(spark, "sections_stream")
    pages = V.table(spark, d, "pages").select("page_id", "url", "html")
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                           T.StructField("html", T.StringType())])
    # files land twice; the second run sees the new ones only, or rows would double
    for landed in (F.col("page_id") % 2 == 0, F.coalesce(F.col("page_id") % 2 != 0, F.lit(True))):
        pages.where(landed).write.mode("append").parquet(f"{base}/in")
        incremental_sections(spark, f"{base}/in", schema, "page_id", "html", SECTION_PATTERNS,
                             f"{base}/ok", f"{base}/err", f"{base}/_checkpoint")
    ok = spark.read.parquet(f"{base}/ok").drop("batch")
    return _section_summary(ok)



# =========================================================================== end-to-end jobs A and B

CCM_SQL = f"""
select gvkey, datadate, fyear, permno, permco, linkdt, linkenddt from (
  select p.gvkey, p.datadate, p.fyear, l.cik as permno, l.cik % 50 as permco,
    l.link_start as linkdt, l.link_end as linkenddt,
    row_number() over (partition by l.cik % 50, p.gvkey, p.datadate order by l.cik, l.link_start nulls first, l.link_end nulls first) as rn
  from panel p join ({LINK_CLEAN_SQL}) l
    on p.gvkey = l.gvkey
   and (l.link_start is null or l.link_start < make_date(p.fyear - 1, 12, 31))
   and (coalesce(l.end_open, false) or l.link_end > make_date(p.fyear, 12, 31))
  where p.fyear between 1950 and 2020) t
where rn = 1"""


@query("panel_with_returns", f"""
select gvkey, fyear, permno, round(ret, {ROUND}) as ret, crsp_first_date, comp_first_date, founding, firstyear,
  cast(case when year - firstyear < 0 then 0 else year - firstyear end as integer) as age
from (
  select t2.*, cf.comp_first_date, fr.founding,
    cast(coalesce(fr.founding, year(coalesce(t2.ipodate, t2.crsp_first_date, cf.comp_first_date))) as integer) as firstyear
  from (
    select t1.*, ar.crsp_first_date, ar.ret
    from (select t0.*, ccm.permno, ccm.permco
          from (select p.gvkey, p.fyear as year, p.fyear, p.datadate, c.cusip, c.ipodate, p.assets, p.sale
                from panel p left join company c on p.gvkey = c.gvkey) t0
          left join ({CCM_SQL}) ccm on t0.gvkey = ccm.gvkey and t0.datadate = ccm.datadate and t0.fyear = ccm.fyear) t1
    left join ({ANNUAL_RETURN_SQL}) ar on t1.permno = ar.permno and t1.fyear = ar.yr) t2
  left join (select gvkey, min(datadate) as comp_first_date from panel group by gvkey) cf on t2.gvkey = cf.gvkey
  left join (select permco, cusip, min(founding) as founding
             from (select cusip, cast(try_cast(crsp_perm as double) as bigint) as permco, founding
                   from (select cusip, cast(case when founding in (-99, -9, 0) then null when founding = 201 then 2013
                                                 else founding end as integer) as founding, crsp_perm from founding) a
                   where cusip is not null and founding is not null and crsp_perm is not null and crsp_perm <> '.') b
             where permco is not null group by permco, cusip) fr
    on t2.permco = fr.permco and t2.cusip = fr.cusip
  where t2.assets is not null and t2.sale is not null) t""")
def q_panel_with_returns(spark, d):
    t = jobs.panel_with_returns(V.accounts(spark, d), V.ccm(spark, d), V.monthly(spark, d), V.founding(spark, d))
    return t.select("gvkey", "fyear", "permno", r("ret").alias("ret"), "crsp_first_date", "comp_first_date",
                    "founding", "firstyear", "age")


@query("filing_firm_panel", f"""
select l.cik, l.gvkey, l.fyear, l.fname, round(p.sale, {ROUND}) as sale,
  substring(cast(c.sic as varchar), 1, 3) as naics3, substring(cast(c.sic as varchar), 1, 2) as naics2
from ({LINKED_FILINGS_SQL}) l
join panel p on l.gvkey = p.gvkey and l.fyear = p.fyear
left join company c on p.gvkey = c.gvkey
where p.assets is not null and p.sale > 5""")
def q_filing_firm_panel(spark, d):
    t = jobs.filing_firm_panel(V.filings(spark, d), V.links_raw(spark, d), V.accounts(spark, d))
    return t.select("cik", "gvkey", "fyear", "fname", r("sale").alias("sale"), "naics3", "naics2")


# =========================================================================== streaming

@query("chunks_stream", SQL["chunk_docs"])
def q_chunks_stream(spark, d):
    """Chunking as a file-source stream over landed document files (X2): each
    micro-batch only sees files not processed before; the result equals the
    batch query."""
    from pyspark.sql import types as T

    from ..streaming.incremental import incremental_map

    base = scratch_path(spark, "chunks_stream")
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    for landed in (F.col("doc_id") % 2 == 0, F.coalesce(F.col("doc_id") % 2 != 0, F.lit(True))):
        docs.where(landed).write.mode("append").parquet(f"{base}/in")
        incremental_map(spark, f"{base}/in", schema, lambda b: text.chunk_docs(b, "doc_id", "text"),
                        f"{base}/out", f"{base}/_checkpoint")
    c = spark.read.parquet(f"{base}/out").drop("batch")
    return c.select("doc_id", "chunk_no", "n_chars", F.md5("chunk").alias("chunk_md5"))


# zero_mode='keep_zero' (quirk Q6): a zero flow stays 0 instead of coming back as exp(0) = 1
JOB_C_KEEP_ZERO_SQL = JOB_C_SQL.replace(
    "case when not (xsga < 0) or xsga is null then exp(logxsga) else xsga end as xsga,",
    "case when xsga = 0 then 0.0::double when not (xsga < 0) or xsga is null then exp(logxsga) else xsga end as xsga,",
).replace(
    "case when not (xrd < 0) or xrd is null then exp(logxrd) else xrd end as xrd)",
    "case when xrd = 0 then 0.0::double when not (xrd < 0) or xrd is null then exp(logxrd) else xrd end as xrd)",
)
assert JOB_C_KEEP_ZERO_SQL.count("0.0::double when not") == 2


@query("intangible_stocks_keep_zero", JOB_C_KEEP_ZERO_SQL)
def q_intangible_stocks_keep_zero(spark, d):
    s = I.intangible_stocks(V.panel(spark, d), V.company(spark, d), V.founding(spark, d),
                            exclude=EXCLUDED_FIRMS, pivot_year=PIVOT_YEAR, zero_mode="keep_zero")
    return s.select("gvkey", "fyear", single("kcap_v2"), single("ocap_v2"))

from . import catalog_io, catalog_scale  # noqa: E402, F401 - they register their queries here

"""Validity-interval link tables: cleaning, interval joins, containment joins,
and the filing index (S5, P5, F2, F3, F5, J4, J5, J6, P9-P11, D1, D3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    LINK_OPEN_END_CODE,
    LINK_SINCE_EVER_CODE,
    OPEN_END_DATE,
    SINCE_EVER_DATE,
    clean_link_date,
    fiscal_year,
)
from .dedup import drop_duplicates_deterministic, keep_first

# Forms that count as an annual report, and the prefix used to
# pre-filter them at the source.
ANNUAL_FORMS = ["10-K", "10-K405"]
ANNUAL_FORM_PREFIX = "10-K%"


def filing_index(filings: DataFrame, like: str = ANNUAL_FORM_PREFIX,
                 forms: Sequence[str] = tuple(ANNUAL_FORMS), form_col: str = "form") -> DataFrame:
    """Source filter (LIKE) plus the exact form list (S5, P5); both reach the Parquet scan."""
    f = F.col(form_col)
    return filings.where(f.like(like) & f.isin(list(forms)))


def clean_links(links: DataFrame, start: str = "link_start_date", end: str = "link_end_date",
                keys: Sequence[str] = ("cik", "gvkey"),
                start_out: str = "link_start", end_out: str = "link_end") -> DataFrame:
    """Trim codes, map '0' -> null, 'B' -> 1700-01-01, 'E' -> 2260-01-01, parse dates;
    drop rows without both keys. Adds ``end_open`` (the 'E' code) for containment joins."""
    out = links
    for k in keys:
        out = out.where(F.col(k).isNotNull())
    return (out
            .withColumn("end_open", F.trim(F.col(end)) == LINK_OPEN_END_CODE)
            .withColumn(start_out, clean_link_date(start, LINK_SINCE_EVER_CODE, SINCE_EVER_DATE))
            .withColumn(end_out, clean_link_date(end, LINK_OPEN_END_CODE, OPEN_END_DATE)))


def interval_join(df: DataFrame, links: DataFrame, key: str | Sequence[str], at: str,
                  start: str = "link_start", end: str = "link_end", how: str = "inner",
                  year_buckets: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``at`` lies in ``[start, end]`` (inclusive) of a link with the same key.

    The range test sits in the join condition, so Catalyst plans an equi join on
    the key with a residual range filter (no materialised equi-join). A null
    bound never matches. With ``year_buckets=True`` the link side is exploded
    into one row per covered year and the join key gains the year: that splits
    a firm with thousands of rows over many tasks. Only use it for links with
    bounded spans (open ends such as 2260 would explode to centuries).
    """
    keys = [key] if isinstance(key, str) else list(key)
    l = links.alias("__l")
    d = df.alias("__d")
    cond = [F.col(f"__d.{k}") == F.col(f"__l.{k}") for k in keys]
    if year_buckets:
        l = (links.withColumn("__yr", F.explode(F.sequence(F.year(start), F.year(end))))
             .alias("__l"))
        d = df.withColumn("__yr", F.year(at)).alias("__d")
        cond.append(F.col("__d.__yr") == F.col("__l.__yr"))
    cond += [F.col(f"__d.{at}") >= F.col(f"__l.{start}"), F.col(f"__d.{at}") <= F.col(f"__l.{end}")]
    joined = d.join(l, cond, how)
    left_cols = [F.col(f"__d.{c}") for c in df.columns]
    right_cols = [F.col(f"__l.{c}") for c in links.columns if c not in keys and c not in df.columns]
    return joined.select(*left_cols, *right_cols)


def containing_links(panel: DataFrame, links: DataFrame, key: str = "gvkey", year: str = "fyear",
                     start: str = "link_start", end: str = "link_end", end_open: str = "end_open",
                     year_range: tuple[int, int] | None = (1950, 2020)) -> DataFrame:
    """Links that cover the whole fiscal year.

    A link must start strictly before Dec 31 of ``year-1`` and end strictly after
    Dec 31 of ``year``. A missing start sorts below every date and passes; a
    missing end fails unless it is flagged open.
    """
    p = panel
    if year_range is not None:
        p = p.where(F.col(year).between(*year_range))
    pa, la = p.alias("__p"), links.alias("__l")
    y = F.col(f"__p.{year}")
    lo = F.make_date(y - 1, F.lit(12), F.lit(31))
    hi = F.make_date(y, F.lit(12), F.lit(31))
    s, e = F.col(f"__l.{start}"), F.col(f"__l.{end}")
    cond = ((F.col(f"__p.{key}") == F.col(f"__l.{key}"))
            & (s.isNull() | (s < lo))
            & (F.coalesce(F.col(f"__l.{end_open}"), F.lit(False)) | (e > hi)))
    out = pa.join(la, cond, "inner")
    return out.select(*[F.col(f"__p.{c}") for c in panel.columns],
                      *[F.col(f"__l.{c}") for c in links.columns if c not in panel.columns])


def annual_filings(filings: DataFrame, key: str = "cik", date: str = "rdate",
                   order: Sequence[str] = ("fname",)) -> DataFrame:
    """Annual-report filings, one per (filer, date), first in ``order``."""
    f = filing_index(filings)
    return keep_first(f, [key, date], list(order))


def link_filings(filings: DataFrame, links: DataFrame, key: str = "cik", date: str = "rdate",
                 firm: str = "gvkey") -> DataFrame:
    """Filings inside their filer's link interval, one row per (filer, firm, date) (J5, D3),
    with the fiscal year (F5: filed before June -> previous year)."""
    j = interval_join(filings, links, key, date)
    j = drop_duplicates_deterministic(j, [key, firm, date])
    return j.withColumn("fyear", fiscal_year(date))


def filing_panel(linked: DataFrame, panel: DataFrame, keys: Sequence[str] = ("gvkey", "fyear"),
                 revenue: str = "sale", min_revenue: float = 5.0) -> DataFrame:
    """Inner join filings to the firm-year panel and keep revenue strictly above the floor."""
    return linked.join(panel, list(keys), "inner").where(F.col(revenue) > min_revenue)


# Link history types and primary flags of the best quality, and the accounts kept.
LINK_TYPES = ["LU", "LC"]
PRIMARY_FLAGS = ["P", "C"]
ACCOUNT_FLAGS = {"indfmt": "INDL", "datafmt": "STD", "popsrc": "D", "consol": "C"}


def security_links(history: DataFrame, accounts: DataFrame, years: tuple[int, int] = (1950, 2020)) -> DataFrame:
    """The link-filter job (P5, P10, P11, J6, D3): the security of each firm-year.

    ``history``: gvkey, linktype, linkprim, lpermno, lpermco, linkdt (null: since ever), linkenddt
    (null: still), maybe more. ``accounts``: gvkey, fyear, datadate and the four format flags.
    Links of good type with a primary flag that touch the window of years, joined to the accounts
    whose whole fiscal year they cover; one row per (permco, gvkey, datadate), the first by the other
    columns in their order.
    """
    first, last = years
    kept = history.where(F.col("linktype").isin(LINK_TYPES) & F.col("linkprim").isin(PRIMARY_FLAGS)
                         & (F.col("linkdt").isNull() | (F.year("linkdt") <= last + 1))
                         & (F.col("linkenddt").isNull() | (F.year("linkenddt") >= first - 1)))
    wanted = accounts
    for c, v in ACCOUNT_FLAGS.items():
        wanted = wanted.where(F.col(c) == v)
    met = containing_links(wanted, kept.withColumn("end_open", F.col("linkenddt").isNull()), start="linkdt", end="linkenddt", year_range=years)
    met = met.drop("end_open").withColumnsRenamed({"lpermno": "permno", "lpermco": "permco"})
    return drop_duplicates_deterministic(met, ["permco", "gvkey", "datadate"])


# Common shares of US corporations in active regular trading on the three large exchanges.
SHARE_FILTERS = {"sharetype": ["NS"], "securitytype": ["EQTY"], "securitysubtype": ["COM"], "usincflg": ["Y"],
                 "issuertype": ["ACOR", "CORP"], "primaryexch": ["N", "A", "Q"], "conditionaltype": ["RW", "NW"], "tradingstatusflg": ["A"]}


def monthly_common_shares(monthly: DataFrame, history: DataFrame, start: str = "secinfostartdt", end: str = "secinfoenddt") -> DataFrame:
    """The security-history job (J5, P5): months of each security while its history row (same permno, month's
    date within its dates, both included) says it is a common share; with that row's primaryexch and siccd."""
    kept = history
    for c, values in SHARE_FILTERS.items():
        kept = kept.where(F.col(c).isin(values))
    return interval_join(monthly, kept.select("permno", start, end, "primaryexch", "siccd"), "permno", "date", start, end).drop(start, end)


# Domestic consolidated accounts in dollars.
DOMESTIC_FLAGS = {**ACCOUNT_FLAGS, "curcd": "USD", "fic": "USA"}


def domestic_accounts(accounts: DataFrame, company: DataFrame, key: str = "gvkey") -> DataFrame:
    """The accounts extract (P5, J4): domestic consolidated accounts of firms in the company table, with its columns."""
    kept = accounts.where(F.col(key).isNotNull())
    for c, v in DOMESTIC_FLAGS.items():
        kept = kept.where(F.col(c) == v)
    return kept.drop(*DOMESTIC_FLAGS).join(company, key).withColumn("year", F.year("datadate"))


# --------------------------------------------------------------------------- dyadic joins

#: Dyadic ranges hold 1, 2, 4, ... 2 ** (LEVELS - 1) days; longer intervals take several of the longest.
LEVELS = 18


def dyadic_cover(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """Array of (level, block): the fewest dyadic ranges [block << level, (block + 1) << level) that make up the integers
    from ``first`` to ``last``, at most two a level and, of the longest, as many as there are. Null or empty intervals have none."""
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    ranges = []
    for k in range(levels):
        size = 1 << k
        low, high = F.ceil(first / size).cast("long"), F.floor((last + 1) / size).cast("long")  # blocks of this level: low to high - 1
        if k == levels - 1:
            own = F.transform(F.sequence(low, F.greatest(high - 1, low)), _at_level(k))
        else:  # the ones at the ends that no longer range holds
            left, right = low.bitwiseAND(F.lit(1)) == 1, high.bitwiseAND(F.lit(1)) == 1
            own = F.concat(F.when(left, F.array(_at_level(k)(low))).otherwise(none), F.when(right & ((high - 1 > low) | ~left), F.array(_at_level(k)(high - 1))).otherwise(none))
        ranges.append(F.when(low < high, own).otherwise(none))
    return F.when(first.isNotNull() & last.isNotNull(), F.concat(*ranges))


def _at_level(level: int):
    return lambda block: F.struct(F.lit(level).alias("level"), block.alias("block"))


def dyadic_ancestors(at: Column, levels: int = LEVELS) -> Column:
    """Array of (level, block): the dyadic ranges that hold ``at``, one a level."""
    return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(at.cast("long"), k).alias("block")) for k in range(levels)))


def dyadic_join(df: DataFrame, links: DataFrame, key: str | Sequence[str], at: Column, first: Column, last: Column,
                levels: int = LEVELS) -> DataFrame:
    """Rows of ``df`` with every link of the same key whose integers from ``first`` to ``last`` hold ``at``.

    A link becomes the dyadic ranges that make up its interval, whatever its length a few rows; each distinct
    (key, ``at``) looks up the ranges that hold it, one a level. One equi join finds all pairs, each once, and no range test is left.
    What it finds meets the wide rows by (key, ``at``), so the rows of one firm spread over the tasks by their dates.
    Null keys, null places and intervals with a null end match nothing. Both joins are merge joins: the planner takes the ranges
    for as small as the rows they were made of, and would send all of them through the driver to every task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    own = [c for c in links.columns if c not in keys and c not in df.columns]
    at_name, row = "__at", "__link"
    wide = df.withColumn(at_name, at.cast("long"))
    points = wide.select(*keys, at_name).where(F.col(at_name).isNotNull()).distinct()
    points = points.select(*keys, at_name, F.inline(dyadic_ancestors(F.col(at_name), levels)))
    cover = links.select(*keys, F.struct(*(F.col(f"`{c}`") for c in own), F.lit(1).alias("__one")).alias(row), F.inline(dyadic_cover(first.cast("long"), last.cast("long"), levels)))
    hits = points.join(cover.hint("merge"), [*keys, "level", "block"]).select(*keys, at_name, row)
    out = wide.join(hits.hint("merge"), [*keys, at_name])
    return out.select(*df.columns, *(F.col(row).getField(c).alias(c) for c in own))


def _day(c: Column) -> Column:
    return F.unix_date(c)


def dyadic_interval_join(df: DataFrame, links: DataFrame, key: str | Sequence[str], at: str, start: str = "link_start", end: str = "link_end",
                         levels: int = LEVELS) -> DataFrame:
    """``interval_join`` as one equi join: open ends (1700, 2260) cost a few rows, and a firm with a large share of the rows spreads."""
    return dyadic_join(df, links, key, _day(F.col(at)), _day(F.col(start)), _day(F.col(end)), levels)


def dyadic_containing_links(panel: DataFrame, links: DataFrame, key: str = "gvkey", year: str = "fyear", start: str = "link_start", end: str = "link_end",
                            end_open: str = "end_open", year_range: tuple[int, int] = (1950, 2020)) -> DataFrame:
    """``containing_links`` as one equi join on years (J6, P10, P11): a link covers the fiscal years y with start < Dec 31 of y - 1 and
    Dec 31 of y < end, which is an interval of years."""
    low, high = year_range
    s, e = F.col(start), F.col(end)
    new_years_eve = (F.month(s) == 12) & (F.dayofmonth(s) == 31)
    first = F.when(s.isNull(), F.lit(low)).otherwise(F.year(s) + 1 + new_years_eve.cast("int"))
    last = F.when(F.coalesce(F.col(end_open), F.lit(False)), F.lit(high)).otherwise(F.year(e) - 1)
    # years outside the range meet nothing, so links are cut to it: eight levels hold it
    return dyadic_join(panel.where(F.col(year).between(low, high)), links, key, F.col(year), F.greatest(first, F.lit(low)), F.when(last.isNotNull(), F.least(last, F.lit(high))), 8)

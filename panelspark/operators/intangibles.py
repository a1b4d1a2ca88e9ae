"""Intangible capital: growth by age, founding year, industry rates, perpetual
inventory and the full capital-stock job (A3, A4, A6, A7, F11-F15, J7-J10, W8, P14).

The source ran per-firm Python loops in batches of 200 firms; here the whole
job is one DataFrame plan. Panel windows share one hash partitioning on the
firm key; the two growth-rate tables are small global aggregates (one row per
age) that are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    guarded_log,
    level_from_log,
    net_sga,
    null_if_in,
    sic_rate,
    zero_if_null,
)
from ..session import materialize
from ..sources.io import require_columns
from .dedup import keep_last
from .panel import (
    add_anchor_rows,
    backcast_constant,
    backcast_rates,
    bfill,
    densify_years,
    linear_recurrence,
    nearest_fill,
    pivot_zero_fill,
    row_index,
    value_at,
)

# Founding-list codes that mean "unknown", the code that means
# 2013, the years subtracted from the IPO year to estimate founding, the
# retention of organisational capital, and the R&D pivot year.
FOUNDING_UNKNOWN = [-99, -9, 0]
FOUNDING_CODE_2013 = (201, 2013)
FOUNDING_LAG_YEARS = 8
OCAP_RETENTION = 0.8
RD_PIVOT_YEAR = 1977
# Range partitions of the raw accounts' scans (True: as many as shuffles have).
SEGMENTS = True
# The accounts kept -- industrial format, standardized data.
ACCOUNTS_FORMAT = {"indfmt": "INDL", "datafmt": "STD"}


# --------------------------------------------------------------------------- A3, A10, J8, F26

def growth_by_age(df: DataFrame, value: str, key: str = "gvkey", age: str = "ageipo",
                  ages: tuple[int, int] | None = None) -> DataFrame:
    """Mean log growth of ``value`` by age over key-rows with both values > 0 (A3).

    The source merged the rows of age ``a`` with the rows of age ``a - 1`` of the
    same key (duplicates multiply, age gaps do not match) and averaged
    ``log x - log x_prev`` over all those pairs. The pairs are never formed here:
    per (key, age) we keep the count ``n`` and the sum of logs ``S`` (a partial
    aggregate), join age ``a`` to age ``a - 1`` one row to one row, and use
    ``sum(n_prev * S - n * S_prev) / sum(n * n_prev)`` -- the same mean. ``ages``
    restricts the ages (inclusive); by default 1 .. max(age), like the source's
    loop. Output (age, n, grate) with ``n`` the number of pairs.
    """
    pos = df.where(F.col(value) > 0)
    per = pos.groupBy(F.col(key), F.col(age).cast("int").alias("__age")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.log(F.col(value))).alias("__s"))
    cur = per
    if ages is None:
        cur = cur.where(F.col("__age") >= 1)
    else:
        cur = cur.where(F.col("__age").between(*ages))
    prev = per.select(F.col(key), (F.col("__age") + 1).alias("__age"),
                      F.col("__n").alias("__np"), F.col("__s").alias("__sp"))
    pairs = cur.join(prev, [key, "__age"], "inner")
    num = F.col("__np").cast("double") * F.col("__s") - F.col("__n").cast("double") * F.col("__sp")
    den = F.col("__n") * F.col("__np")
    return (pairs.groupBy(F.col("__age").alias("age"))
                 .agg(F.sum(den).alias("n"), (F.sum(num) / F.sum(den).cast("double")).alias("grate")))


def growth_pre(df: DataFrame, value: str, key: str = "gvkey", age: str = "ageipo") -> DataFrame:
    """Pre-IPO growth: the mean of the age -1 and age 0 mean growth rates (A4); one row."""
    g = growth_by_age(df, value, key, age, ages=(-1, 0))
    return g.agg(F.avg("grate").alias("grate_pre"))


# --------------------------------------------------------------------------- F1, P8

def clean_founding(founding: DataFrame, col: str = "founding") -> DataFrame:
    """Founding-list sentinels -> null, 201 -> 2013, drop rows with any null."""
    code, year = FOUNDING_CODE_2013
    c = null_if_in(col, FOUNDING_UNKNOWN)
    c = F.when(c == code, F.lit(year)).otherwise(c)
    return founding.withColumn(col, c.cast("int")).na.drop("any")


# --------------------------------------------------------------------------- F14, A6, A7, J10

def founding_estimate(listed, firstcomp, ipo_year, lag: int = FOUNDING_LAG_YEARS):
    """Listed founding year unless later than the first accounts year; else
    min(first accounts year, IPO year - lag) when the IPO is known; else first year (F14)."""
    listed, firstcomp, ipo_year = (F.col(x) if isinstance(x, str) else x for x in (listed, firstcomp, ipo_year))
    listed_ok = F.when(~(listed > firstcomp) | firstcomp.isNull(), listed)
    est = F.when(ipo_year.isNotNull(),
                 F.when(firstcomp <= ipo_year - lag, firstcomp).otherwise(ipo_year - lag))
    return F.coalesce(listed_ok, est, firstcomp).cast("int")


def founding_year(panel: DataFrame, company: DataFrame, founding: DataFrame, key: str = "gvkey",
                  year: str = "fyear", lag: int = FOUNDING_LAG_YEARS) -> DataFrame:
    """Founding year per firm (A6, A7, J10, F14): (key, founding_year).

    First accounts year = min(year); IPO year from the company table; listed year
    from the cleaned founding list via the firm's CUSIP (min CUSIP, made
    deterministic; the list is deduplicated on CUSIP before the join).
    """
    firms = (panel.groupBy(key).agg(F.min(year).cast("int").alias("firstcomp"))
                  .join(company.select(key, "cusip", "ipodate"), key, "left"))
    listed = clean_founding(founding).groupBy("cusip").agg(F.min("founding").alias("founding"))
    f = firms.join(listed, "cusip", "left")
    return f.select(key, founding_estimate("founding", "firstcomp", F.year("ipodate"), lag).alias("founding_year"))


# --------------------------------------------------------------------------- F15

def attach_sic_rates(df: DataFrame, sic: str = "sich", delta: str = "theta_g2",
                     gamma: str = "gamma_o2") -> DataFrame:
    """Industry rates from the SIC code (generated CASE over fixed ranges; no join)."""
    return df.withColumns({delta: sic_rate(sic, "delta"), gamma: sic_rate(sic, "gamma")})


# --------------------------------------------------------------------------- W8

def capital_stocks(df: DataFrame, key: str = "gvkey", year: str = "fyear", rd: str = "xrd",
                   sga: str = "xsga", delta: str = "theta_g2", gamma: str = "gamma_o2",
                   kout: str = "kcap_v2", oout: str = "ocap_v2",
                   retention: float = OCAP_RETENTION, block_rows: int | None = None) -> DataFrame:
    """Perpetual inventory per firm: K0 = 0, K_t = K_{t-1}(1 - delta_t) + R_t;
    O0 = 0, O_t = retention * O_{t-1} + gamma_t * S_t (W8).

    One row per (firm, year) keeps each firm's fold bounded by the calendar
    span; ``block_rows`` switches to the blocked affine layout for inputs with
    very long keys (see ``panel.linear_recurrence``)."""
    return linear_recurrence(df, key, [year], {
        kout: (F.lit(1.0) - F.col(delta), F.col(rd)),
        oout: (F.lit(retention), F.col(gamma) * F.col(sga)),
    }, block_rows=block_rows)


# --------------------------------------------------------------------------- job C

def intangible_stocks(funda: DataFrame, company: DataFrame, founding: DataFrame,
                      exclude: Sequence = (), pivot_year: int = RD_PIVOT_YEAR,
                      age_mode: str = "as_coded", zero_mode: str = "as_coded",
                      lag: int = FOUNDING_LAG_YEARS, key: str = "gvkey", year: str = "fyear",
                      keep_intermediate: bool = False, checkpoint: bool = True,
                      segments: int | bool | None = SEGMENTS) -> DataFrame:
    """Knowledge and organisational capital stocks per firm-year.

    ``funda``: key, year, datadate, assets, xsga, xrd, rdip, cogs (+ optional sich,
    and indfmt/datafmt, which are filtered to industrial standardized rows).
    ``company``: key, sic, ipodate (+ cusip, seq when the accounts lack them).
    ``founding``: cusip, founding.
    Returns (key, year, kcap_v2, ocap_v2) for rows that came from data.

    Steps 1-9 run on the raw accounts, where one firm could hold many rows: two-level
    scans over range partitions of (firm, whole order) let no task hold a whole
    large firm, in the same plan at every size (``segments=None``: plain windows, the
    same results). Every order ends in all other columns, so equal dates give the
    same result in any arrival order. Rows without a firm are dropped. From step 10 on the
    panel is unique on (firm, year) by construction, so per-firm groups are bounded by
    the calendar span.
    """
    if age_mode not in ("as_coded", "recomputed"):
        raise ValueError("age_mode must be 'as_coded' or 'recomputed'")
    f = prepared_accounts(funda, company, founding, exclude, pivot_year, key, year, segments)
    if checkpoint:
        # fan-out: four growth aggregates and the rest of the job read this
        f = materialize(f)
    return stocks_from(f, growth_rates(f, key), founding, pivot_year, age_mode, zero_mode, lag, key, year, keep_intermediate, checkpoint, segments)


@dataclass(frozen=True)
class GrowthRates:
    """By age (ageipo, grate_xrd / grate_xsga), and the pre-IPO rates (one row: pre_xrd / pre_xsga)."""

    rd: DataFrame
    sga: DataFrame
    pre_rd: DataFrame
    pre_sga: DataFrame


def prepared_accounts(funda: DataFrame, company: DataFrame, founding: DataFrame, exclude: Sequence = (), pivot_year: int = RD_PIVOT_YEAR,
                      key: str = "gvkey", year: str = "fyear", segments: int | bool | None = SEGMENTS) -> DataFrame:
    """Steps 1-6 of the job: each firm's accounts with its attributes, filled, netted, numbered and aged; no firm looks at another."""
    k, y = key, year
    require_columns(funda, [k, y, "datadate", "assets", "xsga", "xrd", "rdip", "cogs"])
    # cusip and seq come from the accounts when they carry them, else from the company table
    from_company = [c for c in ("cusip", "seq") if c not in funda.columns]
    require_columns(company, [k, "sic", "ipodate", *from_company])
    require_columns(founding, ["cusip", "founding"])
    # 1. company attributes, SIC fallback, exclusions, first accounts year, missing-assets flag
    comp = company.select(k, "sic", "ipodate", *from_company)
    f = funda.join(comp, k, "left")
    sich = F.coalesce(F.col("sich"), F.col("sic")) if "sich" in funda.columns else F.col("sic")
    f = f.withColumn("sich", sich.cast("int")).drop("sic")
    if exclude:
        f = f.where(~F.col(k).isin(list(exclude)))
    for c, v in ACCOUNTS_FORMAT.items():
        if c in funda.columns:          # source filter: pushed to the scan
            f = f.where(F.col(c) == v)
    f = f.where(F.col(k).isNotNull())
    seg = segments or None
    if seg:
        f = f.join(f.groupBy(k).agg(F.min(y).cast("int").alias("firstcomp")), k, "left")
    else:
        f = f.withColumn("firstcomp", F.min(y).over(_firm(k)).cast("int"))
    f = f.where(F.col(y).isNotNull())
    f = f.withColumn("atnan", F.col("assets").isNull().cast("int"))
    by_date = [F.col("datadate"), F.col(y)]
    # 2-3. nearest fill where assets are missing: SG&A all years, R&D from the pivot year
    f = nearest_fill(f, k, by_date, "xsga", when=F.col("atnan") == 1, segments=seg)
    f = nearest_fill(f, k, by_date, "xrd", when=F.col("atnan") == 1, era=F.col(y) >= pivot_year, segments=seg)
    # 4. pivot-year rule; 5. SG&A net of R&D
    f = pivot_zero_fill(f, k, y, "xrd", pivot_year, segments=seg, order=["datadate"])
    f = f.withColumn("xsga", net_sga("xsga", "xrd", "rdip", "cogs"))
    # 6. data-row counter, age since IPO
    f = row_index(f, k, [F.col(y), F.col("datadate")], "count", segments=seg)
    f = f.withColumn("ageipo", (F.col(y) - F.year("ipodate")).cast("int"))
    return f


def growth_rates(f: DataFrame, k: str = "gvkey") -> GrowthRates:
    """Step 7 of the job: the growth rates of all firms together."""
    g_rd = growth_by_age(f, "xrd", k).select(F.col("age").alias("ageipo"), F.col("grate").alias("grate_xrd"))
    g_sga = growth_by_age(f, "xsga", k).select(F.col("age").alias("ageipo"), F.col("grate").alias("grate_xsga"))
    pre_rd = growth_pre(f, "xrd", k).select(F.col("grate_pre").alias("pre_xrd"))
    pre_sga = growth_pre(f, "xsga", k).select(F.col("grate_pre").alias("pre_xsga"))
    return GrowthRates(g_rd, g_sga, pre_rd, pre_sga)


def stocks_from(f: DataFrame, rates: GrowthRates, founding: DataFrame, pivot_year: int = RD_PIVOT_YEAR, age_mode: str = "as_coded", zero_mode: str = "as_coded",
                lag: int = FOUNDING_LAG_YEARS, key: str = "gvkey", year: str = "fyear", keep_intermediate: bool = False, checkpoint: bool = True,
                segments: int | bool | None = SEGMENTS) -> DataFrame:
    """Steps 8-17 of the job: the stocks of the firms in prepared accounts, given the growth rates."""
    k, y, seg = key, year, segments or None
    g_rd, g_sga, pre_rd, pre_sga = rates.rd, rates.sga, rates.pre_rd, rates.pre_sga
    # 8. before the pivot year, nearest fill of R&D for firms whose pivot-year R&D is > 0
    w = _firm(k)
    pivot_val = value_at(f, k, y, "xrd", pivot_year, ["datadate"])
    if seg:
        f = f.join(f.groupBy(k).agg(pivot_val.alias("__p8")), k, "left")
    else:
        f = f.withColumn("__p8", pivot_val.over(w))
    f = nearest_fill(f, k, [F.col(y), F.col("datadate")], "xrd",
                     when=F.coalesce(F.col("__p8") > 0, F.lit(False)), era=F.col(y) <= pivot_year,
                     segments=seg).drop("__p8")
    # 9. remaining nulls -> 0
    f = f.withColumn("xsga", zero_if_null("xsga")).withColumn("xrd", zero_if_null("xrd"))
    # 10. IPO-year rows for firms with a positive age, keep-last dedup, densify
    ipo_rows = (f.where(F.col("ageipo") > 0).groupBy(k)
                  .agg(F.max(F.year("ipodate")).cast("int").alias(y), F.min("cusip").alias("cusip"))
                  .withColumn("__src", F.lit(1)))
    f = add_anchor_rows(f.withColumn("__src", F.lit(0)), ipo_rows)
    if not seg:
        # windows per firm came before: one shuffle by firm serves the rest as well
        f = f.repartition(k)
    f = keep_last(f, [k, y], ["datadate", "seq", "__src"])
    f = densify_years(f, k, y, unique=True)
    # 11. age-rate backcast of the logs
    if age_mode == "recomputed":
        f = f.withColumn("ageipo", (F.col(y) - F.max(F.year("ipodate")).over(w)).cast("int"))
    f = (f.join(g_rd, "ageipo", "left").join(g_sga, "ageipo", "left")
          .withColumn("logxsga", guarded_log("xsga")).withColumn("logxrd", guarded_log("xrd")))
    f = backcast_rates(f, k, [y], "xrd", "logxrd", "grate_xrd")
    f = backcast_rates(f, k, [y], "xsga", "logxsga", "grate_xsga")
    # the columns that later steps read
    f = f.select(k, y, "cusip", "count", "__src", "firstcomp", "ipodate", "xrd", "xsga", "logxrd", "logxsga", "ageipo", "sich")
    if checkpoint:
        # fan-out: founding rows are derived from this frame and unioned back into it
        f = materialize(f)
    # 12. founding year from data rows (Q10), per firm: the list meets a row per firm and attributes, not the panel
    listed = clean_founding(founding).groupBy("cusip").agg(F.min("founding").alias("listed"))
    data_year = F.min(F.when(F.col("count").isNotNull(), F.col(y)))
    firms = f.groupBy(k, "cusip", "firstcomp", "ipodate").agg(data_year.alias("__y")).join(listed, "cusip", "left")
    firms = firms.withColumn("__est", founding_estimate(F.col("listed"), F.col("firstcomp"), F.year("ipodate"), lag))
    # 13. founding-year row, dedup (real rows win), densify, back-fill firm constants
    first_est = F.min_by("__est", F.when(F.col("__est").isNotNull(), F.col("__y")))
    found_rows = (firms.groupBy(k).agg(first_est.alias(y), F.min("cusip").alias("cusip"))
                   .where(F.col(y).isNotNull()).withColumn("__src", F.lit(2)))
    # a firm has a row a year here: one shuffle by firm serves all that follows
    f = add_anchor_rows(f, found_rows).drop("cusip").repartition(k)
    f = keep_last(f, [k, y], ["count", "__src"])
    f = attach_sic_rates(f, "sich")  # 16, before rows are copied into the gaps
    f = densify_years(f, k, y, unique=True)
    f = bfill(f, k, [y], ["firstcomp", "ipodate"], unique=True)
    # 14. constant-rate backcast of the remaining null logs
    # each pre-IPO rate is a one-row global aggregate, attached as a scalar
    # subquery (computed once, no join); an all-null rate adds nothing, as a
    # NaN sum did in the source
    f = f.withColumns({"pre_xrd": pre_rd.scalar(), "pre_xsga": pre_sga.scalar()})
    f = backcast_constant(f, k, [y], "logxrd", F.coalesce(F.col("pre_xrd"), F.lit(0.0)))
    f = backcast_constant(f, k, [y], "logxsga", F.coalesce(F.col("pre_xsga"), F.lit(0.0)))
    # 15. back to levels
    f = (f.withColumn("xsga", level_from_log("xsga", "logxsga", zero_mode))
          .withColumn("xrd", level_from_log("xrd", "logxrd", zero_mode)))
    # 16. the two perpetual-inventory recurrences
    cols = [k, y, "count", "xrd", "xsga", "theta_g2", "gamma_o2"]
    if keep_intermediate:
        cols += ["logxrd", "logxsga", "ageipo", "sich"]
    stocks = capital_stocks(f.select(*cols), k, y)
    # 17. keep rows that came from data
    out = stocks.where(F.col("count").isNotNull())
    if keep_intermediate:
        return out
    return out.select(k, y, "kcap_v2", "ocap_v2")


def _firm(key):
    from pyspark.sql import Window
    return Window.partitionBy(key)

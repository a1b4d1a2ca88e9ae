"""Column expressions (scalar functions). All are built-in Spark expressions,
so they stay inside whole-stage codegen; none of them is a Python UDF."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- F1, F6, F10

def null_if_in(c: str | Column, values: Iterable) -> Column:
    """Sentinel codes -> null (F1)."""
    c = col_(c)
    return F.when(c.isin(list(values)), F.lit(None)).otherwise(c)


def zero_if_null(c: str | Column) -> Column:
    """Null-as-zero arithmetic."""
    return F.coalesce(col_(c), F.lit(0.0))


def nan_to_null(c: str | Column) -> Column:
    """NaN means missing in the source; Spark keeps NaN apart from null."""
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


# --------------------------------------------------------------------------- F2, F3

def parse_yyyymmdd(c: str | Column) -> Column:
    """yyyymmdd text or integer -> date; malformed -> null (ANSI-safe)."""
    return F.try_to_date(F.trim(col_(c).cast("string")), "yyyyMMdd")


def has_date_code(c: str | Column) -> Column:
    """Whether a yyyymmdd code is written with eight digits (P12); codes cut short or with stray characters aren't."""
    return F.coalesce(F.rlike(F.trim(col_(c).cast("string")), F.lit(r"^[0-9]{8}$")), F.lit(False))


# Link-table date codes and the dates they stand for.
LINK_NULL_CODE = "0"
LINK_SINCE_EVER_CODE = "B"
LINK_OPEN_END_CODE = "E"
SINCE_EVER_DATE = "17000101"
OPEN_END_DATE = "22600101"


def clean_link_date(c: str | Column, open_code: str, open_date: str) -> Column:
    """Trim; '0' -> null; the open code -> far date; then parse."""
    t = F.trim(col_(c))
    txt = (F.when(t == LINK_NULL_CODE, F.lit(None))
           .when(t == open_code, F.lit(open_date))
           .otherwise(t))
    return parse_yyyymmdd(txt)


# --------------------------------------------------------------------------- F4, F5, F7, F8

def fiscal_year(date: str | Column, first_month: int = 6) -> Column:
    """Year of the date, minus one when the month is before ``first_month``."""
    d = col_(date)
    return (F.year(d) - (F.month(d) < first_month).cast("int")).cast("int")


def clip_low(c: str | Column, low=0) -> Column:
    """Clip below at ``low``; null stays null (``greatest`` would turn null into low)."""
    c = col_(c)
    return F.when(c < low, F.lit(low)).otherwise(c)


# --------------------------------------------------------------------------- F9

def code_prefix(c: str | Column, n: int) -> Column:
    """First ``n`` characters of a code; null stays null."""
    return F.substring(col_(c).cast("string"), 1, n)


# --------------------------------------------------------------------------- F11

def net_sga(xsga, xrd, rdip, cogs) -> Column:
    """SG&A net of R&D: null -> 0; keep SG&A when cogs > xrd > xsga; else xsga - xrd - rdip."""
    s, r, p, c = (zero_if_null(x) for x in (xsga, xrd, rdip, cogs))
    return (F.when(col_(xsga).isNull(), F.lit(0.0))
            .when((c > r) & (r > s), s)
            .otherwise(s - r - p))


# --------------------------------------------------------------------------- F13

def guarded_log(c: str | Column) -> Column:
    """log(x) when x > 0, else x itself (0 and negatives pass through)."""
    c = col_(c)
    return F.when(c > 0, F.log(c)).otherwise(c)


def level_from_log(level: str | Column, logv: str | Column, zero_mode: str = "as_coded") -> Column:
    """Back from logs: exp(log) unless the level is negative.

    ``as_coded`` mirrors the source, where a zero level became exp(0) = 1;
    ``keep_zero`` keeps zeros.
    """
    lv, lg = col_(level), col_(logv)
    out = F.when(~(lv < 0) | lv.isNull(), F.exp(lg)).otherwise(lv)
    if zero_mode == "keep_zero":
        out = F.when(lv == 0, F.lit(0.0)).otherwise(out)
    elif zero_mode != "as_coded":
        raise ValueError(f"zero_mode must be 'as_coded' or 'keep_zero', not {zero_mode!r}")
    return out


# --------------------------------------------------------------------------- F15

# Industry groups by SIC code (inclusive ranges) and the
# (R&D depreciation, SG&A investment share) of each group. Groups are tested
# in order g1, g2, g3, g4; anything else (and a null code) is "other".
SIC_GROUPS = {
    "g1": [(3714, 3714), (3716, 3716), (3750, 3751), (3792, 3792), (4812, 4813),
           (4832, 4833), (4841, 4841), (100, 999), (2000, 2399), (2500, 2519),
           (2590, 2599), (2700, 2749), (2770, 2799), (3100, 3199), (3630, 3659),
           (3710, 3711), (3900, 3999), (5000, 5999), (7200, 7299), (7600, 7699),
           (8000, 8099)],
    "g2": [(1200, 1399), (2520, 2589), (2600, 2699), (2750, 2769), (2800, 2829),
           (2840, 3099), (3200, 3569), (3580, 3621), (3623, 3629), (3700, 3709),
           (3712, 3713), (3715, 3715), (3717, 3749), (3752, 3791), (3793, 3799),
           (3860, 3899), (4900, 4949)],
    "g3": [(3570, 3579), (3622, 3622), (3660, 3692), (3694, 3699), (3810, 3839),
           (4800, 4899), (7370, 7379), (7391, 7391), (8730, 8734)],
    "g4": [(2830, 2839), (3693, 3693), (3840, 3859)],
}
SIC_RATES = {  # group: (delta for R&D, gamma for SG&A)
    "g1": (0.33, 0.19),
    "g2": (0.42, 0.22),
    "g3": (0.46, 0.44),
    "g4": (0.34, 0.49),
    "other": (0.30, 0.34),
}
SIC_GROUP_ORDER = ["g1", "g2", "g3", "g4"]


def sic_rate_sql(sic: str, which: str) -> str:
    """The SIC -> rate CASE as SQL text: each range tested once, first group wins."""
    idx = {"delta": 0, "gamma": 1}[which]
    parts = []
    for g in SIC_GROUP_ORDER:
        conds = " or ".join(f"{sic} = {lo}" if lo == hi else f"{sic} between {lo} and {hi}"
                            for lo, hi in SIC_GROUPS[g])
        parts.append(f"when {conds} then cast({SIC_RATES[g][idx]!r} as double)")
    return "case " + " ".join(parts) + f" else cast({SIC_RATES['other'][idx]!r} as double) end"


def sic_rate(sic: str, which: str) -> Column:
    """SIC code -> delta (``which='delta'``) or gamma (``which='gamma'``).

    One codegen'd CASE over the fixed ranges, parsed from SQL text in a single
    call (building ~100 range tests through the Column API costs seconds of
    driver time per plan)."""
    return F.expr(sic_rate_sql(f"`{sic}`", which))


# --------------------------------------------------------------------------- F16, F17

def short_flag(c: str | Column, min_chars: int = 10000) -> Column:
    """1 when the text has fewer than ``min_chars`` characters (code points)."""
    return (F.length(col_(c)) < min_chars).cast("int")


# --------------------------------------------------------------------------- F22, F23

def l2_normalize(v: str | Column) -> Column:
    """Divide a numeric array by its L2 norm; null when the norm is 0 or the array is empty."""
    v = col_(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity of two equal-length arrays; null when either norm is 0."""
    na = F.sqrt(dot(a, a))
    nb = F.sqrt(dot(b, b))
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb))


# --------------------------------------------------------------------------- F24, F25

# Fixed value: the public archive prefix the source put before a filing's path.
FILING_ARCHIVE_BASE = "https://www.sec.gov/Archives/"


def filing_url(path: str | Column, base: str = FILING_ARCHIVE_BASE) -> Column:
    """Absolute URL of a filing from its archive path."""
    return F.concat(F.lit(base), col_(path).cast("string"))


def capture(c: str | Column, pattern: str, group: int = 1) -> Column:
    """Regex capture, e.g. the file name after a folder (F25); '' when there is no match."""
    return F.regexp_extract(col_(c), pattern, group)

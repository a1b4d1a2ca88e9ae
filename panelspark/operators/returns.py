"""Security returns and firm age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip_low, null_if_in

# Return codes that mean "no valid return" in the monthly file.
RETURN_SENTINELS = [-66.0, -77.0, -88.0, -99.0]


def clean_returns(monthly: DataFrame, ret: str = "ret", sentinels=tuple(RETURN_SENTINELS)) -> DataFrame:
    """Sentinel return codes -> null (F1)."""
    return monthly.withColumn(ret, null_if_in(ret, sentinels))


def compound_return(df: DataFrame, keys: Sequence[str], ret: str = "ret", out: str = "ret") -> DataFrame:
    """Null-strict compounded return per group: prod(1+r) - 1, null if any r is null.

    ``product``, ``count`` and ``count(*)`` are all partial aggregates, so a hot
    security is combined map-side before the shuffle.
    """
    r = F.col(ret)
    return (df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("__n"), F.count(r).alias("__nv"),
                 F.product(F.lit(1.0) + r).alias("__p"))
            .select(*keys, F.when(F.col("__n") == F.col("__nv"), F.col("__p") - 1.0).alias(out)))


def annual_returns(monthly: DataFrame, year: str, security: str = "permno", issuer: str = "permco", date: str = "date",
                   ret: str = "ret", first: str = "crsp_first_date") -> DataFrame:
    """(security, year, first, ret): the null-strict annual return and the issuer's first month.

    One pass over the months, to a row per (security, issuer, year); the issuer's first month and the
    compounding over issuers that share it come from that small table.
    """
    r = F.col(ret)
    parts = monthly.groupBy(security, issuer, year).agg(
        F.count(F.lit(1)).alias("__n"), F.count(r).alias("__nv"), F.product(F.lit(1.0) + r).alias("__p"), F.min(date).alias("__from"))
    # a small aggregate joined back: securities without an issuer meet in no group and have no first month
    firsts = parts.where(F.col(issuer).isNotNull()).groupBy(issuer).agg(F.min("__from").alias(first))
    parts = parts.join(firsts, issuer, "left")
    whole = parts.groupBy(security, year, first).agg(F.sum("__n").alias("__n"), F.sum("__nv").alias("__nv"), F.product("__p").alias("__p"))
    return whole.select(security, year, first, F.when(F.col("__n") == F.col("__nv"), F.col("__p") - 1.0).alias(ret))


def first_seen(df: DataFrame, key: str | Sequence[str], value: str, out: str) -> DataFrame:
    """Attach the group minimum of ``value`` to every row.

    Aggregate then join back rather than ``min().over(partitionBy)``: the
    aggregate is partial and the join-back is skew-split by AQE, whereas a window
    would sort a hot key's rows in one task. AQE turns the join into a broadcast
    only when the aggregated side is measured small at runtime.
    """
    keys = [key] if isinstance(key, str) else list(key)
    mins = df.groupBy(*keys).agg(F.min(value).alias(out))
    return df.join(mins, keys, "left")


def firm_age(df: DataFrame, year: str = "fyear", founding: str = "founding",
             dates: Sequence[str] = ("ipodate", "crsp_first_date", "comp_first_date"),
             out_first: str = "firstyear", out_age: str = "age") -> DataFrame:
    """First year = founding year, else the year of the first available date in ``dates``
    (hierarchical coalesce, F7); age = year - first year clipped at 0, null kept (W7, F8)."""
    first_date = F.coalesce(*[F.col(d) for d in dates])
    fy = F.coalesce(F.col(founding).cast("int"), F.year(first_date).cast("int"))
    return (df.withColumn(out_first, fy)
              .withColumn(out_age, clip_low(F.col(year) - F.col(out_first), 0).cast("int")))

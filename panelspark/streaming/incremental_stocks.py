"""The capital-stock job kept up to date (X2, W8): new accounts recompute the firms they touch, and others only where a growth rate moved.

Growth rates are the one thing in the job that looks at all firms. Each firm's share in them - count and sum of logs by
age - is kept as a table, so rates are merged from those few numbers and the accounts of other firms aren't read again. The sums over firms are exact
(``exact_sums``), so a rate that nothing changed comes out bit for bit as before, and a difference means it moved.
A firm is recomputed if it has new accounts or rows of an age whose rate moved; if a pre-IPO rate moved, every firm is.

Tables lie in hash buckets of the firm under one folder; an update rewrites the buckets of the firms it
recomputes. Rates are written last: an update that is broken off is done again from its accounts, under the same number, with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.exact import exact_sums
from ..operators.intangibles import RD_PIVOT_YEAR, GrowthRates, prepared_accounts, stocks_from
from ..session import materialize

BUCKET = "__bucket"
VALUES = ("xrd", "xsga")


def growth_parts(prepared: DataFrame, key: str = "gvkey") -> DataFrame:
    """(firm, value, age, n, s): each firm's positive values by age, as count and sum of logs (A3)."""
    values = F.inline(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).alias("x")) for v in VALUES)))
    rows = prepared.select(key, F.col("ageipo").alias("age"), values).where((F.col("x") > 0) & F.col("age").isNotNull())
    return rows.groupBy(key, "value", "age").agg(F.count("*").alias("n"), F.sum(F.log("x")).alias("s"))


def merged_rates(parts: DataFrame, key: str = "gvkey") -> DataFrame:
    """(value, age, grate): the mean log growth over all firms from age - 1 to age, from their parts."""
    w = Window.partitionBy(key, "value").orderBy("age")  # a row a firm, value and age
    pairs = parts.where(F.col(key).isNotNull()).select("*", *(F.lag(c).over(w).alias(f"p{c}") for c in ("age", "n", "s"))).where(F.col("page") == F.col("age") - 1)
    pairs = pairs.select("value", "age", (F.col("pn").cast("double") * F.col("s") - F.col("n").cast("double") * F.col("ps")).alias("num"), (F.col("n") * F.col("pn")).cast("double").alias("den"))
    sums = exact_sums(pairs, ["value", "age"], {"num": "num", "den": "den"})
    return sums.select("value", "age", (F.col("num") / F.col("den")).alias("grate"))


def as_growth_rates(rates: DataFrame) -> GrowthRates:
    by_age = lambda v: rates.where((F.col("value") == v) & (F.col("age") >= 1)).select(F.col("age").alias("ageipo"), F.col("grate").alias(f"grate_{v}"))
    pre = lambda v: rates.where((F.col("value") == v) & F.col("age").between(-1, 0)).agg(F.avg("grate").alias(f"pre_{v}"))
    return GrowthRates(by_age("xrd"), by_age("xsga"), pre("xrd"), pre("xsga"))


def moved_rates(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(value, age) of the rates that are new, gone or not the same bits."""
    if old is None:
        return new.select("value", "age")
    o, n = old.withColumnRenamed("grate", "was"), new.withColumnRenamed("grate", "is")
    return o.join(n, ["value", "age"], "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select("value", "age")


class StockTables:
    """The tables of the job under one folder: accounts by update, prepared accounts, parts, stocks, rates."""

    def __init__(self, spark: SparkSession, root: str, key: str = "gvkey", year: str = "fyear", buckets: int = 64):
        self.spark, self.root, self.key, self.year, self.buckets = spark, root.rstrip("/"), key, year, buckets

    def read(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def replace(self, name: str, new: DataFrame, firms: DataFrame | None) -> DataFrame:
        """Rewrite the firms' buckets: the new rows, and those of the other firms in them. Without ``firms`` the new rows are the table."""
        old, new = self.read(name) if firms is not None else None, self._bucketed(new)
        if old is not None:
            touched = self._bucketed(firms).select(BUCKET).distinct()
            # written aside first: the folder is read by this very plan
            new = materialize(old.join(touched, BUCKET, "left_semi").join(firms, self.key, "left_anti").select(*new.columns).unionByName(new))
        # by bucket, and a large bucket by several tasks: their number grows with the rows, not with the buckets
        spread = new.hint("rebalance", BUCKET)
        spread.write.mode("overwrite").option("partitionOverwriteMode", "static" if firms is None else "dynamic").partitionBy(BUCKET).parquet(f"{self.root}/{name}")
        return self.read(name)

    def update(self, number: int, accounts: DataFrame, company: DataFrame, founding: DataFrame, exclude: Sequence = (), pivot_year: int = RD_PIVOT_YEAR,
               age_mode: str = "as_coded", zero_mode: str = "as_coded", segments: int | bool | None = None) -> DataFrame:
        """Take in new accounts as update ``number`` and return all stocks.

        The same number again replaces that update's accounts. Company and founding tables are those of the first
        update. An update without accounts changes nothing.
        """
        if age_mode != "as_coded":
            raise ValueError("the ages of recomputed mode need the years between a firm's accounts; run the full job")
        k = self.key
        before, rates_before = self.read(f"accounts/update={number}"), self.read("rates")
        firms = accounts.select(k).where(F.col(k).isNotNull())
        if before is not None:  # done again: firms of its first version as well
            firms = firms.unionByName(before.select(k))
        firms = materialize(firms.distinct())
        accounts.write.mode("overwrite").parquet(f"{self.root}/accounts/update={number}")
        own = self.read("accounts").drop("update").join(firms, k, "left_semi")
        prepared = materialize(prepared_accounts(own, company, founding, exclude, pivot_year, k, self.year, segments))
        every = self.replace("prepared", prepared, firms)
        parts = self.replace("parts", growth_parts(prepared, k), firms)
        rates = materialize(merged_rates(parts.drop(BUCKET), k))
        moved = materialize(moved_rates(rates_before, rates))
        rows, again = every.drop(BUCKET), None
        if moved.where(F.col("age").between(-1, 0)).limit(1).count():  # every firm
            self.recomputed = every.select(k).distinct().count()
        else:
            ages = moved.select(F.col("age").alias("ageipo")).distinct()
            again = materialize(every.select(k, "ageipo").join(ages, "ageipo", "left_semi").select(k).unionByName(firms).distinct())
            self.recomputed = again.count()
            rows = materialize(rows.join(again, k, "left_semi"))
        new = stocks_from(rows, as_growth_rates(rates), founding, pivot_year, age_mode, zero_mode, key=k, year=self.year, segments=segments)
        stocks = self.replace("stocks", new, again)
        rates.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/rates")  # a row a value and age
        return stocks.drop(BUCKET)

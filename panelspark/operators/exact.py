"""Sums and products that don't depend on the order of the rows.

Floating-point addition rounds at each step, so an ordinary sum changes in its last bits with the partitions, the
order of shuffled blocks and every retry. Here each value is cut, exactly, into integers on a fixed grid of 24-bit cells;
integers add up without rounding, in any order and with partial sums; and the few cells of a group are put together once, from the largest down with
the rounding error carried along. The same rows give the same bits under any partitioning.

A cell sums 2 ** 39 rows without overflow. Values under 2 ** -912 in size are cut to multiples of 2 ** -984.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a cell, and cells that the 53 bits of a double can touch.
CELL, PARTS = 24, 4
_LOWEST = -38


def _with_cells(df: DataFrame, x: str) -> DataFrame:
    """Adds ``__top``, the number of the highest cell, and ``__p0`` to ``__p3``, the parts of the value in it and the cells below; zero and
    what isn't finite have none. One projection a part: written as one expression, each part would work out those before it again, twice."""
    v = F.col(x)
    finite = (v != 0) & ~F.isnan(v) & (F.abs(v) < float("inf"))
    size = F.when(finite, F.abs(v)).otherwise(F.lit(1.0))
    df = df.select("*", finite.alias("__finite"), F.greatest(F.floor(F.log2(size) / CELL).cast("int"), F.lit(_LOWEST)).alias("__at"))
    df = df.select("*", (F.when(F.col("__finite"), v).otherwise(0.0) * F.pow(F.lit(2.0), -F.lit(CELL) * F.col("__at"))).alias("__rest"))
    for j in range(PARTS):
        df = df.select("*", F.col("__rest").cast("long").alias(f"__p{j}"))  # towards zero; exact, like what is left
        df = df.withColumn("__rest", (F.col("__rest") - F.col(f"__p{j}")) * float(1 << CELL))
    return df.withColumn("__top", F.when(F.col("__finite"), F.col("__at"))).drop("__finite", "__at", "__rest")


def exact_sums(df: DataFrame, keys: Sequence[str], values: Mapping[str, str | Column]) -> DataFrame:
    """One row per key: the sums of ``values`` (output name -> column), null where a key has no value but null.

    Each sum is the exact one, rounded once or twice, whatever the order of the rows. NaN and infinities give what an ordinary sum
    gives. All sums come from one pass: rows are added up by (key, value, cell) before the shuffle, and a key has about
    a cell for each 24 bits that its values' sizes span.
    """
    keys = list(keys)
    one = [F.struct(F.lit(i).alias("__i"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("__x")) for i, v in enumerate(values.values())]
    long = _with_cells(df.select(*keys, F.inline(F.array(*one))), "__x")
    x = F.col("__x")
    long = long.withColumns({"__odd": F.when(F.isnan(x) | (F.abs(x) == float("inf")), x), "__some": x.isNotNull().cast("int")})
    summed = long.groupBy(*keys, "__i", "__top").agg(*(F.sum(f"__p{j}").alias(f"__p{j}") for j in range(PARTS)), F.sum("__odd").alias("__odd"), F.max("__some").alias("__some"))
    parts = F.transform(F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"__p{j}").alias("p")) for j in range(PARTS))),
                        lambda x: F.struct((F.col("__top") - x["j"]).alias("cell"), x["p"].alias("part")))
    # a few cells a key; equal cells were cut from different tops and are added up as integers first
    cells = summed.select(*keys, "__i", "__odd", "__some", F.explode(F.when(F.col("__top").isNotNull(), parts).otherwise(F.array(F.struct(F.lit(None).cast("int").alias("cell"), F.lit(None).cast("long").alias("part"))))).alias("__c"))
    cells = cells.groupBy(*keys, "__i", F.col("__c.cell").alias("__cell")).agg(F.sum(F.col("__c.part").cast("decimal(38,0)")).alias("__part"), F.sum("__odd").alias("__odd"), F.max("__some").alias("__some"))
    per = cells.groupBy(*keys, "__i").agg(F.collect_list(F.when(F.col("__cell").isNotNull(), F.struct((-F.col("__cell")).alias("down"), F.col("__part").alias("part")))).alias("__cells"),
                                          F.sum("__odd").alias("__odd"), F.max("__some").alias("__some"))
    value = F.when(F.col("__odd").isNotNull(), F.col("__odd")).when(F.col("__some") == 1, _together(F.array_sort("__cells")))
    done = per.select(*keys, "__i", value.alias("__sum"))
    wide = [F.max(F.when(F.col("__i") == i, F.col("__sum"))).alias(name) for i, name in enumerate(values)]
    return done.groupBy(*keys).agg(*wide) if keys else done.agg(*wide)


def _together(cells: Column) -> Column:
    """Sum of (-cell, part) from the largest cell down, with the rounding error of each step carried along."""
    base = float(1 << CELL)

    def step(acc: Column, c: Column) -> Column:
        low = F.pmod(c["part"], F.lit(1 << 40).cast("decimal(38,0)"))  # both halves are exact doubles
        unit = F.pow(F.lit(base), -c["down"])
        halves = F.array((c["part"] - low).cast("double") * unit, low.cast("double") * unit)
        return F.aggregate(halves, acc, two)

    def two(acc: Column, x: Column) -> Column:
        s = acc["s"] + x
        back = s - acc["s"]
        return F.struct(s.alias("s"), (acc["e"] + ((acc["s"] - (s - back)) + (x - back))).alias("e"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("e"))
    return F.aggregate(cells, start, step, lambda acc: acc["s"] + acc["e"])


def exact_products(df: DataFrame, keys: Sequence[str], values: Mapping[str, str | Column]) -> DataFrame:
    """One row per key: the products of ``values``; a null value makes its product null (null-strict, A8).

    Signs and zeros are counted and the logarithms of the sizes added up exactly, so the order of the rows doesn't matter; the
    result differs from a product in row order by a few units in the last place.
    """
    keys = list(keys)
    cols = {name: (F.col(v) if isinstance(v, str) else v).cast("double") for name, v in values.items()}
    named = df.select(*keys, *(c.alias(f"__v{i}") for i, c in enumerate(cols.values())))
    logs = exact_sums(named, keys, {f"__l{i}": F.when(F.col(f"__v{i}") != 0, F.log(F.abs(F.col(f"__v{i}")))) for i in range(len(cols))})
    counts = named.groupBy(*keys).agg(*(x for i in range(len(cols)) for v in [F.col(f"__v{i}")] for x in (
        F.max(v.isNull()).alias(f"__n{i}"), F.max(F.coalesce(v == 0, F.lit(False))).alias(f"__z{i}"), F.sum(F.when(v < 0, 1).otherwise(0)).alias(f"__m{i}"))))
    if keys:
        sides = counts.alias("c").join(logs.alias("l"), [F.col(f"c.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys])
        out = [F.col(f"c.{k}").alias(k) for k in keys]
    else:
        sides, out = counts.withColumn("__k", F.lit(1)).join(logs.withColumn("__k", F.lit(1)), "__k"), []
    for i, name in enumerate(cols):
        size = F.exp(F.coalesce(F.col(f"__l{i}"), F.lit(0.0)))
        signed = F.when(F.col(f"__z{i}"), F.lit(0.0)).when(F.col(f"__m{i}") % 2 == 1, -size).otherwise(size)
        out.append(F.when(~F.col(f"__n{i}"), signed).alias(name))
    return sides.select(*out)

"""Two-level ordered scans for keys too large for one task.

A window ``partitionBy(key).orderBy(order)`` puts every row of a key in one
task. Here the rows are range-partitioned on (key, whole order) instead, so a key
that holds a large share of the table spans several partitions, even if its
rows tie on the first order columns, and small keys share one. The partition
number is the row's segment. It is written down with the rows once, so every
branch and every retry of the plan sees the same segments. Segments are
scanned locally with ``partitionBy(key, segment)``. What a segment needs from the
segments before or after it -- its row offset, the last donor before it, the
first donor after it, the running sum so far -- comes from a summary with one
row per (key, segment), joined back.

``segmented_scan`` returns, per row: the global 1-based row number within the
key, the last non-null "previous donor" at or before the row, the first
non-null "next donor" strictly after it, and inclusive running sums -- the
building blocks of row index, nearest fill, back-fill, lead, and backcasts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SEG = "__seg"


def segmented_scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], segments: int | None = None,
                   prev: Mapping[str, Column] | None = None, nxt: Mapping[str, Column] | None = None,
                   sums: Mapping[str, Column] | None = None, rn: str = "__rn") -> DataFrame:
    """Ordered scan per key over ``segments`` range partitions (None or True: as many as shuffles have).

    ``prev`` / ``nxt`` map an output name to a value column (null = not a donor);
    the output is a struct ``(rn, v)`` with the donor's global row number, or null.
    ``sums`` map an output name to a numeric column; the output is the inclusive
    running sum (nulls count as 0).
    """
    prev, nxt, sums = dict(prev or {}), dict(nxt or {}), dict(sums or {})
    keys = list(keys)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = [] if segments in (None, True) else [segments]
    s = materialize(df.repartitionByRange(*parts, *keys, *order_cols).withColumn(SEG, F.spark_partition_id()))
    wl = Window.partitionBy(*keys, SEG).orderBy(*order_cols)
    s = s.withColumn("__lrn", F.row_number().over(wl))
    upto = wl.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = wl.rowsBetween(1, Window.unboundedFollowing)
    local = {}
    for name, v in prev.items():
        s = s.withColumn(f"__pv_{name}", v)
        local[f"__lp_{name}"] = F.last(F.when(F.col(f"__pv_{name}").isNotNull(), F.struct(
            F.col("__lrn").alias("rn"), F.col(f"__pv_{name}").alias("v"))), ignorenulls=True).over(upto)
    for name, v in nxt.items():
        s = s.withColumn(f"__nv_{name}", v)
        local[f"__ln_{name}"] = F.first(F.when(F.col(f"__nv_{name}").isNotNull(), F.struct(
            F.col("__lrn").alias("rn"), F.col(f"__nv_{name}").alias("v"))), ignorenulls=True).over(after)
    for name, v in sums.items():
        s = s.withColumn(f"__sv_{name}", F.coalesce(v.cast("double"), F.lit(0.0)))
        local[f"__ls_{name}"] = F.sum(F.col(f"__sv_{name}")).over(upto)
    s = s.withColumns(local) if local else s

    # ---- summary: one row per (key, segment)
    aggs = [F.count(F.lit(1)).alias("__cnt")]
    for name in prev:
        aggs.append(F.max(F.when(F.col(f"__pv_{name}").isNotNull(), F.struct(
            F.col("__lrn").alias("rn"), F.col(f"__pv_{name}").alias("v")))).alias(f"__sl_{name}"))
    for name in nxt:
        aggs.append(F.min(F.when(F.col(f"__nv_{name}").isNotNull(), F.struct(
            F.col("__lrn").alias("rn"), F.col(f"__nv_{name}").alias("v")))).alias(f"__sf_{name}"))
    for name in sums:
        aggs.append(F.sum(F.col(f"__sv_{name}")).alias(f"__ss_{name}"))
    summary = s.groupBy(*keys, SEG).agg(*aggs)
    ws = Window.partitionBy(*keys).orderBy(SEG)
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    later = ws.rowsBetween(1, Window.unboundedFollowing)
    summary = summary.withColumn("__off", F.coalesce(F.sum("__cnt").over(before), F.lit(0)))

    def glob(st: str) -> Column:  # local donor struct -> global row number
        return F.when(F.col(st).isNotNull(), F.struct((F.col(f"{st}.rn") + F.col("__off")).alias("rn"),
                                                      F.col(f"{st}.v").alias("v")))

    carry = {"__off": F.col("__off")}
    for name in prev:
        carry[f"__cp_{name}"] = F.last(glob(f"__sl_{name}"), ignorenulls=True).over(before)
    for name in nxt:
        carry[f"__cn_{name}"] = F.first(glob(f"__sf_{name}"), ignorenulls=True).over(later)
    for name in sums:
        carry[f"__cs_{name}"] = F.coalesce(F.sum(f"__ss_{name}").over(before), F.lit(0.0))
    summary = summary.select(*keys, SEG, *[v.alias(k) for k, v in carry.items()])

    # ---- put the carries back (null-safe: a null key is a key)
    summary = summary.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)} | {SEG: "__kseg"})
    same = F.col(SEG) == F.col("__kseg")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = s.join(summary, same, "left").drop("__kseg", *(f"__k{i}" for i in range(len(keys))))
    off = F.coalesce(F.col("__off"), F.lit(0))
    final = {rn: (F.col("__lrn") + off).cast("long")}

    def local_glob(st: str) -> Column:
        return F.when(F.col(st).isNotNull(), F.struct((F.col(f"{st}.rn") + off).cast("long").alias("rn"),
                                                      F.col(f"{st}.v").alias("v")))

    def carried(c: str) -> Column:
        return F.struct(F.col(f"{c}.rn").cast("long").alias("rn"), F.col(f"{c}.v").alias("v"))

    for name in prev:
        final[name] = F.coalesce(local_glob(f"__lp_{name}"),
                                 F.when(F.col(f"__cp_{name}").isNotNull(), carried(f"__cp_{name}")))
    for name in nxt:
        final[name] = F.coalesce(local_glob(f"__ln_{name}"),
                                 F.when(F.col(f"__cn_{name}").isNotNull(), carried(f"__cn_{name}")))
    for name in sums:
        final[name] = F.col(f"__ls_{name}") + F.coalesce(F.col(f"__cs_{name}"), F.lit(0.0))
    out = out.withColumns(final)
    internal = [c for c in out.columns if c.startswith("__") and c not in final and c not in df.columns]
    return out.drop(*internal)

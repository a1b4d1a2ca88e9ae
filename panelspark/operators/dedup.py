"""Keep-first / keep-last deduplication.

Written as an aggregate over a struct (``min``/``max`` of ``struct(order..., payload...)``)
instead of ``row_number()`` over a window: the aggregate is partial (map-side
combine), so a key that holds a third of all rows is reduced inside every map
task before the shuffle, and the result is deterministic because the whole row
takes part in the tie-break.

Struct ordering is field by field, ascending, nulls first -- exactly "sort with
nulls first, keep first (min) / keep last (max)".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order_exprs(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], pick) -> DataFrame:
    keys = list(keys)
    order_cols = _order_exprs(order)
    payload = [c for c in df.columns if c not in keys]
    ordered = [o.alias(f"__o{i}") for i, o in enumerate(order_cols)]
    packed = F.struct(*ordered, *[F.col(c) for c in payload]).alias("__row")
    agg = df.groupBy(*keys).agg(pick(packed).alias("__row"))
    return agg.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in payload]).select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per ``keys`` in ``order`` (ascending, nulls first); remaining columns break ties."""
    return _keep(df, keys, order, F.min)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Last row per ``keys`` in ``order`` sorted ascending with nulls first.

    Real rows (non-null ``order`` columns) therefore beat synthetic rows whose
    order columns are null.
    """
    return _keep(df, keys, order, F.max)


def drop_duplicates_deterministic(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``drop_duplicates(subset=keys)`` with a full, deterministic tie-break (D3)."""
    return keep_first(df, keys, [c for c in df.columns if c not in keys])

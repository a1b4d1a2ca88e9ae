"""Panel time-series operators over ``Window.partitionBy(key).orderBy(order)``.

Every operator here works on an entity-year panel that is unique on
(key, year) -- the firm history is bounded by the calendar span (at most a few
hundred rows), so a per-key window never holds an unbounded group. All frames
are written out with ``rowsBetween`` (the default frame with ``orderBy`` is a
range frame) and every ordering carries a full tie-break.

Operators that share ``partitionBy(key)`` reuse one hash partitioning, so a
chain of them costs one shuffle.

For tables where one key may hold a large share of the rows, the scan
operators take ``segments=N``: the key is then range-split over N partitions
and scanned in two levels (``segmented.segmented_scan``), so no task holds a
whole key. Results are identical; the cost is one extra shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segmented import segmented_scan


def _cols(xs) -> list[Column]:
    xs = [xs] if isinstance(xs, (str, Column)) else list(xs)
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _w(key, order, extra_partition: Sequence[Column] = ()):
    return Window.partitionBy(*_cols(key), *extra_partition).orderBy(*_cols(order))


# --------------------------------------------------------------------------- W1

def _names(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _total(df: DataFrame, key, order) -> list[Column]:
    """The order with every other sortable column after it, so that only equal rows tie."""
    given = _cols(order)
    used = set(_names(key)) | {o for o in ([order] if isinstance(order, str) else order) if isinstance(o, str)}
    return given + [F.col(f"`{c}`") for c, t in df.dtypes if c not in used and "map<" not in t and "variant" not in t]


def row_index(df: DataFrame, key, order, out: str = "count", segments: int | None = None) -> DataFrame:
    """Running row number from 0 within each key (W1); the other columns break ties."""
    order = _total(df, key, order)
    if segments:
        t = segmented_scan(df, _names(key), _cols(order), segments)
        return t.withColumn(out, (F.col("__rn") - 1).cast("long")).drop("__rn")
    return df.withColumn(out, (F.row_number().over(_w(key, order)) - 1).cast("long"))


# --------------------------------------------------------------------------- W2

def nearest_fill(df: DataFrame, key, order, col: str, when: Column | None = None,
                 era: Column | None = None, out: str | None = None, segments: int | None = None) -> DataFrame:
    """Fill flagged null values from the nearest non-null value of the same key.

    Distance is counted in rows in ``order`` (the other columns break its ties); an
    equal distance goes to the previous value;
    filled values are never reused as donors. ``when`` flags the rows to fill
    (default: every null). ``era`` (a boolean column) restricts both the rows
    and the donors to that era and numbers rows inside it, as when the source
    split the panel at a year and processed one part.
    """
    out = out or col
    x = F.col(col)
    order = _total(df, key, order)
    if segments:
        keys = _names(key)
        base = df
        if era is not None:
            base, keys = df.withColumn("__era", era), keys + ["__era"]
        tagged = segmented_scan(base, keys, _cols(order), segments, prev={"__prev": x}, nxt={"__next": x})
        if era is not None:
            tagged = tagged.drop("__era")
    else:
        extra = [era] if era is not None else []
        w = _w(key, order, extra)
        rn = F.row_number().over(w)
        tagged = df.withColumn("__rn", rn)
        donor = F.when(x.isNotNull(), F.struct(F.col("__rn").alias("rn"), x.alias("v")))
        prev = F.last(donor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        nxt = F.first(donor, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
        tagged = tagged.withColumns({"__prev": prev, "__next": nxt})
    p, n, r = F.col("__prev"), F.col("__next"), F.col("__rn")
    pick = (F.when(p.isNull(), n.v)
            .when(n.isNull(), p.v)
            .when((r - p.rn) <= (n.rn - r), p.v)
            .otherwise(n.v))
    flag = x.isNull() if when is None else (x.isNull() & when)
    if era is not None:
        flag = flag & era
    keep = [c for c in df.columns if c != out]
    return tagged.select(*keep, F.when(flag, pick).otherwise(x).alias(out)).select(*df.columns, *([] if out in df.columns else [out]))


# --------------------------------------------------------------------------- W3

def bfill(df: DataFrame, key, order, cols: Sequence[str] | str, suffix: str = "",
          segments: int | None = None, unique: bool = False) -> DataFrame:
    """Backward fill per key: next non-null value at or after the row.
    ``unique``: no two rows of a key tie in ``order``, so no other column is needed to sort by."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    order = _cols(order) if unique else _total(df, key, order)
    if segments:
        nx = {f"__bf{i}": F.col(c) for i, c in enumerate(cols)}
        t = segmented_scan(df, _names(key), _cols(order), segments, nxt=nx)
        t = t.withColumns({c + suffix: F.coalesce(F.col(c), F.col(f"__bf{i}.v")) for i, c in enumerate(cols)})
        return t.drop("__rn", *nx)
    w = _w(key, order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    for c in cols:
        df = df.withColumn(c + suffix, F.first(F.col(c), ignorenulls=True).over(w))
    return df


# --------------------------------------------------------------------------- W4

def densify_years(df: DataFrame, key, year: str = "fyear", src: str | None = None,
                  segments: int | None = None, unique: bool = False) -> DataFrame:
    """One row per year from each key's first to last year; a gap year copies the
    whole previous row, its nulls included (W4). Rows that repeat a year stay, and the
    last of them - the other columns decide their order - fills the gap after it.
    ``unique``: no year repeats in a key, so rows are sorted by year alone.

    ``explode(sequence(year, next_year - 1))`` -- no calendar table and no join;
    the only shuffle is the window's partitioning by key.
    """
    order = _cols(year) if unique else _total(df, key, year)
    if segments:
        t = segmented_scan(df, _names(key), order, segments, nxt={"__ny": F.col(year)})
        out = t.withColumn("__to", F.greatest(F.col("__ny.v") - 1, F.col(year))).drop("__rn", "__ny")
    else:
        nxt = F.lead(F.col(year)).over(_w(key, order))
        out = df.withColumn("__to", F.greatest(nxt - 1, F.col(year)))
    if src:
        out = out.withColumn(src, F.col(year))
    return (out.withColumn(year, F.explode(F.sequence(F.col(year), F.col("__to"))))
               .withColumn(year, F.col(year).cast("int"))
               .drop("__to"))


# --------------------------------------------------------------------------- U1

def add_anchor_rows(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """Append synthetic rows (e.g. an IPO-year row); columns they lack are null."""
    return df.unionByName(anchors, allowMissingColumns=True)


# --------------------------------------------------------------------------- F12, A9

def value_at(df: DataFrame, key, year: str, col: str, at: int, order: Sequence[str] = ()) -> Column:
    """Aggregate: the value of the key's first row in year ``at`` (A9), by ``order`` and then the other columns; null without such a row."""
    first = F.struct(*_total(df, _names(key) + [year], list(order)))
    return F.min_by(F.col(col), F.when(F.col(year) == at, first))


def pivot_zero_fill(df: DataFrame, key, year: str, col: str, pivot_year: int,
                    out: str | None = None, segments: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """R&D pivot-year rule.

    From the pivot year on, null -> 0. Before it, null -> 0 only if the key has
    a row in the pivot year whose value is null or 0. "Row exists" is kept apart
    from "value is null". Of several rows in the pivot year the first in ``order`` decides, then the
    other columns from left to right, nulls first; arrival order never does.
    """
    out = out or col
    y, x = F.col(year), F.col(col)
    has_pivot = F.max(F.when(y == pivot_year, F.lit(1)))
    pivot_val = value_at(df, key, year, col, pivot_year, order)
    if segments:
        # per-key facts as a partial aggregate joined back: no task holds a whole key
        facts = df.groupBy(*_names(key)).agg(has_pivot.alias("__hp"), pivot_val.alias("__pv"))
        df = df.join(facts, _names(key), "left")
        has_pivot, pivot_val = F.col("__hp"), F.col("__pv")
    else:
        w = Window.partitionBy(*_cols(key))
        has_pivot, pivot_val = has_pivot.over(w), pivot_val.over(w)
    pivot_zero = (has_pivot == 1) & (pivot_val.isNull() | (pivot_val == 0))
    fill = x.isNull() & ((y >= pivot_year) | ((y < pivot_year) & pivot_zero))
    res = df.withColumn(out, F.when(fill, F.lit(0.0)).otherwise(x))
    return res.drop("__hp", "__pv") if segments else res


# --------------------------------------------------------------------------- W5

def backcast_rates(df: DataFrame, key, order, level: str, logv: str, rate: str,
                   out: str | None = None, segments: int | None = None) -> DataFrame:
    """Age-rate backcast in logs.

    For a row whose ``level`` is null, take the next row ``v`` with a level and
    set ``log x_t = log x_v - sum(rate over rows (t, v])``; a null rate counts 0.
    Rows with no later level stay null. Running sum C of the rate, then
    ``log x_v - (C_v - C_t)`` -- two window passes, linear in rows.
    """
    out = out or logv
    if segments:
        keys, oc = _names(key), _cols(order)
        t = segmented_scan(df, keys, oc, segments, sums={"__C": F.col(rate)}).drop("__rn")
        donor = F.when(F.col(level).isNotNull(), F.struct(F.col(logv).alias("lg"), F.col("__C").alias("c")))
        t = segmented_scan(t, keys, oc, segments, nxt={"__nx": donor}).drop("__rn")
        t = t.withColumn("__nx", F.col("__nx.v"))
    else:
        w = _w(key, order)
        c_run = F.sum(F.coalesce(F.col(rate), F.lit(0.0))).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        t = df.withColumn("__C", c_run)
        donor = F.when(F.col(level).isNotNull(), F.struct(F.col(logv).alias("lg"), F.col("__C").alias("c")))
        t = t.withColumn("__nx", F.first(donor, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    filled = F.col("__nx.lg") - (F.col("__nx.c") - F.col("__C"))
    return (t.withColumn(out, F.when(F.col(level).isNull(), filled).otherwise(F.col(logv)))
             .drop("__C", "__nx"))


# --------------------------------------------------------------------------- W6

def backcast_constant(df: DataFrame, key, order, logv: str, rate: Column | float,
                      out: str | None = None, segments: int | None = None) -> DataFrame:
    """Constant-rate backcast of null logs: ``log x_t = log x_v - s * (rows from t to v)``.

    ``v`` is the next row with a non-null log; null when there is none. Closed
    form of the source's step-by-step descent.
    """
    out = out or logv
    s = rate if isinstance(rate, Column) else F.lit(float(rate))
    if segments:
        t = segmented_scan(df, _names(key), _cols(order), segments, nxt={"__d": F.col(logv)})
        t = t.withColumn("__nx", F.when(F.col("__d").isNotNull(), F.struct(
            F.col("__d.v").alias("lg"), F.col("__d.rn").alias("rn")))).drop("__d")
    else:
        w = _w(key, order)
        t = df.withColumn("__rn", F.row_number().over(w))
        donor = F.when(F.col(logv).isNotNull(), F.struct(F.col(logv).alias("lg"), F.col("__rn").alias("rn")))
        t = t.withColumn("__nx", F.first(donor, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    filled = F.col("__nx.lg") - s * (F.col("__nx.rn") - F.col("__rn")).cast("double")
    return (t.withColumn(out, F.when(F.col(logv).isNull(), filled).otherwise(F.col(logv)))
             .drop("__rn", "__nx"))


# --------------------------------------------------------------------------- W8

def linear_recurrence(df: DataFrame, key, order: Sequence[str], recurrences: dict[str, tuple[Column, Column]],
                      block_rows: int | None = None, first_zero: bool = True,
                      segments: int = 64, _depth: int = 0) -> DataFrame:
    """Per-key ordered recurrences ``s_t = a_t * s_{t-1} + b_t``.

    ``recurrences`` maps an output column to its ``(a, b)`` column pair. With
    ``first_zero`` the first row's state is 0 whatever its ``b`` (the stock
    starts at 0); otherwise the state before the first row is 0. A null ``b``
    makes every later state null, as in the source.

    Default layout: each key's rows are gathered with ``collect_list`` after one
    hash shuffle on the key, sorted, folded with the SQL ``aggregate`` function
    and put back with ``inline`` -- all JVM-side. That suits keys of bounded
    length (one row per year). With ``block_rows=S`` no group exceeds S rows:
    rows get their global number within the key (``segmented_scan``, which
    splits hot keys), are cut into blocks of S, and each block folds into affine
    pairs ``s_t = P_t * s_in + Q_t``; the block ends form a recurrence of the same
    kind over (key, block), solved the same way (recursively, until every key
    fits in one block); each block's incoming state then completes its rows.
    Exact composition of the same steps, no exp/log closed form.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = list(order)
    names = list(recurrences)
    if block_rows:
        # one level of blocks, whatever the sizes; their ends recur in blocks again until one block holds a key
        if _depth == 0 or df.groupBy(*keys).count().filter(F.col("count") > block_rows).limit(1).count():
            return _blocked_recurrence(df, keys, order, recurrences, block_rows, first_zero, segments, _depth)
    payload = [c for c in df.columns if c not in keys and c not in order]
    inputs = []
    for i, n in enumerate(names):
        a, b = recurrences[n]
        inputs += [a.cast("double").alias(f"__a{i}"), b.cast("double").alias(f"__b{i}")]
    row = F.struct(*[F.col(o) for o in order], *[F.col(c) for c in payload], *inputs)
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    states = _fold(F.col("__rows"), len(names), "state", first_zero)
    g = g.withColumn("__st", states)
    zipped = F.arrays_zip(F.col("__rows").alias("r"), *[F.col(f"__st.s{i}").alias(f"s{i}") for i in range(len(names))])
    g = g.select(*keys, F.explode(zipped).alias("__z"))
    return g.select(*keys, *[F.col(f"__z.r.{c}").alias(c) for c in order + payload],
                    *[F.col(f"__z.s{i}").alias(n) for i, n in enumerate(names)])


def _fold(rows: Column, k: int, mode: str, first_zero: bool = False) -> Column:
    """Fold a sorted array of structs with ``__a{i}``/``__b{i}`` fields.

    mode ``state``: arrays ``s{i}`` of states from ``s_0 = 0`` (first state 0 when
    ``first_zero``). mode ``affine``: arrays ``p{i}``, ``q{i}`` with
    ``P_t = a_t P_{t-1}``, ``Q_t = a_t Q_{t-1} + b_t`` from (1, 0).
    """
    def merge(acc, x):
        parts, lasts = [], []
        for i in range(k):
            a, b = x[f"__a{i}"], x[f"__b{i}"]
            if mode == "state":
                done = acc[f"s{i}"]  # its last state is read back: named twice, it would be worked out twice
                first = F.lit(0.0) if first_zero else a * F.lit(0.0) + b
                new = F.when(F.size(done) == 0, first).otherwise(a * F.element_at(done, -1) + b)
                parts.append(F.concat(done, F.array(new)).alias(f"s{i}"))
            else:
                p, q = a * acc[f"lp{i}"], a * acc[f"lq{i}"] + b
                parts += [F.concat(acc[f"p{i}"], F.array(p)).alias(f"p{i}"),
                          F.concat(acc[f"q{i}"], F.array(q)).alias(f"q{i}")]
                lasts += [p.alias(f"lp{i}"), q.alias(f"lq{i}")]
        return F.struct(*parts, *lasts)

    empty = F.array().cast("array<double>")
    if mode == "state":
        zero = F.struct(*[empty.alias(f"s{i}") for i in range(k)])
    else:
        zero = F.struct(*[e for i in range(k) for e in (empty.alias(f"p{i}"), empty.alias(f"q{i}"))],
                        *[e for i in range(k) for e in (F.lit(1.0).alias(f"lp{i}"), F.lit(0.0).alias(f"lq{i}"))])
    return F.aggregate(rows, zero, merge)


def _blocked_recurrence(df: DataFrame, keys: list[str], order: list[str],
                        recurrences: dict[str, tuple[Column, Column]], block_rows: int, first_zero: bool,
                        segments: int, depth: int) -> DataFrame:
    blk = f"__blk{depth}"   # one name per recursion level: the level above orders by its own
    names = list(recurrences)
    k = len(names)
    inputs = {}
    for i, n in enumerate(names):
        a, b = recurrences[n]
        inputs[f"__a{i}"], inputs[f"__b{i}"] = a.cast("double"), b.cast("double")
    t = df.withColumns(inputs)
    t = segmented_scan(t, keys, [F.col(o) for o in order], segments)          # __rn, hot keys split
    if first_zero:  # the key's first state is 0: its step becomes s = 0 * s_in + 0
        t = t.withColumns({c: F.when(F.col("__rn") == 1, F.lit(0.0)).otherwise(F.col(c)) for c in inputs})
    t = t.withColumn(blk, F.floor((F.col("__rn") - 1) / block_rows).cast("long"))
    payload = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(F.col("__rn"), *[F.col(o) for o in order], *[F.col(c) for c in payload],
                   *[F.col(c) for c in inputs])
    g = t.groupBy(*keys, blk).agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    g = g.withColumn("__pq", _fold(F.col("__rows"), k, "affine"))
    # block ends: s_end(blk) = P_end * s_end(blk - 1) + Q_end, from 0 before the first block
    ends_in = g.select(*keys, blk, *[e for i in range(k) for e in (
        F.element_at(F.col(f"__pq.p{i}"), -1).alias(f"__pe{i}"), F.element_at(F.col(f"__pq.q{i}"), -1).alias(f"__qe{i}"))])
    ends = linear_recurrence(ends_in, keys, [blk],
                             {f"__e{i}": (F.col(f"__pe{i}"), F.col(f"__qe{i}")) for i in range(k)},
                             block_rows=block_rows, first_zero=False, segments=segments, _depth=depth + 1)
    s_in = ends.select(*keys, (F.col(blk) + 1).alias(blk), *[F.col(f"__e{i}") for i in range(k)])
    cols = [F.col("__rows").alias("r")] + [F.col(f"__pq.{x}{i}").alias(f"{x}{i}") for i in range(k) for x in "pq"]
    rows = g.select(*keys, blk, F.explode(F.arrays_zip(*cols)).alias("__z"))
    rows = rows.join(s_in, [*keys, blk], "left")
    out = [F.col(f"__z.r.{c}").alias(c) for c in order + payload]
    for i, n in enumerate(names):
        # block 0 starts from 0; a later block takes the previous block's end,
        # which is null once a null flow has occurred (nulls propagate, as in the fold)
        s_prev = F.when(F.col(blk) == 0, F.lit(0.0)).otherwise(F.col(f"__e{i}"))
        out.append((F.col(f"__z.p{i}") * s_prev + F.col(f"__z.q{i}")).alias(n))
    return rows.select(*keys, *out)

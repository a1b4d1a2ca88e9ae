"""Scans and sinks.

Every reader takes an explicit schema (no inference pass over 100 TB), every
writer is a plain DataFrameWriter call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null, parse_yyyymmdd
from ..session import materialize

# Fixed value: rows per part file chosen for the source's job queue.
ROWS_PER_PART = 1516

# Cells as pandas and spreadsheets write them: quoted where needed, a quote inside is doubled, a backslash is a
# backslash, spaces around a value are the value's own.
CSV_CELLS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# The texts that pandas reads as missing by default; an empty cell is one of them, quoted or not.
MISSING_TEXTS = ("", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


# --------------------------------------------------------------------------- S1-S3, S7

def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None,
               fmt: str = "parquet", **options) -> DataFrame:
    """Read a table; NaN becomes null. CSV goes by its header (``read_csv``)."""
    if fmt == "csv":
        return read_csv(spark, path, schema, **options)
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    for k, v in options.items():
        r = r.option(k, v)
    return without_nan(r.load(path if isinstance(path, str) else list(path)))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN -> null in every float column: the source's missing number."""
    kinds = {c: t for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns({c: nan_to_null(df[c]) for c in kinds}) if kinds else df


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None,
             corrupt: str | None = None, multi_line: bool = True, missing_texts: Sequence[str] = ("",), **options) -> DataFrame:
    """CSV with a header row (S1, S2, F3), its cells quoted as pandas does it.

    Columns are found by their header names, in any order and letter case; a
    missing one raises ``ValueError`` and ones outside the schema are left out.
    Dates may be yyyymmdd codes or yyyy-mm-dd; cells that the type can't hold
    become null; undecodable bytes become U+FFFD. ``corrupt`` names a column
    that tells what was wrong with a row: the whole record if its number of
    fields differs from the header's, else the names of its unreadable cells,
    joined by commas, and null for a sound row.

    Quoted cells may hold commas, doubled quotes and line breaks; a file is then read by one task, since only a
    scan from its start tells the breaks between rows. ``multi_line=False`` splits large files that
    have no line break in a cell. Cells that are one of ``missing_texts`` (as a whole) are null; by default an empty cell, quoted or
    not. ``MISSING_TEXTS`` is what pandas takes for missing.
    """
    paths = path if isinstance(path, str) else list(path)
    opts = {"header": "true", "encoding": "UTF-8", "mode": "PERMISSIVE", "multiLine": str(multi_line).lower(), **CSV_CELLS, **options}
    header = spark.read.options(**opts).option("inferSchema", "false").csv(paths).columns
    raw = "_corrupt_record"
    text = T.StructType([T.StructField(c, T.StringType()) for c in [*header, raw]])
    # enforceSchema=false: every file's header must be the first one's
    df = spark.read.schema(text).options(**opts).option("enforceSchema", "false").option("columnNameOfCorruptRecord", raw).csv(paths)
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema or T.StructType([T.StructField(c, T.StringType()) for c in header])).fields
    place = {c.strip().lower(): c for c in header}
    missing = [f.name for f in fields if f.name.lower() not in place]
    if missing:
        raise ValueError(f"the header of {path} lacks {', '.join(missing)}")
    cell = lambda c: F.when(~c.isin(list(missing_texts)), c) if missing_texts else c
    cells = {f.name: cell(F.col(f"`{place[f.name.lower()]}`")) for f in fields}
    typed = {f.name: _typed(cells[f.name], f.dataType) for f in fields}
    out = [typed[f.name].alias(f.name) for f in fields]
    if corrupt:
        bad = [F.when((F.trim(cells[c]) != "") & typed[c].isNull(), F.lit(c)) for c in typed]
        out.append(F.coalesce(F.col(raw), F.nullif(F.concat_ws(",", *bad), F.lit(""))).alias(corrupt))
    return df.select(*out)


def _typed(cell, kind: T.DataType):
    if isinstance(kind, T.StringType):
        return cell
    trimmed = F.trim(cell)
    if isinstance(kind, T.DateType):
        return F.when(F.length(trimmed) == 8, parse_yyyymmdd(trimmed)).otherwise(F.try_to_date(trimmed, "yyyy-MM-dd"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return nan_to_null(trimmed.try_cast(kind))
    if isinstance(kind, T.IntegralType):  # 7.0 is 7, as where a column with missing values was written from floats
        return trimmed.try_cast("decimal(38,6)").try_cast(kind)
    return trimmed.try_cast(kind)


def read_founding(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Founding list with the column subset and types the source asked for.

    Spark has no spreadsheet source; the sheet is landed as CSV (or Parquet)
    and read with an explicit schema, then columns are selected and renamed.
    Drop incomplete rows (``clean_founding``) before leaving columns out.
    """
    schema = T.StructType([
        T.StructField("CUSIP", T.StringType()),
        T.StructField("offer date", T.StringType()),
        T.StructField("Founding", T.IntegerType()),
    ])
    df = read_table(spark, path, schema if fmt == "csv" else None, fmt)
    return df.select(F.col("CUSIP").alias("cusip"), F.col("offer date").alias("offer_date"),
                     F.col("Founding").cast("int").alias("founding"))


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop columns whose name matches a regex, e.g. '^Unnamed' (P3)."""
    import re
    rx = re.compile(pattern)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not rx.match(c)])


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Raise ``ValueError`` when a required column is missing (P15); driver-side, schema only."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"these columns are needed and not there: {', '.join(missing)}")
    return df


# --------------------------------------------------------------------------- S6, O3

def read_parts(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet") -> DataFrame:
    """A directory of part files with each row's file name and modification time.

    Uses the hidden ``_metadata`` column: no driver-side listing loop.
    """
    df = read_table(spark, path, schema, fmt)
    return df.select("*", F.col("_metadata.file_name").alias("file_name"),
                     F.col("_metadata.file_modification_time").alias("file_mtime"))


# --------------------------------------------------------------------------- K1-K3, K5

def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                compression: str | None = None, partition_by: Sequence[str] = (),
                max_records_per_file: int | None = None) -> None:
    """CSV (header, cells quoted as pandas does it) or Parquet writer; ``compression='zstd'`` for K3.

    In CSV null is an empty cell and an empty text a quoted one; pandas reads both as missing.
    """
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(header="true", **CSV_CELLS)
    if compression:
        w = w.option("compression", compression)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_split(df: DataFrame, ok: str, ok_path: str, err_path: str, fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    """Dead-letter sink (K5): rows with ``ok`` true to one dataset, the rest (``ok`` false or null) to another.

    The plan runs once for each; pass a written table if it is dear.
    """
    good = F.coalesce(F.col(ok), F.lit(False))
    write_table(df.where(good).drop(ok), ok_path, fmt, mode)
    write_table(df.where(~good).drop(ok), err_path, fmt, mode)


# --------------------------------------------------------------------------- K4

def with_row_number(df: DataFrame, order: Sequence[str], out: str = "row_no") -> DataFrame:
    """Global 0-based row number in ``order`` without a single-partition window.

    The order columns alone - of any sortable types - are range partitioned on the whole
    order and sorted; each row's place within its partition is written down, and a
    running sum over one count per partition gives the offsets. The numbers then
    join the wide rows. ``order`` must be unique; nulls come first.
    """
    order = list(order)
    keys = df.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    # the id counts up from the partition's number << 33
    placed = materialize(keys.withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    numbered = placed.join(offsets, "__part").withColumn(out, (F.col("__off") + F.col("__at")).cast("long")).select(*order, out)
    if set(df.columns) == set(order):
        return numbered.select(*df.columns, out)
    n = numbered.select(*(F.col(c).alias(f"__{c}") for c in order), out)
    same = [df[c].eqNullSafe(n[f"__{c}"]) for c in order]
    return df.join(n, same).select(*(df[c] for c in df.columns), out)


def row_chunks(df: DataFrame, order: Sequence[str], rows: int = ROWS_PER_PART, out: str = "chunk") -> DataFrame:
    """Stable part number: consecutive blocks of ``rows`` rows in ``order`` (K4)."""
    numbered = with_row_number(df, order, "__row")
    return numbered.withColumn(out, F.floor(F.col("__row") / rows).cast("long")).drop("__row")


def with_total_before(df: DataFrame, order: Sequence[str], cost: Column, out: str = "total") -> DataFrame:
    """The sum of the costs (whole numbers, null is 0) of all rows before each one in ``order``, without a window over the whole table.

    The order columns and costs alone are range partitioned on the whole order; running sums within each
    partition and one sum per partition before it give the totals, which then join the wide rows. ``order`` must
    be unique; nulls come first.
    """
    order = list(order)
    keys = df.select(*order, F.coalesce(cost.cast("long"), F.lit(0)).alias("__cost")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(keys.withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    own = placed.groupBy("__part").agg(F.sum("__cost").alias("__all"))  # one row a partition
    offsets = own.select("__part", F.coalesce(F.sum("__all").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    inside = F.coalesce(F.sum("__cost").over(Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = placed.withColumn("__in", inside).join(offsets, "__part").select(*(F.col(c).alias(f"__{c}") for c in order), (F.col("__off") + F.col("__in")).cast("long").alias(out))
    return df.join(total, [df[c].eqNullSafe(total[f"__{c}"]) for c in order]).select(*(df[c] for c in df.columns), out)


def cost_chunks(df: DataFrame, order: Sequence[str], cost: Column, bound: int | None = None, parts: int | None = None, out: str = "chunk") -> DataFrame:
    """Part numbers of contiguous blocks in ``order`` whose costs are balanced (K4).

    A row goes to the part in which the costs before it end: parts have at most ``bound`` plus the cost of their last row, so none is larger than the bound by
    more than one row. ``parts`` gives the bound that makes so many parts. Numbers rise with the order; a row that costs several bounds
    leaves the numbers after it out.
    """
    if (bound is None) == (parts is None):
        raise ValueError("give either the bound or the number of parts")
    if parts is not None:
        whole = df.agg(F.sum(cost.cast("long")).alias("n")).first()["n"] or 0
        bound = -(-whole // parts)
    return with_total_before(df, order, cost, "__before").withColumn(out, F.floor(F.col("__before") / max(1, bound)).cast("long")).drop("__before")


def write_cost_chunks(df: DataFrame, path: str, order: Sequence[str], cost: Column, bound: int | None = None, parts: int | None = None, fmt: str = "parquet") -> None:
    """Write one directory per part (``chunk=N``) of balanced cost, rows kept in order (K4)."""
    (cost_chunks(df, order, cost, bound, parts).repartition("chunk").sortWithinPartitions("chunk", *order)
        .write.mode("overwrite").format(fmt).partitionBy("chunk").save(path))


def write_row_chunks(df: DataFrame, path: str, order: Sequence[str], rows: int = ROWS_PER_PART,
                     fmt: str = "parquet") -> None:
    """Write one directory per part number (``chunk=N``), rows kept in order (K4)."""
    parts = row_chunks(df, order, rows)
    (parts.repartition("chunk").sortWithinPartitions("chunk", *order)  # the writer's own order, so it sorts no more
          .write.mode("overwrite").format(fmt).partitionBy("chunk").save(path))

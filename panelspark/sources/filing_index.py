"""The quarterly filing index as a data source.

``read_filing_index(spark, folder)`` reads fixed-width index files in folders ``<year>/QTR<n>`` (or
``y=<year>/q=QTR<n>``): some header lines, a line of dashes, then a filing a line. The places of the columns are those of the header line, so files of either
layout (by form or by company) are read. Each quarter's file is a partition; filters on ``date`` and
``year`` and ``quarter`` leave out whole quarters, which are never opened, and filters on ``form`` are applied to the line before
anything else of it is cut out.

The option ``file`` names the files (default form.idx; * for all). The folder must be one that every worker sees. Lines shorter than a column give nulls in it; lines without a date are skipped.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

SCHEMA = "form string, company string, cik long, date date, fname string, year int, quarter int"
#: The header's names of the columns.
HEADINGS = {"Form Type": "form", "Company Name": "company", "CIK": "cik", "Date Filed": "date", "File Name": "fname", "Filename": "fname"}
#: Rows of a record batch.
ROWS = 8192


class Quarter(InputPartition):
    def __init__(self, path: str, year: int, quarter: int):
        self.path, self.year, self.quarter = path, year, quarter

    def days(self) -> tuple[dt.date, dt.date]:
        """First and last day."""
        first = dt.date(self.year, 3 * self.quarter - 2, 1)
        after = dt.date(self.year + self.quarter // 4, 3 * self.quarter % 12 + 1, 1)
        return first, after - dt.timedelta(1)


class FilingIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filing_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FilingIndexReader(self.options["path"], self.options.get("file", "form.idx"))


class FilingIndexReader(DataSourceReader):
    def __init__(self, path: str, file: str):
        self.path, self.file = re.sub("^file:(//)?(?=/)", "", path), file
        self.first, self.last = dt.date.min, dt.date.max
        self.years: set[int] | None = None
        self.quarters: set[int] | None = None
        self.forms: set[str] | None = None
        self.prefix = ""

    def pushFilters(self, filters) -> Iterator:
        """Take over filters on form; use those on dates and quarters to leave quarters out, and have Spark apply them as well."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                if column == "form":
                    self.forms = values if self.forms is None else self.forms & values
                    continue
                if column == "year":
                    self.years = values if self.years is None else self.years & values
                if column == "quarter":
                    self.quarters = values if self.quarters is None else self.quarters & values
                if column == "date" and values and all(isinstance(v, dt.date) for v in values):
                    self.first, self.last = max(self.first, min(values)), min(self.last, max(values))
            elif isinstance(f, StringStartsWith) and column == "form" and (f.value.startswith(self.prefix) or self.prefix.startswith(f.value)):
                self.prefix = max(self.prefix, f.value, key=len)
                continue
            elif column == "date" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + dt.timedelta(isinstance(f, GreaterThan)))
            elif column == "date" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value - dt.timedelta(isinstance(f, LessThan)))
            yield f

    def partitions(self) -> list[Quarter]:
        found = []
        for year in sorted(os.listdir(self.path)):
            y = re.fullmatch(r"(?:\w+=)?([0-9]{4})", year)
            for quarter in sorted(os.listdir(f"{self.path}/{year}")) if y else []:
                q = re.fullmatch(r"(?:\w+=)?QTR([1-4])", quarter)
                if q and self._wanted(part := Quarter(f"{self.path}/{year}/{quarter}", int(y[1]), int(q[1]))):
                    files = fnmatch.filter(sorted(os.listdir(part.path)), self.file)
                    found += [Quarter(f"{part.path}/{f}", part.year, part.quarter) for f in files if f[0] not in "._"]
        return found

    def _wanted(self, q: Quarter) -> bool:
        first, last = q.days()
        return (first <= self.last and last >= self.first and (self.years is None or q.year in self.years)
                and (self.quarters is None or q.quarter in self.quarters))

    def read(self, part: Quarter | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no quarter is left
            return
        schema = pa.schema([("form", pa.string()), ("company", pa.string()), ("cik", pa.int64()), ("date", pa.date32()), ("fname", pa.string()), ("year", pa.int32()), ("quarter", pa.int32())])
        rows: list[tuple] = []
        with open(part.path, encoding="utf-8", errors="replace") as lines:
            places = _places(lines)
            for line in lines:
                form = line[places["form"]].strip()
                if (self.forms is not None and form not in self.forms) or not form.startswith(self.prefix):
                    continue
                day = _date(line[places["date"]])
                if day is None:
                    continue
                cik = line[places["cik"]].strip()
                rows.append((form, line[places["company"]].strip() or None, int(cik) if cik.isdigit() else None, day, line[places["fname"]].strip() or None, part.year, part.quarter))
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _places(lines: Iterator[str]) -> dict[str, slice]:
    """Columns' places from the header line; reads on to the first line after the dashes."""
    places: dict[str, slice] = {}
    for line in lines:
        if line.startswith("----"):
            break
        at = sorted((line.index(h), c) for h, c in HEADINGS.items() if h in line)
        if len({c for _, c in at}) == len(set(HEADINGS.values())):
            ends = [a for a, _ in at[1:]] + [None]
            places = {c: slice(a, b) for (a, c), b in zip(at, ends)}
    if not places:
        raise ValueError("the index has no header line with all columns")
    return places


def _date(text: str) -> dt.date | None:
    text = text.strip().replace("-", "")
    try:
        return dt.date(int(text[:4]), int(text[4:6]), int(text[6:8])) if len(text) == 8 else None
    except ValueError:
        return None


def read_filing_index(spark: SparkSession, path: str, file: str = "form.idx") -> DataFrame:
    """The index as a table whose filters are pushed down.

    Spark keeps what a frame's last pushed filters left, and reads just that again where a later query of the same frame
    pushes none. So the frame has a filter of its own that holds for every row: each query pushes its filters anew.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilingIndex)
    return spark.read.format("filing_index").option("file", file).load(path).where("year > 0")

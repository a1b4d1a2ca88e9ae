"""URL filters on odd URLs and histories (whole tables are checked against SQL)."""

import datetime as dt
import re

from pyspark.sql import functions as F

from panelspark.llm import url_filter as U

from ..conftest import SF001

DAY = "date_add(date'2024-01-01', n)"


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "not a url", 0), (2, "http://A.b.C./x//y?z", 3), (2, "http://A.b.C./x//y?z", 3), (3, "http://user@h:80", None), (4, "http://h", 5), (5, "http://h/" + "s/" * 300, 6)]
    captures = spark.createDataFrame(rows, "page_id long, url string, n int").withColumn("day", F.expr(DAY)).withColumn("key", F.lit(1)).withColumn("row", F.lit(2))
    entries = spark.createDataFrame(
        [("d:c", "spam", 1, True), ("d:c", "spam", 3, False), ("d:c", "spam", 3, True), ("p:a.b.c/x/y", None, 0, True), ("p:a.b.c/x/y", None, 2, False),
         ("d:h", "s", None, True), ("d:h", "s", 6, True), ("d:h", "t", 5, None), (None, "s", 1, True)], "key string, category string, n int, added boolean").withColumn("day", F.expr(DAY))
    got = sorted((str(r.page_id), str(r.host), r.blocked, r.n_active, r.since, r.categories) for r in U.filter_captures(captures, entries, "page_id", "url", "day").collect())
    day = dt.date(2024, 1, 4)
    assert got == [("1", "None", False, 0, None, []), ("2", "a.b.c", True, 1, day, ["spam"]), ("2", "a.b.c", True, 1, day, ["spam"]),
                   ("3", "h", False, 0, None, []), ("4", "h", False, 0, None, []), ("5", "h", True, 1, dt.date(2024, 1, 7), ["s"]), ("None", "None", False, 0, None, [])]
    assert U.filter_captures(captures.limit(0), entries, "page_id", "url", "day").count() == 0
    assert {r.blocked for r in U.filter_captures(captures, entries.limit(0), "page_id", "url", "day").collect()} == {False}


def test_intervals(spark):
    rows = [("k", "c", 1, True), ("k", "c", 4, True), ("k", "c", 6, False), ("k", "c", 6, False), ("k", "c", 9, True), ("k", "d", 2, False)]
    got = U.intervals(spark.createDataFrame(rows, "key string, category string, day int, added boolean")).collect()
    assert sorted((r.first, r.until or 99) for r in got) == [(1, 4), (4, 6), (9, 99)]


def test_no_python_in_the_plan(spark, capsys):
    from panelspark.llm import queries

    queries.QUERIES["op10_url_filter"](spark, SF001).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)

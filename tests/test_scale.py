"""Quoted CSV both ways with pandas, dyadic joins, balanced parts, batches by budget, rows that tie."""

import datetime as dt
import glob
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import links as L
from panelspark.operators import panel as P
from panelspark.operators import returns as R
from panelspark.operators import vectors as V
from panelspark.sources import io

CELLS = ['ACME "X", INC', '"', '""', "tail\\", '\\"', "a\nb", "a\r\nb", "a\rb", " lead", "trail ", ",", "", None, 'x,"y"\n"z"', "\\", '"quoted"', "#c", "é", "NA", "tab\there", "'"]


def test_reads_what_pandas_writes(spark, tmp_dir):
    pd.DataFrame({"k": range(len(CELLS)), "name": CELLS, "n": [1.5] * len(CELLS)}).to_csv(f"{tmp_dir}/a.csv", index=False)
    got = {r.k: (r.name, r.n) for r in io.read_csv(spark, f"{tmp_dir}/a.csv", "k int, name string, n double").collect()}
    assert got == {k: (v or None, 1.5) for k, v in enumerate(CELLS)}
    as_pandas = {r.k: r.name for r in io.read_csv(spark, f"{tmp_dir}/a.csv", "k int, name string", missing_texts=io.MISSING_TEXTS).collect()}
    want = pd.read_csv(f"{tmp_dir}/a.csv").set_index("k").name
    assert {k: v is None for k, v in as_pandas.items()} == want.isna().to_dict()


def test_pandas_reads_what_we_write(spark, tmp_dir):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(CELLS)], "k int, name string")
    io.write_table(df, f"{tmp_dir}/o", "csv")
    back = pd.concat(pd.read_csv(f, keep_default_na=False) for f in glob.glob(f"{tmp_dir}/o/*.csv")).set_index("k").name
    assert back.to_dict() == {k: v or "" for k, v in enumerate(CELLS)}
    assert {r.k: r.name for r in io.read_csv(spark, f"{tmp_dir}/o", "k int, name string").collect()} == {k: v or None for k, v in enumerate(CELLS)}


def test_quoted_cells_shift_no_column(spark, tmp_dir):
    with open(f"{tmp_dir}/q.csv", "w") as f:
        f.write('k,conm,sale\n1,"ACME ""X"", INC",5\n2,"TAIL\\",6\n3,"two\nlines",7\n4,short\n5,"a",8\n')
    rows = io.read_csv(spark, f"{tmp_dir}/q.csv", "k int, conm string, sale double", corrupt="wrong").collect()
    assert [(r.k, r.conm, r.sale) for r in rows if r.wrong is None] == [(1, 'ACME "X", INC', 5.0), (2, "TAIL\\", 6.0), (3, "two\nlines", 7.0), (5, "a", 8.0)]
    assert [r.wrong for r in rows if r.wrong] == ["4,short"]
    lines = io.read_csv(spark, f"{tmp_dir}/q.csv", "k int, conm string, sale double", multi_line=False).where("k in (1, 2, 5)")
    assert sorted((r.k, r.conm) for r in lines.collect()) == [(1, 'ACME "X", INC'), (2, "TAIL\\"), (5, "a")]


# --------------------------------------------------------------------------- dyadic joins


@pytest.mark.parametrize("levels", [1, 3, 6])
def test_dyadic_cover_is_the_interval(spark, levels):
    rng = random.Random(levels)
    spans = [(rng.randint(-40, 40), rng.randint(-40, 60)) for _ in range(150)] + [(5, 5), (0, 63), (-64, 63), (None, 3), (3, None), (7, 6)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "i int, a long, b long")
    for r in df.select("i", L.dyadic_cover(F.col("a"), F.col("b"), levels).alias("c")).collect():
        a, b = spans[r.i]
        days = [d for x in (r.c or []) for d in range(x.block << x.level, (x.block + 1) << x.level)]
        assert sorted(days) == (list(range(a, b + 1)) if a is not None and b is not None else [])
        assert all(x.level < levels for x in r.c or []) and len([x for x in r.c or [] if x.level < levels - 1]) <= 2 * (levels - 1)


def test_open_ends_cost_a_few_rows(spark):
    df = spark.createDataFrame([(dt.date(1700, 1, 1), dt.date(2260, 1, 1))], "a date, b date")
    assert len(df.select(L.dyadic_cover(F.unix_date("a").cast("long"), F.unix_date("b").cast("long")).alias("c")).first().c) < 40


def frames(spark):
    rng = random.Random(9)
    day = lambda: dt.date(1990, 1, 1) + dt.timedelta(rng.randint(0, 9000))
    firm = lambda: 1 if rng.random() < .4 else rng.choice([2, 3, 4, None])
    rows = [(firm(), day() if rng.random() < .95 else None, i) for i in range(800)]
    spans = [(firm(), rng.choice([day(), dt.date(1700, 1, 1), None]), rng.choice([day(), dt.date(2260, 1, 1), None]), rng.random() < .2, i) for i in range(60)]
    return spark.createDataFrame(rows + rows[:5], "k int, at date, v int"), spark.createDataFrame(spans, "k int, link_start date, link_end date, end_open boolean, link int")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_dyadic_joins_equal_range_joins(spark):
    df, lk = frames(spark)
    assert same(L.interval_join(df, lk, "k", "at"), L.dyadic_interval_join(df, lk, "k", "at"))
    years = df.withColumn("fyear", F.year("at")).select("k", "fyear", "v")
    assert same(L.containing_links(years, lk, "k", "fyear"), L.dyadic_containing_links(years, lk, "k", "fyear"))
    assert L.dyadic_interval_join(df.limit(0), lk, "k", "at").count() == 0


def test_dyadic_join_has_no_range_test(spark, capsys):
    df, lk = frames(spark)
    L.dyadic_interval_join(df, lk, "k", "at").explain()
    plan = capsys.readouterr().out
    assert ">=" not in plan and "<=" not in plan.replace("<=>", "") and "NestedLoop" not in plan and "Cartesian" not in plan


def test_dyadic_ranges_are_not_broadcast(spark, capsys, tmp_dir):
    """Tables of a known small size: their ranges, some twenty rows a row, must not pass through the driver."""
    df, lk = frames(spark)
    df.write.parquet(f"{tmp_dir}/df")
    lk.write.parquet(f"{tmp_dir}/lk")
    df, lk = spark.read.parquet(f"{tmp_dir}/df"), spark.read.parquet(f"{tmp_dir}/lk")
    years = df.withColumn("fyear", F.year("at")).select("k", "fyear", "v")
    for out, plain in ((L.dyadic_interval_join(df, lk, "k", "at"), L.interval_join(df, lk, "k", "at")), (L.dyadic_containing_links(years, lk, "k", "fyear"), L.containing_links(years, lk, "k", "fyear"))):
        assert same(plain, out)
        out.explain()
        assert "Broadcast" not in capsys.readouterr().out


# --------------------------------------------------------------------------- balanced parts


def test_parts_of_balanced_cost(spark, tmp_dir):
    rng = random.Random(2)
    cost = [rng.choice([0, 1, 5, 40]) for _ in range(500)]
    df = spark.createDataFrame([(i, c if c else None, "t") for i, c in enumerate(cost)], "i int, c int, t string").repartition(6)
    for kw in ({"bound": 60}, {"parts": 9}):
        rows = sorted((r.i, r.chunk) for r in io.cost_chunks(df, ["i"], F.col("c"), **kw).collect())
        assert [c for _, c in rows] == sorted(c for _, c in rows)
        bound = kw.get("bound") or -(-sum(cost) // 9)
        for part in {c for _, c in rows}:
            own = [cost[i] for i, c in rows if c == part]
            assert sum(own[:-1]) < bound + max(own) and sum(own) - own[-1] <= bound
        if "parts" in kw:
            assert len({c for _, c in rows}) == 9
    io.write_cost_chunks(df, f"{tmp_dir}/p", ["i"], F.col("c"), bound=60)
    assert spark.read.parquet(f"{tmp_dir}/p").count() == 500
    with pytest.raises(ValueError):
        io.cost_chunks(df, ["i"], F.col("c"))
    assert io.cost_chunks(df.limit(0), ["i"], F.col("c"), parts=3).count() == 0


# --------------------------------------------------------------------------- batches by budget


class Padded:
    """Gives each text its own length and the padded size of the batch it came in."""

    def tokens(self, texts):
        return [len(t) for t in texts]

    def encode(self, texts):
        return np.array([[len(t), len(texts) * max(map(len, texts)), len(texts)] for t in texts], dtype=np.float32)


def test_batches_stay_under_their_budget(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.choice([0, 1, 3, 50, 120, 400])) for i in range(700)] + [(1000, None), (1001, "y" * 900)]
    df = spark.createDataFrame(rows, "k int, chunk string").repartition(3)
    got = {r.k: r.vec for r in V.embed_by_budget(df, factory=Padded, budget=500).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: len(t or "") for k, t in rows}
    assert all(v[1] <= 500 or v[2] == 1 for v in got.values()) and got[1001][2] == 1
    assert max(v[2] for v in got.values()) > 100  # short texts go together
    same_size = V.embed_by_budget(df, factory=lambda: V.HashingEncoder(8), budget=64)
    plain = V.embed_chunks(df.na.fill("", ["chunk"]), factory=lambda: V.HashingEncoder(8))
    assert {r.k: r.vec for r in same_size.collect()} == {r.k: r.vec for r in plain.collect()}


def test_budget_batches_hold_each_row_once():
    rng = np.random.default_rng(1)
    for budget in (1, 10, 1000):
        tokens = rng.integers(0, 60, 300)
        parts = V.budget_batches(tokens, budget)
        assert sorted(np.concatenate(parts).tolist()) == list(range(300))
        assert all(len(p) == 1 or len(p) * tokens[p].max() <= budget for p in parts)
    assert V.budget_batches(np.zeros(0, dtype=np.int64), 5) == []


def test_the_stage_takes_a_resource_profile(spark):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build
    df = spark.createDataFrame([(1, "a")], "k int, chunk string")
    planned = V.embed_by_budget(df, profile=profile)._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in planned  # a local session can't run it: profiles need a cluster manager
    assert V.embed_by_budget(df, profile=profile)._jdf.queryExecution().analyzed().profile().isDefined()


# --------------------------------------------------------------------------- rows that tie


@pytest.mark.parametrize("segments", [None, 3])
def test_pivot_rows_that_tie_do_not_depend_on_arrival(spark, segments):
    rows = [(1, 1970, "1970-12-31", None), (1, 1977, "1977-06-30", 0.0), (1, 1977, "1977-12-31", 5.0),
            (2, 1970, "1970-12-31", None), (2, 1977, "1977-06-30", 5.0), (2, 1977, "1977-12-31", 0.0),
            (3, 1970, "1970-12-31", None), (3, 1977, "1977-06-30", None), (3, 1977, "1977-06-30", 7.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k int, y int, d string, x double")
        out = {r.k: r.x for r in P.pivot_zero_fill(df, "k", "y", "x", 1977, segments=segments, order=["d"]).where("y = 1970").collect()}
        assert out == {1: 0.0, 2: None, 3: 0.0}


@pytest.mark.parametrize("segments", [None, 3])
def test_densify_with_repeated_years(spark, segments):
    rows = [(1, 2000, "a"), (1, 2000, "b"), (1, 2003, "c"), (1, 2003, "c"), (2, 1999, "d")]
    df = spark.createDataFrame(rows[::-1], "k int, y int, v string")
    got = sorted((r.k, r.y, r.v) for r in P.densify_years(df, "k", "y", segments=segments).collect())
    assert got == [(1, 2000, "a"), (1, 2000, "b"), (1, 2001, "b"), (1, 2002, "b"), (1, 2003, "c"), (1, 2003, "c"), (2, 1999, "d")]


def test_securities_without_issuer_have_no_first_month(spark):
    m = spark.createDataFrame([(1, None, 2000, "2000-01-01", 0.5), (2, None, 2000, "1999-01-01", 0.1), (3, 9, 2000, "2000-02-01", 0.0), (4, 9, 2000, "1998-02-01", 0.0)],
                              "permno int, permco int, yr int, date string, ret double")
    got = {r.permno: (r.crsp_first_date, round(r.ret, 9)) for r in R.annual_returns(m, "yr").collect()}
    assert got == {1: (None, 0.5), 2: (None, 0.1), 3: ("1998-02-01", 0.0), 4: ("1998-02-01", 0.0)}


# --------------------------------------------------------------------------- quoted files of bounded size


def test_quoted_files_are_bounded(spark, tmp_dir, monkeypatch):
    from panelspark.plans import catalog_scale

    rows = [(i, f'a "{i}"\nb, \\' + "x" * (i % 7) * 50 if i % 5 else None, "s" if i % 2 else None, i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    monkeypatch.setattr(catalog_scale, "QUOTED_FILE", 2000, raising=False)
    out = catalog_scale.q_csv_quoted_cells(spark, tmp_dir)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(i, t, n) for i, t, _, n in rows]
    sizes = [os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles()]
    assert len(sizes) > 4 and max(sizes) < 3 * 2000

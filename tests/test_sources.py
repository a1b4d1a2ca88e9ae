"""CSV by header, row numbers of any order, the encoder path, ties and the checkpoint folder."""

import pytest
from pyspark.sql import functions as F

from panelspark import cli
from panelspark import session as S
from panelspark.operators import intangibles as I
from panelspark.operators import links, panel as P, text, vectors
from panelspark.plans import testviews as V
from panelspark.sources import io, schemas

from .conftest import SF001


def _file(folder, name, data):
    path = f"{folder}/{name}"
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_csv_goes_by_its_header(spark, tmp_dir):
    path = _file(tmp_dir, "m.csv", b"PERMNO,PERMCO,date,ret,SHROUT,altprc,primaryexch,siccd,extra\n10001,7,20200131,0.5,NaN,3,N,7.0,x\n10002,8,2020-02-29,C,1,,Q,12,\xff\n")
    rows = io.read_table(spark, path, schemas.MONTHLY, "csv").collect()
    assert [(r.permco, r.permno, str(r.date), r.ret, r.shrout, r.altprc, r.primaryexch, r.siccd) for r in rows] == [
        (7, 10001, "2020-01-31", 0.5, None, 3.0, "N", 7), (8, 10002, "2020-02-29", None, 1.0, None, "Q", 12)]
    with pytest.raises(ValueError, match="fyear"):
        io.read_table(spark, path, schemas.CCM, "csv")


def test_csv_tells_what_is_wrong(spark, tmp_dir):
    path = _file(tmp_dir, "c.csv", b"a,b\n1,20200101\nx,20209999\n3\n4,20200101,more\n5,caf\xe9\n")
    rows = io.read_csv(spark, path, "a int, b date", corrupt="wrong").collect()
    assert [(r.a, str(r.b), r.wrong) for r in rows] == [(1, "2020-01-01", None), (None, "None", "a,b"), (3, "None", "3"), (4, "2020-01-01", "4,20200101,more"), (5, "None", "b")]
    names = io.read_csv(spark, path, "b string").collect()
    assert names[4].b == "caf�"


def test_parquet_nan_is_null(spark, tmp_dir):
    spark.createDataFrame([(1, float("nan")), (2, 2.0)], "k int, x double").write.parquet(f"{tmp_dir}/p")
    assert {r.k: r.x for r in io.read_table(spark, f"{tmp_dir}/p").collect()} == {1: None, 2: 2.0}


@pytest.mark.parametrize("n", [1, 9])
def test_row_numbers_of_mixed_orders(spark, n):
    rows = [(f"k{i % 7}" if i % 11 else None, i, f"v{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "s string, i int, v string").repartition(n)
    got = {(r.s, r.i): r.row_no for r in io.with_row_number(df, ["s", "i"]).collect()}
    assert got == {k: j for j, k in enumerate(sorted(((s, i) for s, i, _ in rows), key=lambda k: (k[0] is not None, k[0] or "", k[1])))}


def test_encoders_do_not_mix(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "k int, chunk string")
    for dim in (32, 128):
        vecs = vectors.embed_chunks(df, factory=lambda d=dim: vectors.HashingEncoder(d)).collect()
        assert {len(r.vec) for r in vecs} == {dim}


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_embed_docs_keys_and_repeated_filings(spark, kind):
    df = spark.createDataFrame([(1, "a b.\nc", None), (2, " \n", "x"), (1, "a b.\nc", None)], "k int, t string, u string").withColumn("k", F.col("k").cast(kind))
    got = vectors.embed_docs(df, "k", {"t": "vt", "u": "vu"}).collect()
    assert sorted((str(r.k), r.vt is None, r.vu is None) for r in got) == [("1", False, True), ("1", False, True), ("2", True, False)]


def test_ties_are_broken_by_the_other_columns(spark):
    rows = [(1, 1, 5.0, "a"), (1, 1, None, "b"), (1, 1, 7.0, "c"), (1, 2, None, "d"), (1, 2, 9.0, "e")]
    seen = set()
    for n in (1, 2, 5):
        for order in (1, -1):
            df = spark.createDataFrame(rows[::order], "k int, y int, x double, z string").repartition(n)
            for segments in (None, 4):
                f = P.row_index(P.nearest_fill(df, "k", ["y"], "x", segments=segments), "k", ["y"], "nth", segments=segments)
                seen.add(tuple(sorted((r.z, r.x, r.nth) for r in f.collect())))
    assert len(seen) == 1


def test_stocks_of_accounts_with_duplicates(spark):
    """The same stocks in 1, 4 and 64 partitions, in both layouts, with one firm of most rows on one date."""
    one = V.panel(spark, SF001).where("gvkey < 40")
    big = one.where("gvkey = 4 and fyear = 1996").select(F.explode(F.sequence(F.lit(1), F.lit(300))).alias("i"), "*")
    more = big.withColumns({"xrd": F.when(F.col("i") % 3 == 0, F.col("i").cast("double")), "assets": F.when(F.col("i") % 2 == 0, F.col("sale"))}).drop("i")
    funda = one.unionByName(more).unionByName(one.where("gvkey % 2 = 0").withColumn("xsga", F.lit(None).cast("double")))
    seen = set()
    for n, segments in ((1, None), (4, 64), (64, 64)):
        out = I.intangible_stocks(funda.repartition(n), V.company(spark, SF001), V.founding(spark, SF001), pivot_year=V.PIVOT_YEAR, segments=segments)
        seen.add(tuple(sorted((r.gvkey, r.fyear, f"{r.kcap_v2:.6g}", f"{r.ocap_v2:.6g}") for r in out.collect())))
    assert len(seen) == 1 and len(seen.pop()) > 100


def test_incomplete_founding_rows_go_before_columns_do(spark, tmp_dir):
    path = _file(tmp_dir, "f.csv", b"crsp_perm,founding,cusip,offer_date\n1,1990,A,20000101\n2,1991,B,\n")
    whole = io.read_table(spark, path, schemas.FOUNDING, "csv")
    assert [r.cusip for r in I.clean_founding(whole).collect()] == ["A"]


def test_item_headings(spark):
    body = "x\nITEM 1. BUSINESS\nwe do item 1 things\n Item 1A: Risk Factors\nrisk\nItem 1B. None\nItem 7 - Management's view\nwell\nItem 7A. more\nItem 8. Fin"
    docs = spark.createDataFrame([("f", body), ("g", "Item 1. Business only")], "fname string, body string")
    linked = spark.createDataFrame([("f", 1), ("f", 2), ("g", 1), ("h", 3), (None, 1)], "fname string, gvkey int")
    ok, errors = text.filing_texts(linked, docs, min_chars=5)
    assert sorted((r.fname, r.gvkey, r.item1, r.item1a, r.item7) for r in ok.collect()) == [
        ("f", i, "\nwe do item 1 things", "\nrisk", "'s view\nwell") for i in (1, 2)]
    assert sorted(r.fname for r in errors.collect()) == ["g", "h"]


def test_security_links_cli_on_csv(spark, tmp_dir):
    history = _file(tmp_dir, "h.csv", b"LINKPRIM,LINKTYPE,gvkey,lpermno,lpermco,linkdt,linkenddt\nP,LU,1,10,5,19900101,\nC,LC,1,11,5,,20501231\nP,LD,1,12,6,19900101,\nN,LU,1,13,7,19900101,\n")
    accounts = _file(tmp_dir, "a.csv", b"datadate,fyear,gvkey,consol,popsrc,datafmt,indfmt\n20001231,2000,1,C,D,STD,INDL\n20001231,2000,1,C,D,STD,FS\n")
    cli.main(["security-links", "--history", history, "--accounts", accounts, "--out", f"{tmp_dir}/o"])
    assert [(r.permco, r.gvkey, r.permno, r.linktype) for r in spark.read.parquet(f"{tmp_dir}/o").collect()] == [(5, 1, 11, "LC")]


def test_monthly_common_shares_cli_on_csv(spark, tmp_dir):
    monthly = _file(tmp_dir, "m.csv", b"date,permno,permco,ret,shrout,altprc\n20000131,1,9,0.1,1,1\n20010131,1,9,0.2,1,1\n")
    history = _file(tmp_dir, "h.csv", b"permno,secinfostartdt,secinfoenddt,sharetype,securitytype,securitysubtype,usincflg,issuertype,primaryexch,conditionaltype,tradingstatusflg,siccd\n"
                                      b"1,20000101,20000131,NS,EQTY,COM,Y,CORP,N,RW,A,7\n1,20000201,20011231,AD,EQTY,COM,Y,CORP,N,RW,A,7\n")
    cli.main(["common-shares", "--monthly", monthly, "--history", history, "--out", f"{tmp_dir}/o"])
    assert [(r.permno, str(r.date), r.siccd) for r in spark.read.parquet(f"{tmp_dir}/o").collect()] == [(1, "2000-01-31", 7)]


def test_part_files_cli_on_text_order(spark, tmp_dir):
    spark.createDataFrame([(f"n{i:03}", i) for i in range(50)], "fname string, i int").repartition(4).write.parquet(f"{tmp_dir}/in")
    cli.main(["part-files", "--input", f"{tmp_dir}/in", "--order", "fname", "--rows", "20", "--out", f"{tmp_dir}/o"])
    assert {r.fname: r.chunk for r in spark.read.parquet(f"{tmp_dir}/o").collect()} == {f"n{i:03}": i // 20 for i in range(50)}


def test_a_cluster_must_name_the_checkpoint_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            if default is None and key == "spark.checkpoint.dir" and self.strict:
                raise KeyError(key)
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            c = Conf()
            c.strict = False
            return c

    class Session:
        sparkContext = Context()
        conf = Conf()

    Session.conf.strict = True
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(Session())


def test_scratch_is_deleted(spark):
    from panelspark.session import clear_scratch, scratch_path
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)

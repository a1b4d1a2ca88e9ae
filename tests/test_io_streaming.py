"""Sources, sinks and incremental (file-stream) processing."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators import text
from panelspark.sources import io
from panelspark.streaming import incremental

from .conftest import SF001


def test_csv_round_trip_and_bad_bytes(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    io.write_table(df, f"{tmp_dir}/csv", fmt="csv")
    back = io.read_table(spark, f"{tmp_dir}/csv", "id int, name string", fmt="csv")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a"), (2, "b")]
    p = f"{tmp_dir}/bad.csv"
    with open(p, "wb") as fh:
        fh.write(b"id,name\n1,caf\xe9\n2,ok\n")
    got = io.read_table(spark, p, "id int, name string", fmt="csv").orderBy("id").collect()
    assert got[0].name == "caf�" and got[1].name == "ok"   # bad byte replaced, row kept


def test_parquet_zstd_and_parts(spark, tmp_dir):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    io.write_table(df.repartition(3), f"{tmp_dir}/pq", compression="zstd")
    assert any(f.endswith(".zstd.parquet") for f in os.listdir(f"{tmp_dir}/pq"))
    parts = io.read_parts(spark, f"{tmp_dir}/pq")
    assert parts.select("file_name").distinct().count() == 3
    assert parts.count() == 100


def test_row_chunks_stable(spark, tmp_dir):
    df = spark.range(5000).withColumnRenamed("id", "k").repartition(7)
    got = {r.k: r.chunk for r in io.row_chunks(df, ["k"], 1516).collect()}
    assert all(got[k] == k // 1516 for k in range(5000))
    io.write_row_chunks(df, f"{tmp_dir}/chunks", ["k"], 1516)
    assert sorted(d for d in os.listdir(f"{tmp_dir}/chunks") if d.startswith("chunk=")) == \
        ["chunk=0", "chunk=1", "chunk=2", "chunk=3"]
    back = spark.read.parquet(f"{tmp_dir}/chunks")
    assert back.groupBy("chunk").count().orderBy("chunk").collect()[0]["count"] == 1516


def test_dead_letter_split(spark, tmp_dir):
    df = spark.createDataFrame([(1, True), (2, False)], "id int, ok boolean")
    io.write_split(df, "ok", f"{tmp_dir}/good", f"{tmp_dir}/bad")
    assert [r.id for r in spark.read.parquet(f"{tmp_dir}/good").collect()] == [1]
    assert [r.id for r in spark.read.parquet(f"{tmp_dir}/bad").collect()] == [2]


def test_require_and_drop_matching(spark):
    df = spark.createDataFrame([(1, 2)], "a int, `Unnamed: 0` int")
    assert io.drop_matching(df, "^Unnamed").columns == ["a"]
    try:
        io.require_columns(df, ["a", "b"])
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                       T.StructField("html", T.StringType())])
PATTERNS = {"h1": r"(?s)<h1>(.*?)</h1>", "article": r"(?s)<article>(.*?)</article>"}


def test_incremental_sections_no_repeats(spark, tmp_dir):
    pages = spark.read.parquet(f"{SF001}/pages.parquet").select("page_id", "url", "html")
    first, second = pages.where("page_id < 100"), pages.where("page_id >= 100")
    first.write.mode("append").parquet(f"{tmp_dir}/in")
    args = ("page_id", "html", PATTERNS, f"{tmp_dir}/ok", f"{tmp_dir}/err", f"{tmp_dir}/ckpt")
    incremental.incremental_sections(spark, f"{tmp_dir}/in", SCHEMA, *args, require='<html lang="en"')
    n1 = spark.read.parquet(f"{tmp_dir}/ok").count() + spark.read.parquet(f"{tmp_dir}/err").count()
    assert n1 == first.count()
    # rerun with nothing new: no batch, nothing repeated
    incremental.incremental_sections(spark, f"{tmp_dir}/in", SCHEMA, *args, require='<html lang="en"')
    second.write.mode("append").parquet(f"{tmp_dir}/in")
    incremental.incremental_sections(spark, f"{tmp_dir}/in", SCHEMA, *args, require='<html lang="en"')
    ok = spark.read.parquet(f"{tmp_dir}/ok").drop("batch")
    err = spark.read.parquet(f"{tmp_dir}/err").drop("batch")
    assert ok.count() + err.count() == pages.count()
    assert ok.select("page_id").distinct().count() == ok.count()
    # stream equals batch
    b_ok, b_err = text.extract_sections(pages, "page_id", "html", PATTERNS, require='<html lang="en"')
    assert sorted(tuple(r) for r in ok.select("page_id", "h1", "article").collect()) == \
        sorted(tuple(r) for r in b_ok.select("page_id", "h1", "article").collect())
    assert sorted(r.page_id for r in err.collect()) == sorted(r.page_id for r in b_err.collect())


def test_incremental_map_and_unprocessed(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_dir}/docs")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    incremental.incremental_map(spark, f"{tmp_dir}/docs", schema,
                                lambda b: text.chunk_docs(b, "doc_id", "text"), f"{tmp_dir}/chunks",
                                f"{tmp_dir}/ckpt")
    out = spark.read.parquet(f"{tmp_dir}/chunks").drop("batch")
    assert out.count() == text.chunk_docs(docs, "doc_id", "text").count()
    done = out.select("doc_id").distinct()
    assert incremental.unprocessed(docs, done, "doc_id").count() == docs.where(F.length("text") == 0).count()


def test_founding_sheet_and_file_order(spark, tmp_dir):
    p = f"{tmp_dir}/founding.csv"
    with open(p, "w") as fh:
        fh.write("CUSIP,offer date,Founding,Unused\n12345678,19990101,1980,x\n87654321,20010101,-99,y\n")
    f = io.read_founding(spark, p)
    assert f.columns == ["cusip", "offer_date", "founding"]
    assert [r.founding for r in f.orderBy("cusip").collect()] == [1980, -99]
    import time
    for i in range(2):
        spark.range(3).write.mode("append").parquet(f"{tmp_dir}/parts")
        time.sleep(1.1)
    parts = io.read_parts(spark, f"{tmp_dir}/parts")
    names = [r.file_name for r in parts.groupBy("file_name").agg(F.min("file_mtime").alias("t")).orderBy("t").collect()]
    assert len(names) >= 2   # oldest first (O3)


def test_url_and_capture(spark):
    from panelspark.functions import columns as C
    df = spark.createDataFrame([("edgar/data/1/0001.txt", "raw/items1_a_7/chunk3.parquet")], "p string, f string")
    r = df.select(C.filing_url("p").alias("u"), C.capture("f", r"items1_a_7/(.*)").alias("n")).first()
    assert r.u == "https://www.sec.gov/Archives/edgar/data/1/0001.txt" and r.n == "chunk3.parquet"

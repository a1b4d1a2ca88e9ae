"""Exact dedup against dictionaries of whole texts."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelspark.llm import exact_dedup as X

ODD = [(1, "Aa"), (2, "aA"), (3, "ÄA"), (4, "äA"), (5, None), (6, ""), (7, "aa "), (None, "aa"), (None, "only null"), (None, "only null"),
       (8, "İ"), (9, "i̇"), (3, "ÄA"), (3, "same id, other text"), (20, "x" * 200_000), (21, "X" * 200_000), (22, "x" * 199_999 + "y"), (23, "a\nb"), (24, "A\nB")]


def brute(rows, keep):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), text or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        one = True
        for i in ids:
            out.append((i, best, len(ids), i == best and one))
            one = one and i != best
    return sorted(map(str, out))


def got(df):
    return sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in df.collect())


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_odd_rows(spark, keep):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    for c in ("id", "hash", "head", "split", "nth", "norm", "row", "size", "best", "kept", "text_sha256"):
        docs = docs.withColumn(c, F.lit(1))
    assert got(X.copies(docs, keep=keep)) == brute(ODD, keep)
    assert X.copies(docs.limit(0), keep=keep).count() == 0
    stay = X.keep_one(docs, keep=keep)
    assert stay.columns == docs.columns and stay.count() == len({re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in ODD})
    assert X.keep_one(docs.limit(0)).count() == 0


def test_hot_text_is_split_and_meets_again(spark):
    # a third of all rows hold one text; each split of it goes to a range of its own
    rows = [(i, "the same text" if i % 3 else f"text {i // 6}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    hot = {r.hash: r.splits for r in X.hot_hashes(docs.select(F.xxhash64("text").alias("hash")), 8).collect()}
    assert len(hot) == 1 and min(hot.values()) > 4
    assert got(X.copies(docs, keep="largest")) == brute(rows, "largest")


def test_no_decision_rests_on_the_hash(spark, monkeypatch):
    # with one hash for all texts, whole texts alone tell them apart, hot or not
    monkeypatch.setattr(X.F, "xxhash64", lambda *c: F.length(F.lit("")).cast("long") if c[0] is not None and str(c[0]) != "nth" else F.hash("nth").cast("long"))
    rows = [(i, f"prefix common to all of the texts {i % 40}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(X.copies(docs, keep="smallest")) == brute(rows, "smallest")


def test_wrong_choice():
    with pytest.raises(ValueError):
        X.copies(None, keep="first")


def test_no_python_in_the_plan(spark, capsys):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    X.copies(docs.select("doc_id", F.col("text"))).explain()
    assert not re.search("Pandas|Arrow|BatchEvalPython", capsys.readouterr().out)

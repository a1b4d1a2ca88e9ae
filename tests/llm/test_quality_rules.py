"""Quality rules against a brute-force count."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import quality_rules as Q

from ..conftest import SF001

ODD = [None, "", " \n\t", "a", "a a a a", "\n\n a\na\n a\n", "é é é é é # <>", "x\x0by\x0cz\rq", "l\nl\nl", "😀 😀 😀 😀 😀 😀", "w" * 300_000, "ab " * 50_000]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    seen, out["n_lines"], out["n_dup_lines"], out["dup_line_chars"] = set(), 0, 0, 0
    for line in text.split("\n"):
        if own := re.findall(r"[^\x20\x09-\x0D]+", line):
            out["n_lines"] += 1
            if line in seen:
                out["n_dup_lines"] += 1
                out["dup_line_chars"] += sum(map(len, own))
            seen.add(line)
    for n in (3, 5, 6, 7, 8, 9, 10):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        often, covered = Counter(grams), [False] * len(words)
        for i, g in enumerate(grams):
            if often[g] > 1:
                covered[i:i + n] = [True] * n
        out["n_repeat_words" if n == 3 else f"dup_chars_{n}"] = sum(covered) if n == 3 else sum(len(w) for w, c in zip(words, covered) if c)
    out["base_failed"] = out["n_words"] < 50 or 100 * out["n_repeat_words"] > 50 * out["n_words"]
    return out


def test_counts_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").select("text").collect()] + ODD
    got = Q.measure(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        want = brute(text)
        assert {k: got[k][i] for k in want} == want


def test_query_rows_and_pass_through(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(None, "a b", None, None), (3, "a", "y", 1), (3, "a", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    out = Q.quality_signals(docs).collect()
    assert Counter((r.doc_id, r.n_words) for r in out) == Counter((r[0], brute(r[1])["n_words"]) for r in rows)
    good = " ".join(f"word{i}" for i in range(80))
    more = docs.union(spark.createDataFrame([(50, good, "z", 2), (50, good, "z", 2)], docs.schema))
    assert [tuple(r) for r in Q.keep_good(more).collect()] == [(50, good, "z", 2)] * 2
    assert Q.keep_good(docs.limit(0)).count() == 0 and Q.quality_signals(docs.limit(0)).count() == 0


def test_labels(spark):
    """No junk is kept, and good documents are rejected by the base rule almost only."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    r = Q.quality_signals(docs).join(labels, "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept"), F.avg((~F.col("kept") & ~F.col("base_failed")).cast("int")).alias("lost")).collect()
    by = {x.quality: x for x in r}
    assert by[0].kept == pytest.approx(0, abs=0.01) and by[1].lost < 0.02

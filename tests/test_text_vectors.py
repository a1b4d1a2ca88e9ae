"""Text and vector operators: hand cases and a brute-force check of the embedding job."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import text, vectors
from panelspark.plans import testviews as V

from .conftest import SF001


def test_chunk_case(spark):
    df = spark.createDataFrame([(1, "a  b\n\n \nc")], "id long, t string")
    got = [(r.chunk, r.n_chars) for r in text.chunk_docs(df, "id", "t").orderBy("chunk_no").collect()]
    assert got == [("a b", 3), ("c", 1)]


def test_chunk_long_paragraph_splits_sentences(spark):
    para = " ".join(["Sentence number %d is here." % i for i in range(120)])
    assert len(para) > text.CHUNK_CAP
    df = spark.createDataFrame([(1, "short one\n" + para)], "id long, t string")
    chunks = [r.chunk for r in text.chunk_docs(df, "id", "t").orderBy("chunk_no").collect()]
    assert chunks[0] == "short one" and len(chunks) == 121
    assert chunks[1] == "Sentence number 0 is here." and chunks[-1] == "Sentence number 119 is here."


def test_chunk_unicode_whitespace(spark):
    df = spark.createDataFrame([(1, "x  y\n　\t")], "id long, t string")
    got = [r.chunk for r in text.chunk_docs(df, "id", "t").collect()]
    assert got == ["x y"]


def test_empty_text_skipped(spark):
    df = spark.createDataFrame([(1, ""), (2, "z")], "id long, t string")
    assert [r.id for r in text.chunk_docs(df, "id", "t").collect()] == [2]


@pytest.mark.parametrize("flags,expected", [
    ((0, 0, 0), "ABC"), ((0, 0, 1), "AB"), ((0, 1, 0), "AC"), ((0, 1, 1), "A"), ((1, 1, 1), "ABC"), ((1, 0, 1), "ABC"),
])
def test_concat_table(spark, flags, expected):
    df = spark.createDataFrame([("A", "B", "C") + flags], "item1 string, item1a string, item7 string, "
                               "item1_na int, item1a_na int, item7_na int")
    assert text.concat_sections(df).first().text == expected


def test_flags_threshold(spark):
    df = spark.createDataFrame([("x" * 9999, "x" * 10000, "")], "item1 string, item1a string, item7 string")
    r = text.text_flags(df).first()
    assert (r.item1_na, r.item1a_na, r.item7_na) == (1, 0, 1)


def test_extract_sections_split(spark):
    df = spark.createDataFrame([(1, '<html lang="en"><h1>T</h1><nav>N</nav><article>A</article>'),
                                (2, '<html lang="fr"><h1>T</h1><nav>N</nav><article>A</article>'),
                                (3, '<html lang="en"><h1>T</h1><article>A</article>')], "id long, html string")
    ok, err = text.extract_sections(df, "id", "html", {"h1": "(?s)<h1>(.*?)</h1>", "nav": "(?s)<nav>(.*?)</nav>"},
                                    require='<html lang="en"')
    assert [(r.id, r.h1, r.nav) for r in ok.collect()] == [(1, "T", "N")]
    assert sorted(r.id for r in err.collect()) == [2, 3]


def test_pool_cases(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1.0)] * 3 + [(1, [0.0, 1.0], 1.0), (2, [0.0, 0.0], 1.0)],
                               "k long, v array<double>, w double")
    got = {r.k: r.vec for r in vectors.pool_vectors(df, "k", "v", "w").collect()}
    assert np.allclose(got[1], [0.948683, 0.316228], atol=1e-6)
    assert got[2] is None  # zero vector -> null, not a division by zero


def _py_chunks(t, cap=text.CHUNK_CAP):
    out = []
    for seg in t.split("\n"):
        seg = re.sub(r"\s{2,}", " ", seg)
        out += re.split(r"(?<=[.!?])\s+", seg) if len(seg) > cap else [seg]
    return [c for c in out if re.search(r"\S", c)]


def test_embed_docs_matches_brute_force(spark):
    ft = text.concat_sections(text.text_flags(V.filing_text(spark, SF001))).select("fname", "text", "item1")
    got = {r.fname: (r.embfull, r.emb1) for r in
           vectors.embed_docs(ft, "fname", {"text": "embfull", "item1": "emb1"}).collect()}
    enc = vectors.HashingEncoder()
    rows = ft.collect()
    assert len(got) == len(rows)
    for r in rows:
        for col, idx in (("text", 0), ("item1", 1)):
            ch = _py_chunks(r[col])
            if not ch:
                assert got[r.fname][idx] is None
                continue
            v = enc.encode(ch).astype(np.float32).astype(np.float64)
            w = np.array([len(c) for c in ch], dtype=np.float64)
            m = (v * w[:, None]).sum(0) / w.sum()
            nrm = np.linalg.norm(m)
            exp = None if nrm == 0 else m / nrm
            g = got[r.fname][idx]
            assert (g is None and exp is None) or np.allclose(g, exp, atol=1e-9)


def test_cosine_to_pooled_one_partner(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [2.0, 2.0])],
                               "id long, k long, v array<double>")
    got = {r.id: r.cosine for r in vectors.cosine_to_pooled(df, "k", "v").collect()}
    assert abs(got[1] - math.sqrt(0.5)) < 1e-12 and abs(got[3] - 1.0) < 1e-12


def test_clean_sections(spark):
    df = spark.createDataFrame([("l1", "x" * 10000, "y", "z" * 10000)], "link string, item1 string, item1a string, item7 string")
    r = text.clean_sections(df).first()
    assert r.fname == "l1" and (r.item1_na, r.item1a_na, r.item7_na) == (0, 1, 0)
    assert r.text == "x" * 10000 + "z" * 10000

"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import spelling as P

from ..conftest import SF001


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def count(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute(rows):
    words = count(rows)
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(map(str, out))


def got(docs):
    return sorted(str(tuple(r)) for r in P.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(60)  # all pairs of words are compared here
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_edits_and_odd_rows(spark):
    rng = random.Random(5)
    base = ["abcdefg", "aaaaaa", "élégantß", "ÀÿÉabc", "banana", "nabana", "z" * 30, "x" * 90]
    rows, n = [], 0
    for w in base:  # chains of ever more frequent words, one edit apart
        for k in range(7):
            rows += [(n + j, f"{w} 12,{w}-") for j in range(2 * 3 ** min(k, 3))]
            n += 1000
            p = rng.randrange(len(w))
            w = rng.choice([w[:p] + w[p + 1:] if len(w) > 6 else w + "q", w[:p] + rng.choice("abé") + w[p:], w[:p] + "r" + w[p + 1:]])
    rows += [(None, "nulls nulls nulls"), (7, None), (8, ""), (8, "again again again"), (8, "again again again"), (9, "über" * 20_000 + " " + "y" * 100_000), (10, "STRASSE Straße strasse")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for c in ("id", "word", "n", "key", "form", "near"):
        docs = docs.withColumn(c, F.lit(1))
    assert got(docs) == brute(rows)
    assert P.spelling_variants(docs.limit(0)).count() == 0
    assert P.spelling_variants(docs.filter("doc_id = 7")).count() == 0


def test_anagrams_and_all_near_words(spark):
    # all words over two letters: every multiset is shared by many words
    words = [format(i, "07b").translate({48: "a", 49: "b"}) for i in range(128)] + [format(i, "06b").translate({48: "a", 49: "b"}) for i in range(64)]
    table = spark.createDataFrame([(w, 3 + i) for i, w in enumerate(words)], "word string, n long")
    pairs = {(r.word, r.near) for r in P.near_words(table).collect()}
    assert pairs == {(a, b) for a in words for b in words if one_apart(a, b)}


@pytest.mark.parametrize("window", [1, 7, 64, 1 << 22])
def test_windows_cut_no_run(monkeypatch, window):
    monkeypatch.setattr(P, "WINDOW", window)
    monkeypatch.setattr(P, "LONG_RUN", 9)
    rows = [(1, "Hello hello HELLO wörld"), (2, "world" * 30 + " hello"), (3, None), (4, "hello"), (5, "hello"), (-6, "ÿÿÿÿÿÿ×÷ß"), (7, "中文hello中é")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["id", "text"])
    total = Counter()
    for out in P.word_counts(iter([batch])):
        for w, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            total[w] += n
    want = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            word = run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run
            if len(word) >= 5:
                want[word] += 1
    assert total == want


def test_crc_of_runs():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = np.arange(0, 4800, 100)
    end = start + rng.integers(1, 99, len(start))
    state = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(start))], dtype=np.uint32)
    want = [zlib.crc32(f"{i}:".encode() + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(start, end))]
    assert P.run_crc(data, start, end, state).tolist() == want


def test_no_join_passes_through_the_driver(spark, monkeypatch, capsys):
    """Files and rows made from them are larger than the planner thinks: nothing may be broadcast for its small size."""
    frames, written = [], P.written
    monkeypatch.setattr(P, "written", lambda df, *a, **k: frames.append(df) or written(df, *a, **k))
    docs = spark.createDataFrame([(i, "alphabet alphabets " + "alphabetic " * (1 + i % 2)) for i in range(9)], "doc_id long, text string")
    frames.append(P.spelling_variants(docs))
    for df in frames:
        df.explain()
    plans = capsys.readouterr().out
    assert plans.count("SortMergeJoin") >= 4 and "Broadcast" not in plans

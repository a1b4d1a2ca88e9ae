"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
import re

import pytest

from panelspark.llm import substring_dedup as D

from ..conftest import SF001


def brute(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            window = tuple(words[p:p + length])
            if window in seen:
                gone[p:p + length] = [True] * length
            seen.add(window)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def periodic(rng):
    rows = []
    for i in range(120):
        text = " ".join(rng.choice("ab") if rng.random() < 0.5 else rng.choice("xyz") for _ in range(rng.randint(0, 120)))
        rows.append((i, text + (" a b" * rng.randint(0, 40) if rng.random() < 0.5 else "")))
    for i in range(60):
        own = rng.choice(rows)[1].split()
        at = rng.randint(0, len(own))
        rows.append((200 + i, " ".join(rng.choice(rows)[1].split()[:rng.randint(0, 60)] + own[at:])))
    return rows


@pytest.mark.parametrize("length, seed", [(20, 8), (5, 2), (3, 1), (6, 6)])
def test_periodic_texts(spark, length, seed):
    rows = periodic(random.Random(length))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in D.remove_repeats(docs, length, seed).collect()}
    assert got == brute(rows, length)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "é😀 " * 30), (-4, "q " * 60_000), (10**6, "é😀 " * 30 + rows[3][1])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, place string").repartition(5)
    got = {r.doc_id: r for r in D.remove_repeats(docs, digest=True).collect()}
    want = brute(rows, 20)
    assert {i: (r.n_words, r.n_removed, r.kept) for i, r in got.items()} == {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, (n, g, k) in want.items()}
    assert all(sum(s.end - s.first for s in r.spans) == r.n_removed for r in got.values())


def test_string_ids(spark):
    rows = [(f"d{i:03}", t) for i, t in periodic(random.Random(9))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in D.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"), 6, 3).collect()}
    assert got == brute(rows, 6)


def test_repeated_rows_and_odd_ids(spark):
    same = "a b " * 15
    rows = [(3, same), (4, same), (None, same), (4, same), (4, "z b " * 15)]
    got = sorted((str(r.doc_id), r.n_removed) for r in D.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("3", 28), ("4", 28), ("4", 30), ("4", 30), ("None", 0)]
    alone = spark.createDataFrame([(1, same), (1, same)], "doc_id long, text string")
    assert [r.n_removed for r in D.remove_repeats(alone).collect()] == [28, 28]
    assert D.remove_repeats(alone.limit(0)).count() == 0


def test_phrase_with_other_neighbours_everywhere(spark, monkeypatch):
    """A hot anchor is dealt out by its stretches, whatever the chunks that tasks merge, and nothing else changes."""
    rng = random.Random(4)
    phrase = " ".join(f"p{i}" for i in range(8))
    rows = [(i, " ".join([*(f"w{rng.randint(0, 10**6)}" for _ in range(15)), phrase, *(f"v{rng.randint(0, 2)}" for _ in range(15))])) for i in range(400)]
    rows += [(i + 1000, t) for i, t in rows[::9]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    narrow = docs.selectExpr("doc_id as id", "0 as version", "text")
    assert 0 < D.hot_anchors(narrow, 20, 8, 64).count() <= 64
    for chunk in (100, 1 << 21):
        monkeypatch.setattr(D, "CHUNK", chunk)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in D.remove_repeats(docs).collect()} == brute(rows, 20)

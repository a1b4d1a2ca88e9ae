"""Packing against item-by-item best fit, and its ids against the tokenizers library."""

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelspark.llm import packing as P

from ..conftest import SF001

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = P.Encoder(open(PATH, encoding="utf-8").read())
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True


def bins_of(items, capacity):
    free, n = [], 0
    for size in sorted(items, reverse=True):
        i = bisect.bisect_left(free, size)
        if i == len(free):
            n += 1
            left = capacity - size
        else:
            left = free.pop(i) - size
        bisect.insort(free, left)
    return n


def test_best_fit():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([1, 2, 7, 16, 64, 100])
        items = [rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(rng.randint(0, 300))]
        fills, n = P.best_fit(Counter(items), capacity)
        assert n == bins_of(items, capacity)
        placed = {}
        for length, first, last, each, start, offset in fills:
            for rank in range(first, last):
                placed.setdefault(start + (rank - first) // each, []).append((offset + (rank - first) % each * length, length))
        assert len(placed) == n and Counter(x for b in placed.values() for _, x in b) == Counter(items)
        for own in placed.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sdmrelv<|endoftext|>")), max_size=60))
def test_ids_are_the_tokenizers_librarys(text):
    assert ENCODER.ids(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_long_runs():
    for text in ("a" * 200_000, " " * 2_000_000 + "x", " \n" * 60_000):
        assert ENCODER.ids(text).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_round_trip(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "x " * 9000)], "doc_id long, text string")
    docs = docs.union(odd)
    rows = P.pack(docs, PATH, with_ids=True).toPandas()
    sequences = {r.sequence_id: r.ids for r in P.sequences(P.pack(docs, PATH, with_ids=True)).collect()}
    assert all(len(x) <= 2048 for x in sequences.values())
    full = {r.doc_id: PLAIN.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    assert set(rows.doc_id) == set(full)
    for doc, own in rows.sort_values("piece").groupby("doc_id"):
        assert np.concatenate(list(own.ids)).tolist() == full[doc]
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == np.cumsum([0, *own.length[:-1]]).tolist()
        assert all(own.length[1:] == 2048) and own.length.max() <= 2048
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in own.ids] == own.ids_crc32.tolist()
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.cumsum([0, *own.length[:-1]]).tolist()
    assert rows.sequence_id.nunique() == bins_of(rows.length.tolist(), 2048)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, "b", 6)], "doc_id long, text string, length int")
    rows = P.pack(docs, PATH, capacity=4).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"] and len({r.sequence_id for r in rows}) == 2
    assert P.pack(docs.limit(0), PATH).count() == 0

"""Benchmark decontamination: SimHash of item-sized windows, verified by weighted shingle similarity.

For a benchmark item of n words, every window of n consecutive words of a document is a candidate
(a shorter document is one window). Words are lower case without ASCII punctuation. Window and
item are multisets of five-word shingles; they match at a weighted Jaccard similarity of 0.8 or more.

Windows that can't match are left out before any fingerprint is made, which loses nothing: a match
shares at least 0.8 of the item's shingles, so a document must hold that many of them, and the window one.
For the windows left, 64-bit SimHashes come from running sums of the shingles' bits. The items'
SimHashes are cut into RADIUS + 1 blocks with a table for each; two fingerprints within the radius
agree on a block at least, so the tables give every item within the radius. At similarity 0.8 the
expected distance is under 10 bits with a standard deviation under 3; the radius is 23. Every
candidate is then verified on the multisets themselves.

The benchmark is the stated query set. It meets the documents in blocks of at most BLOCK_BYTES of
text, each broadcast; documents are read once a block and never shuffled.

Defined cases: null text is empty and matches nothing; an item or document of fewer words than a
shingle is one shingle, so such an item is found only where it is a whole document; repeated
rows are judged one by one; repeated benchmark rows count once; an empty benchmark matches nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import by_value, text_batches
from .words import PLAIN, Words, gram_starts, grams, steps

SHINGLE, SIMILARITY = 5, 80
BITS, RADIUS = 64, 23
#: Most bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 8 << 20
_SIEVE = 20  # bits of the bitmap that most shingles fail


class HammingIndex:
    """All stored fingerprints within ``radius`` of a query, by radius + 1 blocks of bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius, self.blocks = prints, radius, []
        cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
        for low, high in zip(cuts, cuts[1:]):
            shift, mask = np.uint64(low), np.uint64((1 << (high - low)) - 1)
            key = (prints >> shift) & mask
            order = np.argsort(key, kind="stable")
            self.blocks.append((shift, mask, key[order], order))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, stored) number of every pair within the radius, each once."""
        found = []
        for shift, mask, keys, order in self.blocks:
            q = (queries >> shift) & mask
            a, b = np.searchsorted(keys, q, "left"), np.searchsorted(keys, q, "right")
            n = b - a
            left = np.repeat(np.arange(len(q)), n)
            right = order[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            ok = np.bitwise_count(queries[left] ^ self.prints[right]) <= self.radius
            found.append(left[ok] * np.int64(len(self.prints)) + right[ok])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)


def simhash(shingles: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of ``size`` consecutive shingles from each start: the majority of each bit."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(shingles) + 1, BITS), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    major = 2 * (sums[start + size] - sums[start]) > size
    return np.packbits(major, axis=1).view("<u8").ravel()


def _short(w: Words, i: int) -> bytes:
    return b" ".join(w.data[w.bounds[i]:w.bounds[i + 1]].tobytes().split())


class Benchmark:
    """The items of one block, ready to be met by documents."""

    def __init__(self, texts: list[str | None]):
        w = Words(pa.array([t.lower() if t else "" for t in texts], pa.string()), PLAIN)
        g = grams(w.hash, SHINGLE)
        self.short: dict[bytes, list[int]] = {}
        self.items: dict[int, tuple[int, Counter]] = {}  # words, shingles
        prints: dict[int, list[tuple[int, np.uint64]]] = {}
        for i, n in enumerate(w.count.tolist()):
            if 0 < n < SHINGLE:
                self.short.setdefault(_short(w, i), []).append(i)
            elif n:
                own = g[w.ptr[i]:w.ptr[i] + n - SHINGLE + 1]
                self.items[i] = (n, Counter(own.tolist()))
                prints.setdefault(n, []).append((i, simhash(own, np.zeros(1, np.int64), len(own))[0]))
        self.index = {n: (np.array([i for i, _ in x]), HammingIndex(np.array([p for _, p in x], dtype=np.uint64))) for n, x in prints.items()}
        pairs = sorted((s, i) for i, (_, c) in self.items.items() for s in c)
        self.known, first = np.unique(np.array([s for s, _ in pairs], dtype=np.uint64), return_index=True)
        self.first = np.append(first, len(pairs))
        self.owner = np.array([i for _, i in pairs], dtype=np.int64)
        self.sieve = np.zeros(1 << _SIEVE, dtype=bool)
        self.sieve[(self.known >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, first word, words, shared shingles, union) of each match, by its best and first window."""
        w = Words(texts, PLAIN)
        out = []
        if self.short:
            for i in np.flatnonzero((w.count > 0) & (w.count < SHINGLE)).tolist():
                out += [(i, item, 0, int(w.count[i]), 1, 1) for item in self.short.get(_short(w, i), ())]
        g = grams(w.hash, SHINGLE)
        at = np.flatnonzero(self.sieve[(g >> np.uint64(64 - _SIEVE)).astype(np.int64)] & gram_starts(w.ptr, SHINGLE, len(w.hash)))
        if not len(at) or not len(self.known):
            return out
        place = np.minimum(np.searchsorted(self.known, g[at]), len(self.known) - 1)
        hit = self.known[place] == g[at]
        at, place = at[hit], place[hit]
        n = self.first[place + 1] - self.first[place]
        owner = self.owner[np.repeat(self.first[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at = np.repeat(at, n)
        order = np.lexsort((at, owner, w.doc[at]))
        at, owner = at[order], owner[order]
        doc = w.doc[at]
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1])])) if len(at) else np.zeros(0, np.int64)
        todo: dict[tuple[int, int], dict[int, np.ndarray]] = {}  # (text, item length) -> item -> places of its shingles
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
            words, shingles = self.items[int(owner[a])]
            if 100 * (b - a) >= SIMILARITY * shingles.total():
                todo.setdefault((int(doc[a]), words), {})[int(owner[a])] = at[a:b]
        for (i, words), places in todo.items():
            begin, count = int(w.ptr[i]), int(w.count[i])
            size = min(words, count) - SHINGLE + 1
            own = g[begin:begin + count - SHINGLE + 1]
            may = np.zeros(count - SHINGLE + 2, dtype=np.int64)  # window starts with one of the shingles
            for x in places.values():
                np.add.at(may, np.maximum(x - begin - size + 1, 0), 1)
                np.add.at(may, x - begin + 1, -1)
            start = np.flatnonzero(np.cumsum(may)[:len(own) - size + 1] > 0)
            numbers, index = self.index[words]
            lo = int(start[0])
            q, k = index.near(simhash(own[lo:int(start[-1]) + size], start - lo, size))
            best: dict[int, tuple[int, int, int]] = {}
            for s, item in zip(start[q].tolist(), numbers[k].tolist()):
                if item in places:
                    shingles = self.items[item][1]
                    here = Counter(own[s:s + size].tolist())
                    shared = sum(min(c, shingles[x]) for x, c in here.items() if x in shingles)
                    union = size + shingles.total() - shared
                    if 100 * shared >= SIMILARITY * union:
                        best[item] = max(best.get(item, (0, 0, 0)), (shared, -s, union))
            out += [(i, item, -s, min(words, count), shared, union) for item, (shared, s, union) in best.items()]
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, "Benchmark"]]:
    rows = benchmark.select(benchmark[id_col].alias("id"), benchmark[text_col].alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // (BLOCK_BYTES // 2)) + 1
    for k in range(blocks):
        got = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
        if got:
            yield [r["id"] for r in got], Benchmark([r["text"] for r in got])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that match: both ids, first_word, n_words, shared, of (size of the union)."""
    spark = docs.sparkSession
    text_batches(spark)
    narrow = docs.select(docs[id_col].alias("id"), F.lower(docs[text_col]).alias("text"))
    kinds = dict(narrow.dtypes)["id"], dict(benchmark.dtypes)[item_col]
    schema = f"id {kinds[0]}, item {kinds[1]}, first_word int, n_words int, shared int, of int"
    found = spark.createDataFrame([], schema)
    item_type = None
    for ids, block in _blocks(benchmark, item_col, item_text):
        shared = by_value(spark, (ids, block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, block = shared()
            items = pa.array(ids)
            for batch in batches:
                for part in steps(batch, "text"):
                    got = block.matches(part.column(1))
                    if got:
                        doc, item, *rest = zip(*got)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), items.take(pa.array(item)), *(pa.array(c, pa.int32()) for c in rest)],
                                                         names=["id", "item", "first_word", "n_words", "shared", "of"])

        found = found.unionByName(narrow.mapInArrow(run, schema))
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that match no item, with all their columns."""
    spark = docs.sparkSession
    text_batches(spark)
    for _, block in _blocks(benchmark, item_col, item_text):
        shared = by_value(spark, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, text_col):
                    text = part.column(part.schema.get_field_index(text_col)).to_pylist()
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[[m[0] for m in shared().matches(pa.array([t.lower() if t else "" for t in text], pa.string()))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

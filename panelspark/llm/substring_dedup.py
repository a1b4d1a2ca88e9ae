"""Removal of word passages that occur earlier in the corpus: seed and extend.

A window is ``length`` consecutive words of one document. It is removed where the same words
also start earlier: in a document with a smaller id, or earlier in the same one.

Seed. Winnowing: the anchor of a window is the rightmost smallest of the hashes of its
``seed``-word grams, so equal windows have equal anchors at the same place, and consecutive
windows mostly share one. A row is made per anchor, not per word.

Extend. Around an anchor, the windows that have it form a run; the words of the run are extended
left and right to its whole stretch and compared by one hash. Of equal stretches under one anchor
all but the earliest are repeats, window by window. Where the stretches under one anchor differ,
the earliest of each is extended word by word: its windows are compared one by one, by 128-bit
hashes, and all but the earliest of equal windows are repeats. The earliest place of a
window is always in the earliest of its equal stretches, so this finds exactly the windows that a
comparison of all windows finds. Maximal repeats are the unions of overlapping repeated windows.

Volume: about two anchors in ``length - seed + 2`` words go through one shuffle; each task first
keeps one row of each of its own equal stretches, so a passage that a third of all documents share
costs a row in CHUNK. A short phrase with other neighbours in each document isn't merged so: anchors with a large
share of all rows are found by a first pass, and their stretches dealt out to all tasks. The texts are shuffled once to meet their repeats and written in buckets of their
ids, so what is found in their windows meets them without another shuffle.

Defined cases: null or empty text has no words; texts shorter than a window keep all words;
repeated rows (same id and text) are one document and get the same result; rows that share an id
but not the text are ordered by a hash of the text; rows without id keep all words and are no
earlier place for others; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import bucketed, text_batches, written
from .words import _BASE, _POWERS, Words, gram_starts, grams, mix, steps

#: Words of a window, and of the grams that anchors are chosen from.
LENGTH, SEED = 20, 8
#: Runs that a task merges at once.
CHUNK = 1 << 21
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_PLACE = (1 << 32) - 1  # a place is the text's version in the high and the word number in the low 32 bits


def last_smallest(values: np.ndarray, size: int) -> np.ndarray:
    """Position of the rightmost smallest of each ``size`` consecutive values, by doubling."""
    at, val, have = np.arange(len(values)), values, 1
    while have < size:
        shift = min(have, size - have)
        left, right = val[:-shift], val[shift:]
        take = right <= left
        val, at = np.where(take, right, left), np.where(take, at[shift:], at[:-shift])
        have += shift
    return at


class Stretches:
    """Hashes of any stretch of a batch's words in constant time."""

    def __init__(self, h: np.ndarray):
        self.up, self.down = _POWERS.to(len(h) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[:len(h)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(_BASE))


def runs(w: Words, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, stretch hash, text, first window, number of windows) of each run of windows with one anchor."""
    n = len(w.hash)
    p = np.flatnonzero(gram_starts(w.ptr, length, n)) if n >= length else np.zeros(0, np.int64)
    if not len(p):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z
    g = grams(w.hash, seed)
    anchor = last_smallest(g, length - seed + 1)[p]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.concatenate([first, [len(p)]]))
    start, anchor = p[first], anchor[first]
    stretch = mix(Stretches(w.hash).of(start, start + count - 1 + length) ^ (anchor - start).astype(np.uint64))
    return g[anchor], stretch, w.doc[start], start - w.ptr[w.doc[start]], count


def _merged(ids: list[pa.Array], found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """One row of each of the runs' equal stretches, and the others as ``known`` repeats."""
    ids = pa.concat_arrays(ids)
    anchor, stretch, doc, place, count = (np.concatenate(x) for x in zip(*found))
    found.clear()
    rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int32)[doc]
    order = np.lexsort((place, rank, stretch, anchor))
    same = np.zeros(len(order), dtype=bool)
    a, b = order[1:], order[:-1]
    same[1:] = (anchor[a] == anchor[b]) & (stretch[a] == stretch[b])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))  # the earliest of each row's equal stretches
    lead = order[lead]
    known = same & ((rank[order] != rank[lead]) | (place[order] != place[lead]))  # the same place twice is one place
    at = order[~(same & ~known)]
    known = known[~(same & ~known)]
    spread = mix(np.arange(len(at), dtype=np.uint64) ^ mix(anchor[at]))  # known repeats need no anchor: deal them evenly
    anchor = np.where(known, spread, anchor[at])
    for i in range(0, len(at), 50_000):
        s = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[s].view(np.int64)), pa.array(stretch[at[s]].view(np.int64)), ids.take(pa.array(doc[at[s]])),
             pa.array(place[at[s]]), pa.array(count[at[s]]), pa.array(known[s])], names=["anchor", "stretch", "id", "place", "n", "known"])


def _seeds(length: int, seed: int):
    """(anchor, stretch, id, place, n, known): one row per run, or ``known`` repeats of a run among the same CHUNK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, texts, held = [], [], 0, 0
        for batch in batches:
            for part in steps(batch, "text"):
                anchor, stretch, doc, start, count = runs(Words(part.column(2)), length, seed)
                place = (part.column(1).to_numpy().astype(np.int64) << 32)[doc] + start
                found.append((anchor, stretch, doc.astype(np.int32) + texts, place, count.astype(np.int32)))
                ids.append(part.column(0))
                texts, held = texts + part.num_rows, held + len(anchor)
                if held >= CHUNK:
                    yield from _merged(ids, found)
                    ids, found, texts, held = [], [], 0, 0
        if texts:
            yield from _merged(ids, found)

    return run


def _heavy(length: int, seed: int, share: int):
    """(anchor, n) of the anchors with over 1 / share of the rows of a batch of seeds, and (null, n) of all its rows."""
    seeds = _seeds(length, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in seeds(batches):
            own = batch.column(0).to_numpy()[~batch.column(5).to_numpy(zero_copy_only=False)]
            anchor, n = np.unique(own, return_counts=True)
            much = (n > 1) & (n * share > len(own))
            yield pa.RecordBatch.from_arrays([pa.array([*anchor[much].tolist(), None], pa.int64()), pa.array([*n[much].tolist(), len(own)], pa.int64())], names=["anchor", "n"])

    return run


def hot_anchors(texts: DataFrame, length: int, seed: int, share: int) -> DataFrame:
    """(anchor) of at most ``share`` anchors, all those with over 2 / share of all rows among them.

    Batches leave an anchor out where it has 1 / share of their rows or less, so what they count of an anchor falls short
    by 1 / share of all rows at most; those counted over 1 / share of all rows stay.
    """
    counts = written(texts.mapInArrow(_heavy(length, seed, share), "anchor long, n long"), "heavy", narrow=True)
    total = counts.filter("anchor is null").agg(F.sum("n")).first()[0] or 0
    return counts.filter("anchor is not null").groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") * share > total).select("anchor")


def _lists(col: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(row of each element, elements) of a list column; null is empty."""
    size = np.nan_to_num(pc.list_value_length(col).to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(col)), size), col.flatten()


def _removed(w: Words, row: np.ndarray, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Whether each word lies in one of the repeated windows (runs of ``count`` windows of a row)."""
    n = len(w.start)
    at = w.ptr[row] + start
    step = np.bincount(at, minlength=n + 1) - np.bincount(at + count - 1 + length, minlength=n + 1)[:n + 1]
    return np.cumsum(step)[:n] > 0


def _result(w: Words, i: int, gone: np.ndarray, digest: bool) -> str:
    words = w.data[w.bounds[i]:w.bounds[i + 1]].tobytes().split()  # bytes.split cuts at the same six characters
    a, b = w.ptr[i], w.ptr[i + 1]
    if gone[a:b].any():
        words = [x for x, out in zip(words, gone[a:b].tolist()) if not out]
    kept = b" ".join(words)
    return hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace")


def _spans(w: Words, i: int, gone: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[w.ptr[i]:w.ptr[i + 1]].astype(np.int8), [0]])))
    return [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


_DONE = "n_words long, n_removed long, spans array<struct<first:int,end:int>>, kept string"


def _extend(length: int, digest: bool):
    """Finished documents, or their repeats so far and the hashes of the windows still to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                w = Words(part.column(2))
                row, items = _lists(part.column(3))
                place, count, repeat = (items.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                start, repeat = place & _PLACE, repeat.astype(bool)
                gone = _removed(w, row[repeat], start[repeat], count[repeat], length)
                open_row, first, n = row[~repeat], (w.ptr[row] + start)[~repeat], count[~repeat]
                p = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                windows = [Stretches(h).of(p, p + length).view(np.int64) for h in (w.hash, mix(w.hash ^ _SECOND))] if len(p) else [np.zeros(0, np.int64)] * 2
                rows = np.repeat(open_row, n)
                order = np.argsort(rows, kind="stable")
                rows = rows[order]
                at = (part.column(1).to_numpy().astype(np.int64) << 32)[rows] + (p[order] - w.ptr[rows])
                cut = pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32))
                compare = pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays([pa.array(windows[0][order]), pa.array(windows[1][order]), pa.array(at)], ["w1", "w2", "place"]))
                left = np.zeros(part.num_rows, dtype=bool)
                left[open_row] = True
                kept = [None if more else _result(w, i, gone, digest) for i, more in enumerate(left)]
                spans = [None if more else _spans(w, i, gone) for i, more in enumerate(left)]
                n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.ptr])
                span_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
                texts = part.column(2).take(pa.array(np.arange(part.num_rows), mask=~left))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(w.count), pa.array(n_removed), pa.array(spans, span_type), pa.array(kept, pa.string()),
                     pa.array(~left), texts, part.column(3), compare],
                    names=["id", "version", "n_words", "n_removed", "spans", "kept", "done", "text", "runs", "compare"])

    return run


def _finish(length: int, digest: bool):
    """Rows that are done as they are, and the others with the windows that were found to be repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                done = part.column(part.schema.get_field_index("done"))
                yield part.filter(done).select(["id", "n_words", "n_removed", "spans", "kept"])
                part = part.filter(pc.invert(done))
                w = Words(part.column(part.schema.get_field_index("text")), hashed=False)
                row, items = _lists(part.column(part.schema.get_field_index("runs")))
                place, count, repeat = (items.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                repeat = repeat.astype(bool)
                more_row, places = _lists(part.column(part.schema.get_field_index("more")))
                places = places.to_numpy(zero_copy_only=False)
                gone = _removed(w, np.concatenate([row[repeat], more_row]), np.concatenate([place[repeat], places]).astype(np.int64) & _PLACE,
                                np.concatenate([count[repeat], np.ones(len(places), np.int32)]).astype(np.int64), length)
                texts = range(part.num_rows)
                span_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(w.count), pa.array(np.diff(np.concatenate([[0], np.cumsum(gone)])[w.ptr])),
                     pa.array([_spans(w, i, gone) for i in texts], span_type), pa.array([_result(w, i, gone, digest) for i in texts], pa.string())],
                    names=["id", "n_words", "n_removed", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, spans (maximal repeats, in words), kept (the kept words
    joined by spaces, or their SHA-256 if ``digest``)."""
    text_batches(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    narrow = docs.select(docs[id_col].alias("id"), F.shiftrightunsigned(F.xxhash64(text), 40).cast("int").alias("version"), text.alias("text"))
    kind = dict(narrow.dtypes)["id"]
    texts = narrow.filter("id is not null")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_anchors(texts, length, seed, 8 * parts).withColumn("hot", F.lit(True))
    seeds = texts.mapInArrow(_seeds(length, seed), f"anchor long, stretch long, id {kind}, place long, n int, known boolean")
    seeds = seeds.join(F.broadcast(hot), "anchor", "left")  # at most 8 x partitions rows
    # a hot anchor's stretches are dealt out, equal ones to one task; they are taken to differ, so all their windows are compared
    dealt = seeds.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("stretch"), F.lit(parts))).otherwise(0)).repartition("anchor", "salt")
    dealt = dealt.sortWithinPartitions("anchor", "salt", "known", "stretch", "id", "place")
    equal = Window.partitionBy("anchor", "salt", "known", "stretch").orderBy("id", "place")
    one = Window.partitionBy("anchor", "salt", "known")
    seen = dealt.withColumn("nth", F.rank().over(equal)).withColumn("lo", F.min("stretch").over(one)).withColumn("hi", F.max("stretch").over(one))
    repeat = F.col("known") | (F.col("nth") > 1)
    hits = seen.filter(repeat | (F.col("lo") != F.col("hi")) | F.col("hot")).select("id", "place", "n", repeat.alias("repeat"))
    by_text = hits.groupBy("id", F.shiftright("place", 32).cast("int").alias("version")).agg(F.collect_list(F.struct("place", "n", "repeat")).alias("runs"))

    met = narrow.join(by_text, ["id", "version"], "left").select("id", "version", "text", "runs")
    item = "array<struct<place:long,n:int,repeat:boolean>>"
    work = bucketed(met.mapInArrow(_extend(length, digest), f"id {kind}, version int, {_DONE}, done boolean, text string, runs {item}, compare array<struct<w1:long,w2:long,place:long>>"), "extended", "id", "version")

    windows = work.filter("not done").select("id", F.explode("compare").alias("c")).select("id", "c.*")
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = windows.join(first, ["w1", "w2"]).filter(F.struct("id", "place") > F.col("first"))
    more = again.groupBy("id", F.shiftright("place", 32).cast("int").alias("version")).agg(F.collect_list("place").alias("more"))
    rows = work.drop("compare").join(more, ["id", "version"], "left").select("id", "n_words", "n_removed", "spans", "kept", "done", "text", "runs", "more")
    return rows.mapInArrow(_finish(length, digest), f"id {kind}, {_DONE}").withColumnRenamed("id", id_col)

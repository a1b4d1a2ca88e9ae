"""Best-fit-decreasing packing of tokenized documents into fixed-length sequences.

A document is its byte-level BPE ids and one closing id. Longer ones are cut into pieces of
``capacity`` ids, of which the first may be shorter. The order in which best-fit decreasing
sees pieces of one length doesn't matter, so the packing of the whole corpus follows from
the number of pieces of each length: at most ``capacity`` rows, whatever the corpus. The
driver packs those counts - open bins by remaining capacity under a segment tree that gives
the tightest one in logarithmic time - and gets fills: "pieces first..last of this length go,
so many to a bin, to bins from this one on, at this offset". Every piece then finds its fill
by its rank within its length, in a join with that bounded table. No piece, id or bin list
reaches the driver.

Defined cases: null text is empty; an empty document is its closing id alone; repeated rows
are packed as often as they occur; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .stage import text_batches, written

CAPACITY = 2048
END_ID = 0
#: Texts of LONG_TEXT characters with a run of LONG_SPACE white space go to the tokenizers library: the other one's
#: regular expressions run out of stack on a million spaces. The ids are the same.
LONG_TEXT, LONG_SPACE = 100_000, 1000

#: Fixed value: the pre-tokenizer pattern of byte-level BPE files with ``use_regex``.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _alphabet() -> dict[str, int]:
    """Byte of each character in which byte-level vocabularies are spelled."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of ordinary text under a tokenizers JSON file; names of special tokens are text too.

    Byte-level BPE whose ids follow the merge order runs in tiktoken, about five times as
    fast with the same ids; every other file runs in tokenizers.
    """

    def __init__(self, spec: str):
        self._spec, self._slow, self._fast = spec, None, None
        j = json.loads(spec)
        model, pre = j["model"], j.get("pre_tokenizer") or {}
        plain = not j.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            made = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"]]
            if made == [*range(256, 256 + len(made))]:
                byte = _alphabet()
                ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(made)}
                self._fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self._fast and not (len(text) >= LONG_TEXT and " " * LONG_SPACE in text.translate(_SPACES)):
            return np.asarray(self._fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        if self._slow is None:
            self._slow = Tokenizer.from_str(self._spec)
            self._slow.encode_special_tokens = True
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


_SPACES = {i: " " for i in range(0x3001) if chr(i).isspace()}


def cut_points(length: int, capacity: int) -> list[int]:
    """Bounds of a document's pieces: all full but perhaps the first."""
    return [0, *range(length % capacity or capacity, length + 1, capacity)] if length else [0]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ``ids`` if asked), with the task
    ``part`` that made it and its ``rank`` among that task's pieces of its length."""
    spark = docs.sparkSession
    text_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't follow the data
    narrow = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    schema = f"id {dict(narrow.dtypes)['id']}, piece int, start long, length long, ids_crc32 long, part long, rank long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = Encoder(spec.value), TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                slab = batch.slice(at, 256)
                rows: list[tuple] = []
                of, tokens = [], []
                for i, text in enumerate(slab.column(1).to_pylist()):
                    ids = np.append(encoder.ids(text), np.uint32(end_id)).astype("<u4")
                    cuts = cut_points(len(ids), capacity)
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        of.append(i)
                        rows.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, seen[b - a]))
                        seen[b - a] += 1
                        if with_ids:
                            tokens.append(ids[a:b].astype(np.int32))
                types = (pa.int32(), *[pa.int64()] * 5)
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                cols = [slab.column(0).take(pa.array(of)), *cols]
                if with_ids:
                    cols.append(pa.array(tokens, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


class OpenBins:
    """Open bins by remaining capacity: runs (first bin, count) at the leaves of a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, first: int, count: int) -> None:
        if count and remaining:
            self.runs[remaining].append((first, count))
            self._mark(remaining)

    def take(self, remaining: int) -> tuple[int, int]:
        run = self.runs[remaining].pop()
        self._mark(remaining)
        return run

    def _mark(self, remaining: int) -> None:
        i, some = remaining + self.size, bool(self.runs[remaining])
        while i and self.some[i] != some:
            self.some[i] = some
            i //= 2
            some = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of ``least`` or more that an open bin has."""
        i = least + self.size
        if self.some[i]:
            return least
        while i > 1:  # up to the first right sibling with an open bin, then down its left edge
            if not i % 2 and self.some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Fills (length, first rank, end rank, pieces to a bin, first bin, offset) of best-fit decreasing, and the number of bins."""
    bins, fills, used = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = used, -(-left // each)
                used += n
            else:
                each = room // length
                first, n = bins.take(room)
            full = min(n, left // each)
            if full:
                fills.append((length, rank, rank + full * each, each, first, capacity - room))
                bins.put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = n - full
            if left and rest:  # the last pieces of this length don't fill their bin's share
                fills.append((length, rank, rank + left, left, first + full, capacity - room))
                bins.put(room - left * length, first + full, 1)
                full, rank, left, rest = full + 1, rank + left, 0, rest - 1
            bins.put(room, first + full, rest)
    return fills, used


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids`` if asked)."""
    spark: SparkSession = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids, id_col, text_col), "pieces")
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    fills, _ = best_fit(counts, capacity)
    table = spark.createDataFrame(fills or [(0,) * 6], "fill_length long, first long, last long, each long, bin long, offset long")
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("rank"))
    at = F.col("rank") - F.col("first")
    found = ranked.join(F.broadcast(table), (F.col("length") == F.col("fill_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    return found.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("bin") + F.floor(at / F.col("each"))).alias("sequence_id"),
                        (F.col("offset") + F.pmod(at, F.col("each")) * F.col("length")).alias("offset"), *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., with_ids=True)``: sequence_id, n_pieces, ids."""
    row = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` ids
    return packed.groupBy("sequence_id").agg(row.alias("rows")).select(
        "sequence_id", F.size("rows").alias("n_pieces"), F.flatten(F.col("rows.ids")).alias("ids"))

"""Spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets.

A word's letters, with their multiplicities, are a binary vector with one place for each (letter, occurrence). One edit changes
at most two places. The places are dealt into PARTS parts; two vectors that differ in two places agree on all but two
parts at most, so for every choice of two parts to leave out, the letters in the others are a signature, and words one edit
apart share at least one. The signatures are exact: no pair is lost. They are joined by an equi join, and
every pair that meets is verified by its edit distance in the join itself.

Letters alone leave anagrams together. Of two words one edit apart the shorter's first or last half is common to both, so
each signature is combined with the length and either half; that makes groups small and still loses no pair. Signatures are 64-bit sums, a chance
equality is refuted by the verification.

Words come from runs of Latin letters ([A-Za-z\\u00C0-\\u00FF]+), A-Z in lower case, counted over all texts in numpy windows of bounded size. The contract's
misspellings are made on the way: where 97 divides the crc32 of ``<id>:<run>``, one letter of the run is left out.

Defined cases: null and empty texts have no runs; a null id counts as the empty string; a repeated row counts again; of near words that tie in count the
smallest in code-point order is the form; a run of any length is read whole; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import written
from .words import LOWER, mix, span_hash, text_bytes

#: One run in EVERY loses a letter; shortest word, fewest occurrences, times as frequent as a form is.
EVERY, LEAST_LETTERS, LEAST_COUNT, TIMES = 97, 5, 3, 2
#: Parts that the letter places are dealt into; bytes of text handled at once.
PARTS, WINDOW = 4, 4 << 20
#: Occurrences of one letter with places of their own; later ones share the last place's value, which is added once for each.
PLACES = 8
#: Runs of more bytes have their crc32 from the library one by one.
LONG_RUN = 48


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()
_RNG = np.random.Generator(np.random.PCG64(20251201))
_PART = _RNG.integers(0, PARTS, (256, PLACES))
_VALUE = _RNG.integers(1, 1 << 63, (256, PLACES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def run_crc(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each run's bytes behind its prefix, whose crc32 is in ``state``."""
    out = np.empty(len(start), dtype=np.uint32)
    size = end - start
    for i in np.flatnonzero(size > LONG_RUN).tolist():
        out[i] = zlib.crc32(data[start[i]:end[i]].tobytes(), int(state[i]))
    short = np.flatnonzero(size <= LONG_RUN)
    short = short[np.argsort(-size[short], kind="stable")]  # the runs that have a byte j come first
    s, n = start[short], size[short]
    crc = state[short] ^ np.uint32(0xFFFFFFFF)
    left = np.searchsorted(-n, -np.arange(LONG_RUN), side="left")  # runs longer than j bytes
    for j in range(int(n[0]) if len(n) else 0):
        k = left[j]
        part = crc[:k]
        crc[:k] = _CRC[(part ^ data[s[:k] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out[short] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _windows(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(base, starts, ends) of the runs of letters in pieces of about WINDOW bytes, cut where no run is."""
    at, size = 0, WINDOW
    while at < len(data):
        b = data[at:at + size]
        lead = b == 0xC3  # of U+00C0 to U+00FF; the byte after it belongs to it
        inside = ((b >= 0x61) & (b <= 0x7A)) | lead
        inside[1:] |= lead[:-1]
        if at + size < len(data):
            free = np.flatnonzero(~inside)
            if not len(free):  # one run as long as the window: a larger one
                size *= 2
                continue
            inside = inside[:free[-1] + 1]
        n = len(inside)
        cut = np.zeros(n + 1, dtype=bool)
        own = bounds[np.searchsorted(bounds, at):np.searchsorted(bounds, at + n, side="right")] - at
        cut[own] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:n]
        last[:-1] &= ~inside[1:] | cut[1:n]
        yield at, np.flatnonzero(first) + at, np.flatnonzero(last) + 1 + at
        at, size = at + n, WINDOW


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of batches of (id, text): partial counts, each word once for each window of text."""
    for batch in batches:
        data, bounds = text_bytes(batch.column(1))
        data = LOWER[data]
        prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()], dtype=np.uint32)
        for at, start, end in _windows(data, bounds):
            if not len(start):
                continue
            crc = run_crc(data, start, end, prefix[np.searchsorted(bounds, start, side="right") - 1])
            leads = np.concatenate([[0], np.cumsum(data[at:end[-1]] == 0xC3)])
            letters = (end - start) - (leads[end - at] - leads[start - at])
            changed = crc % np.uint32(EVERY) == 0
            whole = ~changed & (letters >= LEAST_LETTERS)
            words = [_gathered(data, start[whole], end[whole])]
            some = []
            for i in np.flatnonzero(changed & (letters > LEAST_LETTERS)).tolist():
                run = data[start[i]:end[i]].tobytes().decode()
                k = int(crc[i]) % len(run)
                some.append(run[:k] + run[k + 1:])
            words.append(pa.array(some, pa.string()))
            found = pc.value_counts(pa.chunked_array(words))
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts").cast(pa.int64())], names=["word", "n"])


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as strings."""
    size = end - start
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes())])


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, long, word, n) of batches of (word, n): for both lengths, both halves and each two parts left out, a key.
    ``long``: the key is for meeting words one letter shorter."""
    for batch in batches:
        for from_row in range(0, batch.num_rows, 1 << 14):
            words = batch.slice(from_row, 1 << 14)
            raw = [w.encode("latin-1") for w in words.column(0).to_pylist()]  # all letters are below U+0100
            size = np.array([len(w) for w in raw], dtype=np.int64)
            data = np.frombuffer(b"".join(raw), np.uint8)
            end = np.cumsum(size)
            start = end - size
            owner = np.repeat(np.arange(len(raw)), size)
            # each letter's number among the equal ones of its word
            kind = owner * 256 + data
            order = np.argsort(kind, kind="stable")
            head = np.concatenate([[True], kind[order][1:] != kind[order][:-1]])
            first = np.flatnonzero(head)
            nth = np.empty(len(kind), dtype=np.int64)
            nth[order] = np.arange(len(kind)) - np.repeat(first, np.diff(np.concatenate([first, [len(kind)]])))
            place = np.minimum(nth, PLACES - 1)
            sums = np.zeros((len(raw), PARTS), dtype=np.uint64)
            np.add.at(sums, (owner, _PART[data, place]), _VALUE[data, place])
            total = sums.sum(axis=1, dtype=np.uint64)
            keys, longer = [], []
            for more in (0, 1):
                length = size - more
                half = length // 2
                for side, h in enumerate((span_hash(data, start, start + half), span_hash(data, end - half, end))):
                    base = mix(h + length.astype(np.uint64) * np.uint64(2) + np.uint64(side))
                    for x, (i, j) in enumerate(combinations(range(PARTS), 2)):
                        keys.append(mix(base ^ mix(total - sums[:, i] - sums[:, j] + np.uint64(x))))
                        longer.append(more)
            times = len(keys)
            at = pa.array(np.tile(np.arange(len(raw)), times))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(longer, dtype=np.int8), len(raw))),
                                              words.column(0).take(at), words.column(1).take(at)], names=["key", "long", "word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter("text <> ''")
    counts = rows.mapInArrow(word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all ordered pairs of words of (word, n) that are one edit apart; words are distinct.
    A merge join: the planner takes the signatures for as large as the words they are made of."""
    keys = words.mapInArrow(signatures, "key long, long byte, word string, n long")
    a, b = keys.alias("a"), keys.alias("b")
    once = (F.col("a.long") < F.col("b.long")) | ((F.col("a.long") + F.col("b.long") == 0) & (F.col("a.word") < F.col("b.word")))
    apart = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    pairs = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & once & apart)
    pairs = pairs.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")).distinct()
    there = F.struct("word", "n", "near", "near_n")
    back = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select(F.inline(F.array(there, back)))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word of each chain. Each round doubles the steps taken; a form is at
    least twice as frequent as its word, so chains have fewer than 64 steps and six rounds do. Merge joins, here and
    below: the planner takes a compressed file's size for that of its rows."""
    found = written(forms.select("word", F.col("form").alias("root")), "roots", narrow=True)
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = written(found.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", narrow=True)
        if not found.filter("moved").limit(1).count():
            return found.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = written(vocabulary(docs, id_col, text_col), "words", narrow=True)
    best = F.min(F.struct((-F.col("near_n")).alias("by"), F.col("near").alias("form")))
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.by") >= TIMES * F.col("n")
    near = written(near.select("word", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.by")).alias("form_n")), "near", narrow=True)
    last = roots(near.filter(F.col("form").isNotNull()))
    out = words.join(near.hint("merge"), "word", "left").join(last.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")

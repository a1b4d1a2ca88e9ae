"""Quality rules by repetition coverage.

For several n, rolling hashes of word n-grams find the n-grams that a text holds twice or
more; the characters inside them, and inside lines that repeat an earlier line, are
measured against all characters in words. All comparisons are in whole numbers.

Defined cases: null text is empty; an empty text has no words, fails the base rule and is
not kept; repeated rows are judged one by one; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .stage import text_batches
from .words import Words, covered, gram_starts, grams, mix, per_text, repeated, span_hash, steps

#: n-gram length -> most per cent of the characters in words that repeated n-grams of it may hold.
GRAM_LIMITS = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
#: Most per cent of characters inside, and of lines that are, repeats of an earlier line.
LINE_CHARS, LINES = 30, 30
#: Most symbols per 100 words; bounds of the mean word length, in tenths of a character.
SYMBOLS, MEAN_LENGTH = 10, (20, 120)
#: Base rule: fewest words, and most per cent of words inside repeated 3-word windows.
LEAST_WORDS, REPEAT_WINDOW, REPEAT_WORDS = 50, 3, 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words",
          *(f"dup_chars_{n}" for n in GRAM_LIMITS))
SIGNALS = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All counts and both verdicts of each text."""
    w = Words(texts)
    n = len(w.start)
    lead = (w.data & 0xC0) != 0x80  # one byte of each code point
    at = np.concatenate([[0], np.cumsum(lead & w.inside, dtype=np.int64)])  # characters in words before each byte
    chars = at[w.end] - at[w.start]
    out = {"n_words": w.count, "word_chars": np.diff(at[w.bounds]), "n_symbols": per_text(_SYMBOL[w.data], w.bounds)}

    ls, le, owner = w.lines()
    of_line = at[le] - at[ls]
    real = of_line > 0  # lines with a word
    ls, le, owner, of_line = ls[real], le[real], owner[real], of_line[real]
    again = np.zeros(len(ls), dtype=bool)
    if len(ls):
        key = mix(span_hash(w.data, ls, le) ^ mix(owner.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")  # the first of equal lines stays first
        again[order[1:]] = key[order][1:] == key[order][:-1]
    texts_n = len(w.count)
    out["n_lines"] = np.bincount(owner, minlength=texts_n)
    out["n_dup_lines"] = np.bincount(owner[again], minlength=texts_n)
    out["dup_line_chars"] = np.bincount(owner[again], weights=of_line[again], minlength=texts_n).astype(np.int64)

    salt = mix(w.doc.astype(np.uint64) + np.uint64(1))
    # an n-gram can only repeat where its first and last (n-1)-grams do, so each length looks at fewer starts
    length = REPEAT_WINDOW
    starts = np.flatnonzero(gram_starts(w.ptr, length, n))
    starts = starts[repeated(mix(grams(w.hash, length)[starts] ^ salt[starts]))]
    out["n_repeat_words"] = per_text(covered(n, starts, length), w.ptr)
    for length in GRAM_LIMITS:
        fits = starts + length <= w.ptr[w.doc[starts] + 1] if len(starts) else np.zeros(0, dtype=bool)
        starts = starts[fits]
        if len(starts):
            starts = starts[repeated(mix(grams(w.hash, length)[starts] ^ salt[starts]))]
        out[f"dup_chars_{length}"] = per_text(np.where(covered(n, starts, length), chars, 0), w.ptr)

    words, letters = out["n_words"], out["word_chars"]
    out["base_failed"] = (words < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEAT_WORDS * words)
    bad = out["base_failed"].copy()
    for length, most in GRAM_LIMITS.items():
        bad |= 100 * out[f"dup_chars_{length}"] > most * letters
    bad |= 100 * out["dup_line_chars"] > LINE_CHARS * letters
    bad |= 100 * out["n_dup_lines"] > LINES * out["n_lines"]
    bad |= 100 * out["n_symbols"] > SYMBOLS * words
    bad |= (10 * letters < MEAN_LENGTH[0] * words) | (10 * letters > MEAN_LENGTH[1] * words)
    out["kept"] = ~bad
    return out


def quality_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the counts (``COUNTS``), ``base_failed`` and ``kept``."""
    names = [*COUNTS, "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                got = measure(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[c]) for c in names)], names=["id", *names])

    text_batches(docs.sparkSession)
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, {SIGNALS}").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass every rule, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text_col):
                yield part.filter(pa.array(measure(part.column(part.schema.get_field_index(text_col)))["kept"]))

    text_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)

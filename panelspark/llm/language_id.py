"""Language identification by error-correcting output codes over byte n-gram classifiers.

Each language gets a codeword; with four languages the codewords are four bits apart, so one wrong bit is corrected. For each bit, a binary naive Bayes classifier over hashed byte
n-grams tells the languages with a 1 from those with a 0; its margin is the mean log odds of the
text's n-grams. Decoding adds up the logistic loss of each codeword's bits over the margins and
takes the codeword with the least loss. ``score`` is the winner's share among the codewords under
exp(-loss); a text whose share is under AMBIGUOUS is flagged. Texts are read in lower case with
one space for each run of other ASCII characters, and margins shrink for texts of few n-grams.

Training is a count over all labelled rows: every task adds up its rows' n-grams by language and
the sums meet by language and bucket. The model is languages x buckets numbers, whatever the corpus.

Defined cases: null text or a text without a letter is ``und`` with score 0; rows without
label don't train; without any labelled row all texts are ``und``; one language alone wins with
score 1; there may be any number of labels (the model has a row of counts for each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import by_value, text_batches
from .words import LOWER, steps, text_bytes

#: Lower case, and everything in ASCII that is no letter as a space.
LETTERS = LOWER.copy()
LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20

#: Lengths of the byte n-grams, and buckets they are hashed into, for each length.
GRAMS, BUCKETS = (2, 3, 4), 1 << 13
#: Languages up to which every split of them is a bit; else bits of a codeword at least (four more for each doubling of the languages), and draws.
EVERY_SPLIT, LEAST_BITS, DRAWS, SEED = 7, 16, 400, 11
#: Labels whose counts a task holds at once; it passes them on and begins anew when there are more.
HELD = 256
SHARPNESS, AMBIGUOUS, FEW = 4.0, 0.6, 20
UNKNOWN = "und"
#: n-grams of a text from which on they are counted by bucket before the odds are added up.
MANY = 3000


def _has_letter(text: str | None) -> bool:
    """Whether a character is a letter; numerals, superscripts and fractions are none."""
    return text is not None and any(map(str.isalpha, text))


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts in LETTERS, with one space for each run of them, and the bounds of each text."""
    data, bounds = text_bytes(texts)
    data = LETTERS[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    first = bounds[:-1][bounds[:-1] < len(data)]
    keep[first] = True
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram from each byte (of len(data) - n + 1)."""
    m = max(0, len(data) - n + 1)
    h = np.zeros(m, dtype=np.uint32)
    for j in range(n):
        h *= np.uint32(0x01000193)
        h += data[j:j + m]
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - BUCKETS.bit_length() + 1)


def codewords(languages: int) -> np.ndarray:
    """-1/+1 code matrix, languages x bits. No two columns split the languages alike, so no two classifiers are the same and a bit's
    error is its own. Few languages get every split there is; the codewords of n languages are then 2 ** (n - 2) bits apart. More
    get the one of many seeded draws of distinct balanced splits whose nearest two codewords are farthest apart."""
    if languages <= 1:
        return np.ones((languages, 1), dtype=int)
    if languages <= EVERY_SPLIT:
        return np.array([[1 if i == 0 or split >> (i - 1) & 1 else -1 for split in range((1 << (languages - 1)) - 1)] for i in range(languages)])
    bits = max(LEAST_BITS, 4 * max(1, languages - 1).bit_length())
    rng, best, far = np.random.Generator(np.random.PCG64(SEED)), None, -1
    half = np.where(np.arange(languages) < (languages + 1) // 2, 1, -1)
    for _ in range(max(4, min(DRAWS, 40_000 // languages))):
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < bits:
            column = rng.permutation(half)
            column = column * column[0]  # a split and its complement are one
            columns[column.tobytes()] = column
        code = np.stack(list(columns.values()), axis=1)
        apart = (bits - code @ code.T) // 2
        least = int((apart + bits * np.eye(languages, dtype=int)).min())
        if least > far:
            best, far = code, least
    return best


class Model:
    """Codewords and the log odds of each bucket for each bit."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: languages x (n-gram lengths x buckets)"""
        self.languages = languages
        self.code = codewords(len(languages))
        # each language weighs the same, whatever its share of the rows
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if languages else np.zeros((0, len(GRAMS) * BUCKETS))
        odds = []
        for bit in self.code.T:
            one, zero = share[bit > 0], share[bit < 0]
            odds.append(np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0)) if len(one) and len(zero) else np.zeros(len(GRAMS) * BUCKETS))
        self.odds = np.ascontiguousarray(np.array(odds).T)

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean log odds of each text's n-grams, with FEW neutral ones, texts x bits."""
        total = np.zeros((len(bounds) - 1, self.code.shape[1]))
        for i, n in enumerate(GRAMS):
            found, odds = buckets(data, n), self.odds[i * BUCKETS:(i + 1) * BUCKETS]
            last = np.maximum(bounds[1:] - n + 1, bounds[:-1])  # n-grams across two texts don't count
            for k, (a, b) in enumerate(zip(bounds.tolist(), last.tolist())):
                if b - a > MANY:
                    total[k] += np.bincount(found[a:b], minlength=BUCKETS) @ odds
                elif b > a:
                    total[k] += odds[found[a:b]].sum(axis=0)
        size = sum(np.maximum(np.diff(bounds) - n + 1, 0) for n in GRAMS)
        return total / (size + FEW)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, score) of each text: least logistic loss over the bits."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None] * SHARPNESS).sum(axis=2)
        like = np.exp(loss.min(axis=1, keepdims=True) - loss)
        best = loss.argmin(axis=1)
        return best, like[np.arange(len(like)), best] / like.sum(axis=1)


def _rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of the counts that aren't 0."""
    for lang, counts in sums.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["lang", "bucket", "n"])


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """The model of the rows with a label (all of them, whole texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in steps(batch, "text"):
                for lang in part.column(1).unique().to_pylist():
                    own = part.column(0).filter(pc.equal(part.column(1), lang))
                    data, bounds = letters(own)
                    if lang not in sums and len(sums) >= HELD:
                        yield from _rows(sums)
                        sums.clear()
                    into = sums.setdefault(lang, np.zeros(len(GRAMS) * BUCKETS, dtype=np.int64))
                    for i, n in enumerate(GRAMS):
                        b = buckets(data, n)
                        whole = np.ones(len(b), dtype=bool)
                        for j in range(1, n):
                            cut = bounds[1:-1] - j
                            whole[cut[(cut >= 0) & (cut < len(b))]] = False
                        into[i * BUCKETS:(i + 1) * BUCKETS] += np.bincount(b[whole], minlength=BUCKETS)
        yield from _rows(sums)

    text_batches(labelled.sparkSession)
    rows = labelled.select(labelled[text_col].alias("text"), labelled[label_col].alias("lang")).filter("lang is not null and text is not null")
    summed = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = summed.toPandas()  # the model: labels x buckets numbers, however many rows there are
    languages = sorted(got["lang"].unique().tolist())
    counts = np.zeros((len(languages), len(GRAMS) * BUCKETS))
    number = {x: i for i, x in enumerate(languages)}
    counts[got["lang"].map(number).to_numpy(dtype=int), got["bucket"].to_numpy(dtype=int)] = got["n"]
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """One row per input row: id, ``more``, lang_pred, score, ambiguous. Only the text is looked at."""
    text_batches(docs.sparkSession)
    shared = by_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            for part in steps(batch, "text"):
                text = part.column(part.num_columns - 1)
                if model.languages:
                    best, score = model.decode(model.margins(*letters(text)))
                    known = np.array([_has_letter(t) for t in text.to_pylist()], dtype=bool)
                else:
                    best = score = np.zeros(part.num_rows)
                    known = np.zeros(part.num_rows, dtype=bool)
                lang = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)]
                score = np.where(known, score, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)],
                                                 names=[*part.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    narrow = docs.select(docs[id_col].alias("id"), *more, docs[text_col].alias("text"))
    kept = ", ".join(f"`{c}` {t}" for c, t in narrow.dtypes[:-1])
    return narrow.mapInArrow(run, f"{kept}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)

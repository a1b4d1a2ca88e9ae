"""Chunk encoding and vector pooling.

The encoder is the only Python step: ``mapInArrow`` streams batches through a
user-supplied encoder that is built once per task. ``embed_docs`` encodes and
pools in that pass. Stored chunk vectors are pooled JVM-side:
``Summarizer.mean`` with a weight column is a partial aggregate over ML
vectors, so a document with many chunks is combined map-side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import cosine, l2_normalize
from .sentences import SentenceEnds
from .text import CHUNK_CAP, chunk_array


class HashingEncoder:
    """Deterministic bag-of-words feature hashing, L2-normalised.

    A stand-in for a sentence encoder (no model weights ship with the source):
    lower-cased word tokens are hashed to a dimension and a sign. One call per
    Arrow batch: tokens of the whole batch are hashed at once
    (``pandas.util.hash_array``, fixed key, so stable across processes) and
    scattered with ``bincount``. Any object with ``dim`` and
    ``encode(list[str]) -> ndarray[n, dim]`` can replace it.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        import itertools
        import re

        n, dim = len(texts), self.dim
        tok = re.compile(r"\w+")
        toks = [tok.findall(t.lower()) if t else [] for t in texts]
        lens = np.fromiter((len(t) for t in toks), dtype=np.int64, count=n)
        total = int(lens.sum())
        out = np.zeros(n * dim, dtype=np.float64)
        if total:
            flat = np.empty(total, dtype=object)
            flat[:] = list(itertools.chain.from_iterable(toks))
            h = pd.util.hash_array(flat)
            slot = (h % np.uint64(dim)).astype(np.int64)
            sign = np.where((h >> np.uint64(63)) == 0, 1.0, -1.0)
            rows = np.repeat(np.arange(n, dtype=np.int64), lens)
            out = np.bincount(rows * dim + slot, weights=sign, minlength=n * dim)
        out = out.reshape(n, dim)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        np.divide(out, norms, out=out, where=norms > 0)
        return out


def embed_chunks(df: DataFrame, text: str = "chunk", out: str = "vec",
                 factory: Callable[[], object] | None = None, keep_text: bool = True) -> DataFrame:
    """Encode each row's ``text`` to a vector (array<float>) (V3).

    ``mapInArrow``: record batches go to the Python worker and come back as
    Arrow arrays (the vectors are built as one flat float buffer plus offsets),
    with no pandas round trip per row. ``factory`` builds one encoder per task.
    ``keep_text=False`` drops the text from the output so it is not shipped back.
    """
    import pyarrow as pa

    factory = factory or HashingEncoder
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType(fields + [T.StructField(out, T.ArrayType(T.FloatType()))])
    names = [f.name for f in fields]

    def run(batches):
        enc = factory()
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            texts = rb.column(rb.schema.get_field_index(text)).to_pylist()
            vecs = np.ascontiguousarray(enc.encode(texts), dtype=np.float32)
            dim = vecs.shape[1]
            offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
            arr = pa.ListArray.from_arrays(offsets, pa.array(vecs.reshape(-1)))
            cols = [rb.column(rb.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(cols + [arr], names=names + [out])

    return df.mapInArrow(run, schema)


#: Chunks that are sorted by length together, and padded tokens of a batch, for ``embed_by_budget``.
SORT_ROWS, TOKEN_BUDGET = 4096, 16_384


def budget_batches(tokens: np.ndarray, budget: int) -> list[np.ndarray]:
    """Row numbers of batches of similar length: rows times the longest row's tokens is at most ``budget``, but for single rows over it."""
    order = np.argsort(tokens, kind="stable")
    out, at = [], 0
    while at < len(order):
        # lengths rise, so a batch is as many rows as its last row's length allows
        low, high = at + 1, len(order)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if (mid - at) * int(tokens[order[mid - 1]]) <= budget else (low, mid - 1)
        out.append(order[at:low])
        at = low
    return out


def embed_by_budget(df: DataFrame, text: str = "chunk", out: str = "vec", factory: Callable[[], object] | None = None, budget: int = TOKEN_BUDGET,
                    keep_text: bool = True, profile=None) -> DataFrame:
    """``embed_chunks`` with batches of a bounded number of padded tokens (V3).

    An encoder pads a batch to its longest text, so texts of mixed lengths waste most of the work and a batch of long ones may not
    fit its memory. Each task sorts SORT_ROWS texts at a time by length and cuts them into batches of at most ``budget``
    padded tokens; vectors go back to their rows' places. The encoder may have ``tokens(list[str]) -> list[int]``; else tokens are
    estimated as a quarter of the characters. ``profile``: a resource profile for the stage that encodes, e.g. one task a GPU.
    Vectors are those of ``embed_chunks`` wherever the encoder's results don't depend on a batch. Null texts are encoded as empty ones.
    """
    import pyarrow as pa

    factory = factory or HashingEncoder
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType(fields + [T.StructField(out, T.ArrayType(T.FloatType()))])
    names = [f.name for f in fields]

    def run(batches):
        enc = factory()
        count = getattr(enc, "tokens", None) or (lambda texts: [-(-len(t) // 4) for t in texts])
        for whole in batches:
            for at in range(0, whole.num_rows, SORT_ROWS):
                rb = whole.slice(at, SORT_ROWS)
                texts = [t or "" for t in rb.column(rb.schema.get_field_index(text)).to_pylist()]
                vecs = None
                for rows in budget_batches(np.asarray(count(texts), dtype=np.int64), budget):
                    got = np.asarray(enc.encode([texts[i] for i in rows]), dtype=np.float32)
                    vecs = np.empty((len(texts), got.shape[1]), dtype=np.float32) if vecs is None else vecs
                    vecs[rows] = got
                offsets = pa.array(np.arange(0, (len(texts) + 1) * vecs.shape[1], vecs.shape[1], dtype=np.int32))
                cols = [rb.column(rb.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays(cols + [pa.ListArray.from_arrays(offsets, pa.array(vecs.reshape(-1)))], names=names + [out])

    return df.mapInArrow(run, schema, profile=profile)


#: Most chunks that go through the encoder at once.
ENCODE_ROWS = 1024


def _pool_rows(chunks, encoder) -> list:
    """One unit vector per row of a list-of-chunks column: chunk vectors weighted by their
    lengths; null without chunks or for a zero vector."""
    import pyarrow.compute as pc

    flat = chunks.flatten()
    size = np.nan_to_num(pc.list_value_length(chunks).to_numpy(zero_copy_only=False)).astype(np.int64)
    owner = np.repeat(np.arange(len(chunks)), size)
    sums = None
    for at in range(0, len(flat), ENCODE_ROWS):
        texts = flat.slice(at, ENCODE_ROWS).to_pylist()
        # float32 like stored vectors, then pooled in double
        vecs = np.asarray(encoder.encode(texts), dtype=np.float32).astype(np.float64)
        vecs *= np.fromiter(map(len, texts), dtype=np.float64, count=len(texts))[:, None]
        if sums is None:
            sums = np.zeros((len(chunks), vecs.shape[1]))
        np.add.at(sums, owner[at:at + ENCODE_ROWS], vecs)
    if sums is None:
        return [None] * len(chunks)
    norms = np.sqrt((sums * sums).sum(axis=1))
    return [(v / n).tolist() if n > 0 else None for v, n in zip(sums, norms)]


def pool_vectors(df: DataFrame, key: str | Sequence[str], vector: str, weight: str | None = None,
                 out: str = "vec") -> DataFrame:
    """Weighted mean of the vectors per key, then L2-normalised.

    Null when the weights sum to 0 or the mean is the zero vector; a key with no
    rows has no output row (callers left-join to keep it as null).
    """
    keys = [key] if isinstance(key, str) else list(key)
    v = array_to_vector(F.col(vector))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mean = Summarizer.mean(v, w) if weight else Summarizer.mean(v)
    pooled = df.groupBy(*keys).agg(mean.alias("__m"))
    return pooled.select(*keys, l2_normalize(vector_to_array(F.col("__m"), "float64")).alias(out))


def explode_vector(df: DataFrame, key: str | Sequence[str], vector: str,
                   index: str = "i", value: str = "v") -> DataFrame:
    """Long form (key..., i, v) of an array column."""
    keys = [key] if isinstance(key, str) else list(key)
    return (df.select(*keys, F.posexplode(vector).alias(index, value))
              .withColumn(index, F.col(index).cast("long")))


def cosine_to_pooled(df: DataFrame, key: str, vector: str, weight: str | None = None,
                     out: str = "cosine") -> DataFrame:
    """Cosine of every vector with its group's pooled vector (F23) -- one partner per
    row via an equi-join on the group, never all pairs."""
    pooled = pool_vectors(df, key, vector, weight, out="__pooled")
    return df.join(pooled, key, "inner").withColumn(out, cosine(vector, "__pooled")).drop("__pooled")


def embed_docs(df: DataFrame, key: str | Sequence[str], fields: dict[str, str], factory: Callable[[], object] | None = None,
               sep: str = "\n", cap: int = CHUNK_CAP, ends: SentenceEnds | None = None) -> DataFrame:
    """Embed several text columns per document in one pass (V3, V4, V5).

    ``fields`` maps a text column to its output column (e.g. text -> embfull,
    item1 -> emb1). Each row's texts are chunked in the JVM into arrays; one Arrow
    pass encodes the chunks, pools them weighted by chunk length and returns one
    row per input row: the keys and a vector per field, null where a text is null or has no
    chunk. No pivot and no join; the one shuffle spreads the rows evenly,
    because encoding costs far more per byte than moving the text.
    """
    import pyarrow as pa

    factory = factory or HashingEncoder
    keys = [key] if isinstance(key, str) else list(key)
    cut = [chunk_array(src, sep, cap, ends).alias(out) for src, out in fields.items()]
    rows = df.repartition(*keys).select(*keys, *cut)
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(out, T.ArrayType(T.DoubleType())) for out in fields.values()])

    def run(batches):
        enc = factory()
        for rb in batches:
            vecs = [pa.array(_pool_rows(c, enc), pa.list_(pa.float64())) for c in rb.columns[len(keys):]]
            yield pa.RecordBatch.from_arrays([*rb.columns[:len(keys)], *vecs], names=rb.schema.names)

    return rows.mapInArrow(run, schema)

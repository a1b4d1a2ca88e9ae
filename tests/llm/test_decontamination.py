"""Decontamination against the similarity of every window."""

import random
import re
from collections import Counter

import numpy as np

from panelspark.llm import decontamination as D

from ..conftest import SF001


def words(text):
    return [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if x]


def brute(docs, items):
    out = {}
    for i, text in items:
        b = words(text)
        own = Counter(tuple(b[j:j + 5]) for j in range(len(b) - 4))
        for d, t in docs:
            w = words(t)
            if not b or not w:
                continue
            if len(b) < 5 or len(w) < 5:
                if w == b:
                    out[d, i] = (1, 1)
                continue
            grams, size, best = [tuple(w[j:j + 5]) for j in range(len(w) - 4)], min(len(b), len(w)) - 4, (0, 1)
            if not own.keys() & set(grams):
                continue
            for p in range(len(grams) - size + 1):
                here = Counter(grams[p:p + size])
                shared, union = (here & own).total(), (here | own).total()
                if 100 * shared >= 80 * union and shared > best[0]:
                    best = (shared, union)
            if best[0]:
                out[d, i] = best
    return out


def test_leaks(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rng, plain = random.Random(5), [t for _, t in docs]
    for j in range(250):  # near copies of items within documents
        own = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            at, how = rng.randrange(len(own)), rng.random()
            if how < 0.3:
                own[at] = own[at].upper() + "!"
            elif how < 0.6:
                own[at] = "zzz"
            elif how < 0.8 and len(own) > 6:
                del own[at]
            else:
                own.insert(at, "qq")
        host = rng.choice(plain).split()
        at = rng.randint(0, len(host))
        docs.append((10**6 + j, " ".join(host[:at] + own + host[at:])))
    docs += [(-1, None), (-2, ""), (-3, "short item"), (-4, "The Short, item"), (-5, "a " * 30), (-6, "a " * 60_000), (-3, "short item")]
    items += [(900, "short item!"), (901, None), (902, ""), (903, "a " * 10), (903, "a " * 10)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, shared int").repartition(5)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): (r.shared, r.of) for r in D.leaks(df, bench).collect()} == want
    assert len(want) > 100
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in {k for k, _ in want})
    assert D.leaks(df.limit(0), bench).count() == 0 and D.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/benchmark.parquet")
    whole = sorted(map(tuple, D.leaks(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 4000)
    assert sorted(map(tuple, D.leaks(docs, bench).collect())) == whole and whole


def test_index_gives_all_within_the_radius():
    rng = np.random.default_rng(3)
    stored = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    queries = np.concatenate([stored[:50] ^ np.uint64(0b1011), rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    for radius in (0, 3, 23):
        q, k = D.HammingIndex(stored, radius).near(queries)
        near = np.bitwise_count(queries[:, None] ^ stored[None]) <= radius
        assert sorted(zip(q.tolist(), k.tolist())) == list(zip(*(x.tolist() for x in np.nonzero(near))))

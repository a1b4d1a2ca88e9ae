"""Near-dedup against the similarity of all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelspark.llm import near_dedup as N

from ..conftest import SF001


def brute(rows, k, percent=80):
    """id -> (set size, component) for rows with distinct ids."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, shared = defaultdict(list), Counter()
    for i in sorted(sets):
        for g in sets[i]:
            holders[g].append(i)
    for own in holders.values():
        for b in range(len(own)):
            for a in range(b):
                shared[own[a], own[b]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(x), find(i)) for i, x in sets.items()}


def family(rng, size, words=120, first=10**6):
    """Copies of one text with a different share of words changed in each, so links form chains and gaps."""
    text = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    rows = []
    for j in range(size):
        share = rng.choice([0.0, 0.005, 0.01, 0.02, 0.03, 0.05])
        rows.append((first + j, " ".join(f"x{rng.random()}" if rng.random() < share else w for w in text)))
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_components(spark, k):
    rng = random.Random(k)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()] + family(rng, 160)
    rows += [(-1, None), (-2, ""), (-3, "a b"), (-4, "A b"), (-5, "x"), (-6, "a  b"), (-7, "y " * 40_000)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, component_id string, half int").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs, shingle=k).collect()}
    assert got == brute(rows, k)
    left = N.keep_one(docs, shingle=k)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in got.items() if i == c)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(None, "x y z"), (None, "x y z"), (5, "p q r s t u v w"), (5, "p q r s t u v w"), (6, "p q r s t u v w"), (None, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in N.near_duplicates(docs).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("6", "5", False), ("7", "7", True), ("None", "None", True), ("None", "None", True), ("None", "None", True)]
    assert sorted(map(str, (tuple(r) for r in N.keep_one(docs).collect()))) == ["(5, 'p q r s t u v w')", "(7, None)", "(None, 'x y z')", "(None, None)"]
    assert N.keep_one(docs.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    nodes = spark.range(300)
    links = nodes.filter("id < 299 and id <> 150").selectExpr("id as x", "id + 1 as y")
    got = {r.id: r.component for r in N.components(nodes, links).collect()}
    assert got == {i: 0 if i <= 150 else 151 for i in range(300)}


def test_chance_of_a_shared_band_and_of_the_sketch():
    """Half keys and sketches of sets at similarity 0.8 behave as stated."""
    rng, pairs = np.random.default_rng(5), 400
    salt, odd = N._functions(2 * N.HALVES * N.MINHASHES)
    s2, o2 = N._functions(N.SKETCH, 78)
    equal = np.sqrt((1 + 0.8) / 2 * (1 - 0.9) * N.SKETCH)
    for _ in range(pairs):
        base = rng.integers(0, 1 << 63, 180, dtype=np.uint64)
        a, b = np.sort(base[:162]), np.sort(base[18:])  # 144 of 180 shared
        g, n = np.concatenate([a, b]), np.array([len(a), len(b)])
        same = (lambda m: m[0] == m[1])(N.minhashes(g, n, salt, odd).reshape(2, N.MINHASHES, -1, order="F")).all(axis=0)
        assert same[:N.HALVES].any() and same[N.HALVES:].any()
        bits = N.mix(N.minhashes(g, n, s2, o2)) & np.uint64(1)
        assert abs((bits[0] != bits[1]).sum() - 0.1 * N.SKETCH) < N.DEVIATIONS * equal


def test_template_family_costs_in_proportion(spark, monkeypatch):
    """Copies of a template just under the similarity: pairs that are looked at grow with the family, not with its square."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = [(i, " ".join(f"u{i}_{j}" if rng.random() < 0.0165 else w for j, w in enumerate(base))) for i in range(300)]
    looked = Counter()

    def counting(df, name, narrow=False, was=N.written):
        out = was(df, name, narrow)
        if name in ("pairs", "met"):
            looked[n] += out.count()
        return out

    monkeypatch.setattr(N, "written", counting)
    for n in (150, 300):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows[:n], "doc_id long, text string")).collect()}
        assert got == brute(rows[:n], 5)
    assert looked[300] < 3 * looked[150]


def test_prefixes_lose_no_similar_pair(spark):
    """Every pair of similar sets of different sizes shares a prefix shingle in the way the join asks for."""
    rng = random.Random(9)
    sets = [frozenset(rng.sample(range(40), rng.randint(1, 30))) for _ in range(60)]
    sets += [s ^ frozenset(rng.sample(range(60), rng.randint(1, 4))) for s in sets]
    sets = [s for s in sets if s]
    rows = [(i, i, i, len(s), np.array(sorted(s), np.int64).tobytes()) for i, s in enumerate(sets)]
    got = defaultdict(dict)
    for r in N.prefixes(spark.createDataFrame(rows, "rep long, component long, row long, n long, set binary"), 80).collect():
        got[r.rep][r.shingle] = r.short
    for x, a in enumerate(sets):
        for y, b in enumerate(sets):
            if x != y and len(a) >= len(b) and 100 * len(a & b) >= 80 * len(a | b):
                assert any(got[y].get(g) for g in got[x])

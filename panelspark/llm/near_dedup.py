"""Near-duplicate documents: MinHash with tensored banding, verified on full shingle sets.

Instead of one minhash per row of each band, two small collections of half keys are made, each
of a few minhashes; the band keys are all pairs of a half key of the first and one of the second
collection. 16 + 16 half keys of 3 minhashes (96 minhashes) stand for 256 bands of 6 rows (1536
minhashes). A pair of similarity s shares a band when it shares a half key on either side:
(1 - (1 - s^3)^16)^2, which is 0.99998 at 0.8.

1. Documents with the same shingle set form a class, known by the set's size and two 64-bit
   sums; the smallest id stands for it. All further steps see one row a class.
2. Half keys held by one class only are dropped; classes with live half keys on both sides get
   their band keys, and band keys held by one class only are dropped too.
3. Stars: each band pairs its members with its most central one (the one in the most bands) and the
   first by each of a few hashes. Pairs are verified and components grow by joins over the
   links. A group of mutual near copies costs a number of pairs in proportion to its size.
4. The rest: the members of bands that still hold several components. A hot band isn't paired member by
   member: its members meet on their rarest shingles (the prefix that similar sets must share, in the order of how
   many sets hold a shingle), and only where two components do. Documents from one template that are just
   not similar enough have enough shingles of their own to meet on none.

Before the full sets are compared, a sketch of SKETCH minhashes of one bit each leaves out pairs that
are more than five standard deviations below the similarity. Sets are shipped by blocks of a family
(classes with the same most central neighbour), once for all pairs of two blocks.

Nothing that grows with the corpus is collected; per-band and per-set figures are partial
aggregates, and joins with hot bands or classes have one row a key on the other side, so
adaptive execution can split them.

Defined cases: null or empty text has the empty set and is linked with nothing; a text of
fewer words than a shingle is one shingle; rows that share an id each get the component of their own
text, where an id that stands for several texts joins their components; a row without id takes the
component of the ids with the same set and is else alone, with a null component, and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import text_batches, written
from .words import LOWER, Words, gram_starts, grams, mix, steps

SHINGLE = 5
#: Least similarity, per cent.
SIMILARITY = 80
#: Half keys in each of the two collections, and minhashes to a half key.
HALVES, MINHASHES = 16, 3
#: One-bit minhashes in a sketch, 64 to a long, and deviations below the similarity from which on a pair is left out.
SKETCH, DEVIATIONS = 2048, 5.0
#: Hashes that pick a band's member for a star, after the most central one.
STARS = 1
#: Shingles of the classes in a block.
BLOCK = 1 << 16


def _functions(n: int, seed: int = 77) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes ascending within each text, number of each text) of the distinct k-word shingles."""
    w = Words(texts, LOWER)
    g, ok = grams(w.hash, k), gram_starts(w.ptr, k, len(w.hash))
    g, doc = g[ok], w.doc[:len(ok)][ok]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):  # the whole sequence is the one shingle
        h = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            here = w.count[short] > j
            h[here] = mix(h[here] * np.uint64(31) + w.hash[w.ptr[short[here]] + j])
        g, doc = np.concatenate([g, mix(h ^ w.count[short].astype(np.uint64))]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.bincount(doc[new], minlength=len(w.count))


def minhashes(g: np.ndarray, n: np.ndarray, salt: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Smallest value of each set under each function (sets x functions; 0 for empty sets), a few sets at a time."""
    out = np.zeros((len(n), len(salt)), dtype=np.uint64)
    end = np.cumsum(n)
    i = 0
    while i < len(n):
        begin = int(end[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(end, begin + 8192, side="right")))
        own = g[begin:int(end[j - 1])]
        has = np.flatnonzero(n[i:j] > 0)
        if len(has):
            first = (end[i:j] - n[i:j] - begin)[has]
            for f in range(len(salt)):
                out[i + has, f] = np.minimum.reduceat((own ^ salt[f]) * odd[f], first)
        i = j
    return out


def _signatures(k: int):
    salt, odd = _functions(2 * HALVES * MINHASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                g, n = shingle_sets(part.column(part.num_columns - 1), k)
                has = n > 0
                first = (np.cumsum(n) - n)[has]
                sums = np.zeros((2, len(n)), dtype=np.uint64)
                if len(g):
                    sums[0][has] = np.add.reduceat(mix(g), first)
                    sums[1][has] = np.add.reduceat(mix(g ^ np.uint64(0x5851F42D4C957F2D)), first)
                least = minhashes(g, n, salt, odd)
                halves = np.tile(np.arange(1, 2 * HALVES + 1, dtype=np.uint64), (len(n), 1))  # no half key of one place equals another's
                for j in range(MINHASHES):
                    halves = mix(halves ^ least[:, j::MINHASHES])
                keys = pa.FixedSizeListArray.from_arrays(pa.array(halves.view(np.int64).ravel()), 2 * HALVES)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(n), *(pa.array(s.view(np.int64)) for s in sums), keys.cast(pa.list_(pa.int64()))],
                    names=[*part.schema.names[:-1], "n_shingles", "sum_1", "sum_2", "halves"])

    return run


def _sets(k: int):
    salt, odd = _functions(SKETCH, 78)
    at = np.arange(64, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                g, n = shingle_sets(part.column(2), k)
                cut = np.concatenate([[0], np.cumsum(n)])
                bits = mix(minhashes(g, n, salt, odd)) & np.uint64(1)
                sketch = (bits.reshape(len(n), SKETCH // 64, 64) << at).sum(axis=2, dtype=np.uint64)
                sketch = pa.FixedSizeListArray.from_arrays(pa.array(sketch.view(np.int64).ravel()), SKETCH // 64).cast(pa.list_(pa.int64()))
                sets = pa.array([g[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), sketch, sets], names=["id", "block", "n", "sketch", "set"])

    return run


def _similar(percent: int):
    """Pairs of one unit whose full sets are similar enough."""

    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        own: dict = {}
        for i, x in zip(sets.column("id").to_pylist(), sets.column("set").to_pylist()):
            own.setdefault(i, []).append(np.frombuffer(x, np.uint64))  # an id may have several texts
        hit = []
        for x, y in zip(pairs.column("x").to_pylist(), pairs.column("y").to_pylist()):
            ok = False
            for a in own[x]:
                for b in own[y]:
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    ok |= 100 * both >= percent * (len(a) + len(b) - both)
            hit.append(ok)
        return pairs.select(["x", "y"]).filter(pa.array(hit, pa.bool_()))

    return run


def _shared(rows: DataFrame, key: str, member: str) -> DataFrame:
    """The rows whose key more than one member has."""
    keys = rows.groupBy(key).agg(F.min(member).alias("_lo"), F.max(member).alias("_hi")).filter("_lo < _hi").select(key)
    return rows.join(keys, key)


def _likely(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches of the rows (columns n, s0.. with these suffixes) allow the similarity."""
    fit = F.least(f"n{x}", f"n{y}") * 100 >= F.greatest(f"n{x}", f"n{y}") * percent  # else the union is too large
    equal = (1 + percent / 100) / 2  # of one-bit minhashes
    most = int(SKETCH * (1 - equal) + DEVIATIONS * (SKETCH * equal * (1 - equal)) ** 0.5)
    unequal = F.lit(0)
    for i in range(SKETCH // 64):
        unequal = unequal + F.bit_count(F.col(f"s{i}{x}").bitwiseXOR(F.col(f"s{i}{y}")))
    return fit & (unequal <= most)


def _longs(array: str, letter: str, n: int) -> list[Column]:
    """The array's longs as columns without nulls: a join condition over them stays small enough to be compiled."""
    return [F.coalesce(F.col(array)[i], F.lit(0).cast("long")).alias(f"{letter}{i}") for i in range(n)]


def _side(info: DataFrame, suffix: str) -> DataFrame:
    return info.select(*(F.col(c).alias(c + suffix) for c in info.columns))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y, block_x, block_y) whose full sets are similar enough: each two blocks' sets meet once."""
    units = pairs.select("x", "y", F.xxhash64(F.least("block_x", "block_y"), F.greatest("block_x", "block_y")).alias("unit"))
    need = units.select("unit", F.col("x").alias("id")).union(units.select("unit", F.col("y"))).distinct()
    met = need.join(sets.select("id", "set"), "id").groupBy("unit").cogroup(units.withColumnRenamed("unit", "of").groupBy("of"))
    return met.applyInArrow(_similar(percent), units.select("x", "y").schema)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) for every node: the smallest id reachable over the links (x, y).

    Each pass takes the smallest component among a node's neighbours and then its component's own
    component, so labels spread and shorten at once; it ends when a pass changes nothing.
    """
    both = written(links.select("x", "y").union(links.select(F.col("y"), F.col("x"))).distinct(), "links", narrow=True)
    label = written(nodes.select("id", F.col("id").alias("component")), "labels", narrow=True)
    while True:
        seen = both.join(label.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("component").alias("near"))
        lower = label.join(seen, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        lower = written(lower, "lower", narrow=True)
        up = lower.select(F.col("id").alias("component"), F.col("component").alias("above"))
        after = written(lower.join(up, "component", "left").select("id", "was", F.least("component", "above").alias("component")), "labels", narrow=True)
        label = after.select("id", "component")
        if after.filter("was <> component").isEmpty():
            return label


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components after the links (x, y): only those that a link joins to another take part."""
    x, y = (label.select(F.col("id").alias(c), F.col("component").alias(f"component_{c}")) for c in "xy")
    met = links.join(x, "x").join(y, "y").filter("component_x <> component_y")
    between = written(met.select(F.col("component_x").alias("x"), F.col("component_y").alias("y")).distinct(), "between", narrow=True)
    if between.isEmpty():
        return label
    joined = components(between.select(F.col("x").alias("id")).union(between.select("y")).distinct(), between)
    new = joined.select(F.col("id").alias("component"), F.col("component").alias("new"))
    return written(label.join(new, "component", "left").select("id", F.coalesce("new", "component").alias("component")), "labels", narrow=True)


def _open(bands: DataFrame, label: DataFrame) -> DataFrame:
    """(band, rep, component) of the bands with members of several components."""
    held = bands.join(label.withColumnRenamed("id", "rep"), "rep")
    several = held.groupBy("band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi").select("band")
    return held.join(several, "band").select("band", "rep", "component")


def _blocks(bands: DataFrame, central: DataFrame) -> DataFrame:
    """(id, block): classes by their most central neighbour, in blocks of about BLOCK shingles; small families share blocks."""
    rank = F.struct("degree", "rep")
    leads = bands.join(central, "rep").groupBy("band").agg(F.max(rank).alias("lead"))
    family = bands.join(leads, "band").groupBy("rep").agg(F.max("lead").alias("lead")).join(central, "rep").select(F.col("rep").alias("id"), F.col("lead.rep").alias("family"), "n_shingles")
    size = family.groupBy("family").agg(F.sum("n_shingles").alias("size"))
    small = (central.agg(F.sum("n_shingles")).first()[0] or 0) // BLOCK + 1
    part = F.when(F.col("size") > BLOCK, F.xxhash64("family", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)))).otherwise(F.pmod(F.xxhash64("family"), F.lit(small)))
    return family.join(size, "family").select("id", part.alias("block"))


def _stars(rows: DataFrame, info: DataFrame, weights: list[Column], percent: int) -> DataFrame:
    """(x, y, block_x, block_y): each band's rows of other components with its row of greatest weight, for each weight."""
    leads = rows.groupBy("band").agg(*(F.max_by(F.struct("rep", "component"), F.struct(w, F.col("rep"))).alias(f"lead_{i}") for i, w in enumerate(weights)))
    met = rows.join(leads, "band").select("rep", "component", F.explode(F.array(*(f"lead_{i}" for i in range(len(weights))))).alias("lead")).filter("component <> lead.component")
    return _sketched(met.select(F.least("rep", "lead.rep").alias("x"), F.greatest("rep", "lead.rep").alias("y")).distinct(), info, percent)


def _sketched(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that their sketches allow, with their blocks."""
    a, b = _side(info, "_x").withColumnRenamed("id_x", "x"), _side(info, "_y")
    return pairs.join(a, "x").join(b, (F.col("y") == F.col("id_y")) & _likely("_x", "_y", percent)).select("x", "y", "block_x", "block_y").distinct()


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per shingle of each set."""
    for batch in batches:
        for k in range(batch.num_rows):  # a set at a time: sets may be long
            own = batch.slice(k, 1)
            g = np.frombuffer(own.column(4)[0].as_py() or b"", np.int64)
            at = pa.array(np.zeros(len(g), np.int64))
            yield pa.RecordBatch.from_arrays([*(own.column(i).take(at) for i in range(4)), pa.array(g)], names=["rep", "component", "row", "n", "shingle"])


def prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """(shingle, rep, component, n, place, short) of the shingles over which similar sets of different components must meet.

    ``nodes``: rep, component, row (the set's number within its rep), n, set. A set's shingles are ordered by how many sets
    hold them, the rarest first. Of two similar sets the larger shares a shingle among its first
    ``n - percent of n + 1`` with the first ``n - 2 percent / (1 + percent) of n + 1`` (``short``) of the smaller.
    Shingles of one component only take their places but meet nothing.
    """
    kinds = dict(nodes.dtypes)
    held = nodes.mapInArrow(_exploded, f"rep {kinds['rep']}, component {kinds['component']}, row long, n long, shingle long")
    held = written(held, "shingles", narrow=True)
    often = held.groupBy("shingle").agg(F.count("*").alias("often"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    ranked = held.join(often.select("shingle", "often", (F.col("_lo") < F.col("_hi")).alias("several")), "shingle")
    place = F.dense_rank().over(Window.partitionBy("rep", "row").orderBy("often", "shingle"))  # repeated rows share their places
    ranked = ranked.withColumn("place", place.cast("long"))
    least = lambda of, parts: F.floor((F.col("n") * of + parts - 1) / parts)  # noqa: E731  (rounded up)
    long_, short = F.col("n") - least(percent, 100) + 1, F.col("n") - least(2 * percent, 100 + percent) + 1
    return ranked.filter(F.col("several") & (F.col("place") <= long_)).select("shingle", "rep", "component", "n", "place", (F.col("place") <= short).alias("short")).distinct()


def _rest(rows: DataFrame, sets: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """(x, y, block_x, block_y): all likely pairs of different components among the members of open bands."""
    nodes = rows.select("rep", "component").distinct()
    nodes = nodes.join(sets.select(F.col("id").alias("rep"), F.xxhash64("set").alias("row"), F.col("n").cast("long").alias("n"), "set"), "rep").select("rep", "component", "row", "n", "set")
    keyed = written(prefixes(nodes, percent), "prefixes", narrow=True)
    of = keyed.groupBy("shingle", "component").agg(F.count("*").alias("members")).groupBy("shingle").agg(F.max_by("component", F.struct("members", "component")).alias("main"))
    x = keyed.join(of, "shingle").filter("component <> main").select("shingle", *(F.col(c).alias(f"{c}_x") for c in keyed.columns[1:]))
    y = keyed.select(F.col("shingle").alias("shingle_y"), *(F.col(c).alias(f"{c}_y") for c in keyed.columns[1:]))
    larger = (F.col("n_x") >= F.col("n_y")) & F.col("short_y") | (F.col("n_y") >= F.col("n_x")) & F.col("short_x")
    fit = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    # what can be shared from the first common shingle on
    enough = (F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) + 1) * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent
    met = x.join(y, (F.col("shingle") == F.col("shingle_y")) & (F.col("component_x") != F.col("component_y")) & fit & larger & enough)
    pairs = written(met.select(F.least("rep_x", "rep_y").alias("x"), F.greatest("rep_x", "rep_y").alias("y")).distinct(), "met", narrow=True)
    return _sketched(pairs, info, percent)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """One row per input row: id, ``more``, n_shingles, component_id, kept (the id is its component's smallest)."""
    text_batches(docs.sparkSession)
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = dict(narrow.dtypes)["id"]
    marked = docs.select(docs[id_col].alias("id"), *more, docs[text_col].alias("text"))
    carried = marked.columns[1:-1]
    kinds = "".join(f"`{c}` {t}, " for c, t in marked.dtypes[:-1])
    marks = written(marked.mapInArrow(_signatures(shingle), f"{kinds}n_shingles long, sum_1 long, sum_2 long, halves array<long>"), "signatures")
    same = ["n_shingles", "sum_1", "sum_2"]
    classes = marks.filter("id is not null and n_shingles > 0").groupBy(same).agg(F.min("id").alias("rep"), F.first("halves").alias("halves"))
    classes = written(classes, "classes")
    halves = classes.select("rep", F.posexplode("halves").alias("side", "half")).select("rep", (F.col("side") < HALVES).alias("left"), "half")
    live = _shared(halves, "half", "rep").groupBy("rep").agg(
        F.collect_set(F.when(F.col("left"), F.col("half"))).alias("a"), F.collect_set(F.when(~F.col("left"), F.col("half"))).alias("b"))
    keys = live.select("rep", F.explode("a").alias("a"), "b").select("rep", "a", F.explode("b").alias("b"))
    bands = written(_shared(keys.select("rep", F.xxhash64("a", "b").alias("band")), "band", "rep"), "bands")

    central = bands.groupBy("rep").agg(F.count("*").alias("degree")).join(classes.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles")), "rep")
    blocks = written(_blocks(bands, central), "blocks", narrow=True)
    sets = narrow.join(blocks, "id").select("id", "block", "text").mapInArrow(_sets(shingle), f"id {kind}, block long, n long, sketch array<long>, set binary")
    sets = written(sets, "sets")
    info = sets.select("id", "block", F.coalesce("n", F.lit(0)).alias("n"), *_longs("sketch", "s", SKETCH // 64))
    label = blocks.select("id", F.col("id").alias("component"))
    hashes = [F.xxhash64(F.lit(i), F.col("rep")) for i in range(STARS)]
    for step in ("stars", "rest"):
        rows = written(_open(bands, label), "open", narrow=True)
        if step == "stars":
            pairs = _stars(rows.join(central, "rep"), info, [F.col("degree"), *hashes], similarity)
        else:
            pairs = _rest(rows, sets, info, similarity)
        label = _merged(label, written(_verified(written(pairs, "pairs", narrow=True), sets, similarity), "verified", narrow=True))

    of_rep = label.withColumnRenamed("id", "rep")
    of_class = classes.select(*same, "rep").join(of_rep, "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    out = marks.select("id", *carried, *same).join(of_class, same, "left").select("id", *carried, "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    return out.select(F.col("id").alias(id_col), *carried, "n_shingles", "component_id", kept)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each component, that with its smallest id, and all their columns.

    Of rows that share an id and a component, repeated rows among them, one stays.
    """
    names = ["_key_1", "_key_2"]
    while set(names) & set(docs.columns):
        names = [f"_{c}" for c in names]
    keys = [F.xxhash64(F.lit(i), docs[id_col], docs[text_col]).alias(c) for i, c in enumerate(names)]  # of id and text, null or not
    found = near_duplicates(docs, shingle, similarity, id_col, text_col, *keys).filter("kept")
    alone = F.when(F.col("component_id").isNull(), F.struct(*names))
    stay = found.groupBy(id_col, "component_id", alone).agg(F.min(F.struct(*names)).alias("k")).select("k.*").distinct()
    return docs.select("*", *keys).join(stay, names).dropDuplicates(names).select(*docs.columns)

"""Exact dedup by a content sort, in DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. Spark samples splitters over the order
(first HEAD characters, 64-bit hash, split) of the normalised texts and deals the rows out by range; every
range is sorted externally by the whole text, so equal texts are neighbours, and the window over the sorted rows
compares each text with its neighbour's in full. The hash only breaks ties of the splitters, whose sample
reaches the driver and so must stay short; no decision rests on it.

A text that more than 1 / (HOT_SHARE * partitions) of all rows hold would make one range too large. There are at most
HOT_SHARE * partitions of them, found by a count over hashes with partial sums before its shuffle; that list, bounded
whatever the data, is broadcast. A hot hash's rows are dealt out by a split number besides, each split gives one row with
its text, and those few rows (at most twice as many as the list, plus one for each partition) meet by the whole text.

Defined cases: null text is empty, and equal to empty texts; a null id is smaller than every other and kept only where
its group has no other; of rows that tie in text and id one stays, whichever; every input row is in the result once;
an empty table gives an empty result; other columns are never looked at by ``copies`` and kept as they are by ``keep_one``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import written

#: Characters of a text that the splitters are sampled over, and texts per partition that may count as hot.
HEAD, HOT_SHARE = 32, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def hot_hashes(hashes: DataFrame, partitions: int) -> DataFrame:
    """(hash, splits) of each value that over 1 / (HOT_SHARE * partitions) of the rows hold."""
    total = hashes.count()
    least = max(1, total // (HOT_SHARE * partitions))
    counts = hashes.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > least)
    return counts.select("hash", F.ceil(F.col("n") / (2 * least)).cast("int").alias("splits"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", row: Column | None = None) -> DataFrame:
    """One row per input row: id, keep_id (the id that stays of all rows with an equal text), group_size, kept,
    text_sha256; and the struct ``row`` if given. ``keep``: the ``smallest`` or ``largest`` id of a group stays."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pick, last = (F.max, F.col("id").isNotNull()) if keep == "largest" else (F.min, F.col("id").isNull())
    norm = normalised(docs[text_col])
    hot = hot_hashes(docs.select(F.xxhash64(norm).alias("hash")), partitions)
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(norm).alias("hash"), F.left(norm, F.lit(HEAD)).alias("head"),
                       row.alias("row") if row is not None else norm.alias("norm")).withColumn("nth", F.monotonically_increasing_id())
    # the hot list is bounded by HOT_SHARE * partitions rows
    rows = rows.join(F.broadcast(hot), "hash", "left").withColumn("split", F.when(F.col("splits") > 1, F.pmod(F.xxhash64("nth"), "splits")).otherwise(0).cast("int"))
    ranged = rows.repartitionByRange("head", "hash", "split")
    if row is not None:
        ranged = ranged.withColumn("norm", normalised(F.col("row").getField(text_col)))  # texts travel once
    # groups lie within a range, so the window needs no other shuffle; it sorts by the whole text and compares neighbours.
    # Only a group without other ids keeps a null one.
    group = Window.partitionBy("head", "hash", "split", "norm")
    rank = F.struct(last.alias("known"), F.col("id"), F.col("nth"))
    seen = ranged.withColumn("rank", rank).withColumns({"size": F.count("*").over(group), "best": pick("rank").over(group)}).withColumn("hot", F.coalesce(F.col("splits") > 1, F.lit(False)))
    split_text = F.when(F.col("hot") & (F.col("best.nth") == F.col("nth")), F.col("norm"))
    more = ["row"] if row is not None else []
    placed = written(seen.select("id", "nth", "size", "best", "hot", split_text.alias("text"), F.sha2("norm", 256).alias("text_sha256"), *more), "sorted")
    # one row for each split of a hot text: they meet by the whole text
    whole = placed.filter(F.col("text").isNotNull()).groupBy("text").agg(
        F.sum("size").alias("all_size"), pick("best").alias("all_best"), F.collect_list("nth").alias("parts"))
    whole = whole.select(F.explode("parts").alias("part"), "all_size", "all_best")
    joined = placed.withColumn("part", F.when(F.col("hot"), F.col("best.nth"))).join(F.broadcast(whole), "part", "left")
    best = F.coalesce("all_best", "best")
    return joined.select(F.col("id").alias(id_col), best["id"].alias("keep_id"), F.coalesce("all_size", "size").alias("group_size"),
                         (best["nth"] == F.col("nth")).alias("kept"), "text_sha256", *more)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay."""
    names = docs.columns
    found = copies(docs, id_col, text_col, keep, F.struct(*(docs[c] for c in names)))
    return found.filter("kept").select(*(F.col("row").getField(c).alias(c) for c in names))

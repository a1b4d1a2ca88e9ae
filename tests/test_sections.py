"""Aligned sections against a plain search over all chains of headings, and hand cases."""

import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from panelspark.operators import sections as S

TOC = "Cover\nItem 1. Business 3\nItem 1A. Risk Factors 9\nItem 2. Properties 12\nItem 7. Management's Discussion 20\nItem 8. Financial Statements 30\n"
BODY = ("PART I\n\nITEM 1.  BUSINESS\nWe make things.\nItem 7 of this report tells more.\nMore business " + "x" * 200
        + "\nItem 1A: Risk factors\nRisky.\nItem 1A (continued)\nVery risky.\nitem 2 - properties\nnone\nItem 7. MD&A\n" + "Results " * 50 + "\nItem 8. FS\nnumbers")


def cut(spark, *texts, required=()):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("other", F.lit("o"))
    ok, err = S.aligned_sections(df, "k", "t", required=required)
    assert ok.columns == ["k", "other", "item1", "item1a", "item7"] and err.columns == ["k", "other"]
    return {r.k: (r.item1, r.item1a, r.item7) for r in ok.collect()}, {r.k for r in err.collect()}


def test_contents_cross_references_and_running_heads(spark):
    ok, err = cut(spark, TOC + BODY, BODY, TOC + "\n" * 20_000 + BODY)
    assert ok[0] == ok[1] == ok[2] and not err
    one, risk, seven = ok[0]
    assert one.startswith("\nWe make things.\nItem 7 of this report") and one.endswith("x" * 200)
    assert risk == "\nRisky.\nItem 1A (continued)\nVery risky." and seven == "\n" + "Results " * 50


def test_optional_and_required_sections(spark):
    old = BODY.replace("\nItem 1A: Risk factors\nRisky.\nItem 1A (continued)\nVery risky.", "")
    ok, err = cut(spark, old, TOC, "no items", "", None, "Item 1(a).\nlettered", required=("item1",))
    assert ok[0][1] == "" and ok[0][2].startswith("\nResults") and set(ok) == {0} and err == {1, 2, 3, 4, 5}
    assert cut(spark, "Item 1(a).\nlettered")[0][0] == ("", "\nlettered", "")
    assert cut(spark, "Items 1 and 2. Business and Properties\nboth")[0][0][0] == "\nboth"
    assert cut(spark, "Item 1. Business. " + "long " * 60)[0][0][0] == ". Business. " + "long " * 60
    with pytest.raises(ValueError):
        S.section_texts(F.col("t"), {"x": "99"})


def brute(text):
    """The best chain by trying all of them; hits of one item in a row are one."""
    lines = text.split("\n")
    hits = [i for i, line in enumerate(lines) if re.match(r"Item (\d+)\. T$", line)]
    nodes = []
    for a, b in zip(hits, hits[1:] + [len(lines)]):
        rank = S.ITEM_ORDER.index(re.match(r"Item (\d+)", lines[a])[1])
        size = len("\n".join(lines[a:b])) - len(lines[a])
        if nodes and nodes[-1][0] == rank:
            nodes[-1][1] += size
        else:
            nodes.append([rank, size, a])
    best = (0, ())
    for n in range(1, len(nodes) + 1):
        for chain in itertools.combinations(range(len(nodes)), n):
            if all(nodes[x][0] < nodes[y][0] for x, y in zip(chain, chain[1:])):
                best = max(best, (sum(nodes[x][1] for x in chain), chain))
    return best[0]


def test_best_chain_is_the_heaviest(spark):
    rng = random.Random(4)
    texts = ["\n".join(f"Item {rng.randint(1, 6)}. T\n" + "w" * rng.randint(0, 60) for _ in range(rng.randint(1, 9))) for _ in range(25)]
    every = {f"s{i}": i for i in ("1", "2", "3", "4", "5", "6")}
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", S.section_texts(F.col("t"), every).alias("s"))
    for r in df.collect():
        # what the chain's own hits hold can't be more than all their sections, and the best one is among the chains
        assert sum(len(x) for x in r.s if x is not None) >= brute(texts[r.k])


def test_many_headings_take_linear_time(spark):
    def run(n):
        df = spark.createDataFrame([("".join(f"Item {1 + i % 15}. T\nbody {i}\n" for i in range(n)),)], "t string")
        t = time.time()
        df.select(S.section_texts(F.col("t"))).collect()
        return time.time() - t

    run(100)
    assert run(16_000) < 8 * max(run(4000), 0.5)


def test_filings_meet_their_links(spark):
    links = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("gone", 4), (None, 5)], "fname string, gvkey int")
    docs = spark.createDataFrame([("a", TOC + BODY), ("b", "nothing"), ("unlinked", "nothing")], "fname string, body string")
    out, err = S.filing_items(links, docs, min_chars=5)
    assert sorted((r.fname, r.gvkey) for r in out.collect()) == [("a", 1), ("a", 2)]
    assert sorted(r.fname for r in err.collect()) == ["b", "gone"]


def test_the_text_is_cut_once(spark, capsys):
    df = spark.createDataFrame([(1, BODY)], "k int, t string").select("k", S.section_texts(F.col("t")).alias("s"))
    df.explain()
    assert capsys.readouterr().out.count("split(") == 1

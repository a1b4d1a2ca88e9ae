"""Learned sentence ends on prose with known abbreviations."""

import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import sentences as S
from panelspark.operators.text import chunk_docs

from .conftest import SF001


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(1)
    who = ["The firm", "Sales", "We", "It", "Growth", "The board", "Costs"]
    did = ["rose in the U.S. market", "was led by J. K. Rowe", "agreed with Acme Inc. on terms", "paid Mr. Smith well", "saw No. 5 win", "fell vs. last year"]
    did += [f"{v} the {n}" for v in ("paid", "saw", "left", "met", "sold") for n in ("agent", "market", "firm", "board", "year", "lot", "win", "terms", "well", "more")]
    rows = [(i, " ".join(f"{rng.choice(who)} {rng.choice(did)}{rng.choice('....!?')}" if rng.random() < .9 else f"No market in the year and no firm or board, agent, lot, win or terms; more well." for _ in range(30))) for i in range(400)]
    return spark.createDataFrame(rows + [(-1, None), (-2, ""), (-3, "  ")], "k int, t string").repartition(5)


@pytest.fixture(scope="module")
def ends(prose):
    return S.learn_sentence_ends(prose, "t")


def split(spark, ends, text):
    return spark.createDataFrame([(text,)], "t string").select(S.sentence_array(F.col("t"), ends).alias("s")).first().s


def test_learned_lists(ends):
    assert {"u.s", "inc", "mr", "vs"} <= set(ends.abbreviations)
    assert not {"market", "firm", "year", "no", "agent"} & set(ends.abbreviations)
    assert {"the", "we", "it", "sales"} <= set(ends.starters)
    assert "no ##" in ends.together


def test_short_forms_do_not_end_sentences(spark, ends):
    text = "Sales rose in the U.S. market. The firm was led by J. K. Rowe. We agreed with Acme Inc. on terms! It saw No. 5 win. Mr. Smith left."
    assert split(spark, ends, text) == ["Sales rose in the U.S. market.", "The firm was led by J. K. Rowe.", "We agreed with Acme Inc. on terms!", "It saw No. 5 win.", "Mr. Smith left."]
    # a starter with a capital shows the end behind a short form
    assert split(spark, ends, "We sold it to Acme Inc. The board met.") == ["We sold it to Acme Inc.", "The board met."]


def test_other_ends(spark, ends):
    assert split(spark, ends, 'He said "No!" Then so... on. So... The end') == ['He said "No!"', "Then so... on.", "So...", "The end"]
    assert split(spark, ends, "") == [""] and split(spark, ends, "no end") == ["no end"]
    assert split(spark, ends, None) is None
    assert split(spark, S.SentenceEnds(), "A fox.\tB fox? C") == ["A fox.", "B fox?", "C"]


def test_no_character_is_lost(spark, ends, prose):
    got = prose.where("t is not null").select("t", F.array_join(S.sentence_array(F.col("t"), ends), " ").alias("joined"))
    assert got.where(F.col("t") != F.col("joined")).count() == 0


def test_counts_do_not_depend_on_partitions(prose, ends):
    assert S.learn_sentence_ends(prose.repartition(1), "t") == ends


def test_empty_corpus(spark, prose):
    assert S.learn_sentence_ends(prose.limit(0), "t") == S.SentenceEnds()


def test_chunks_take_learned_ends(spark, ends):
    df = spark.createDataFrame([(1, "We met Mr. Smith in the U.S. market. It fell.\nshort. one")], "k int, t string")
    assert [r.chunk for r in chunk_docs(df, "k", "t", cap=20, ends=ends).orderBy("chunk_no").collect()] == ["We met Mr. Smith in the U.S. market.", "It fell.", "short. one"]
    assert [r.chunk for r in chunk_docs(df, "k", "t", cap=20).orderBy("chunk_no").collect()][:2] == ["We met Mr.", "Smith in the U.S."]


def test_texts_are_split_into_words_once(spark, prose, capsys):
    """Not once for each use of the words in the pairs."""
    S.token_counts(prose, "t").explain()
    plan = capsys.readouterr().out
    assert max(line.count("split(") for line in plan.splitlines()) == 1


def test_token_counts_of_pairs(spark):
    df = spark.createDataFrame([("Mr. (Smith) paid 5. -- \" ok. \" Then",), ("",), (None,), ("end.",)], "t string")
    got = sorted((r.type, r.dotted, r.follow, r.capital, r.n) for r in S.token_counts(df.repartition(2), "t").na.fill("-", ["follow"]).collect())
    assert got == [("##", True, "--", False, 1), ("--", False, "-", None, 1), ("end", True, "-", None, 1), ("mr", True, "smith", True, 1), ("ok", True, "-", None, 1),
                   ("paid", False, "-", None, 1), ("smith", False, "-", None, 1), ("then", False, "-", None, 1)]


def test_scores_read_the_texts_once(spark, monkeypatch):
    from panelspark.plans import catalog_scale

    seen = []
    abbreviations = S.abbreviations
    monkeypatch.setattr(catalog_scale.sentences, "abbreviations", lambda counts: seen.append(counts) or abbreviations(counts))
    catalog_scale.q_abbreviation_scores(spark, SF001)
    assert "documents" not in seen[0].inputFiles()[0]


def by_places(df, ends):
    rows = S.materialize(df.withColumn("row", F.monotonically_increasing_id()))
    return S.open_ends(rows, "row", "t", ends, "open").select("k", "t", S.sentence_array(F.col("t"), F.col("open")).alias("s"))


@pytest.fixture(scope="module")
def odd(spark):
    """Odd ends, white space and repeated rows."""
    rng = random.Random(2)
    tokens = ["Mr.", "mr.", "J.", "5.", "12", "No.", "(The", "the", "The.", '"So."', "so..", "So...", "!", "?)", ".", '."', ".)", '"', "a.b.", "Inc.,", 'Inc."', "x.\")", "É.", "x" * 100 + ".", "y" * 90, "1" * 90 + "."]
    blank = [" ", "  ", "\n", "\t  ", " " * 90]
    rows = [(i % 250, "".join(rng.choice(tokens) + rng.choice(blank) for _ in range(rng.randrange(25))).strip(" " if i % 3 else None)) for i in range(300)]
    return spark.createDataFrame([*rows, *rows[:20], (None, "No. 5. Then"), (None, "No. 5. Then"), (1, None), (2, "")], "k int, t string").repartition(4)


@pytest.mark.parametrize("size", [0, 3, 5000])
def test_lists_and_tables_are_whole(spark, prose, odd, ends, monkeypatch, size):
    """No entry is left out, whatever goes to the tasks, and texts meet the tables as they would the lists."""
    monkeypatch.setattr(S, "LIST_SIZE", size)
    assert S.learn_sentence_ends(prose, "t") == ends and len(ends.starters) > 1
    df = prose.unionByName(odd)
    learnt = S.learn_sentence_ends(df, "t")
    key = lambda r: (str(r.k), str(r.t))
    want = sorted(df.select("k", "t", S.sentence_array(F.col("t"), learnt).alias("s")).collect(), key=key)
    assert sorted(by_places(df, learnt).collect(), key=key) == want
    assert any(r.s and len(r.s) > 5 for r in want) and {"mr", "inc"} <= set(learnt.abbreviations)


def test_long_words_are_read_whole(spark):
    word, number = "x" * 100, "1" * 90
    ends = S.SentenceEnds((word,), ("the",), (f"{word} ##", f"a{'b' * 99} ##"))
    assert split(spark, ends, f"{word}. {number} a. {word}. Then") == [f"{word}. {number} a. {word}. Then"]
    assert split(spark, ends, f"A{'b' * 99}. {number}. b{'b' * 99}. {number}{' ' * 90}c") == [f"A{'b' * 99}. {number}.", f"b{'b' * 99}.", f"{number}{' ' * 90}c"]


def test_texts_are_dealt_out_and_stay_where_they_lie(spark, monkeypatch, capsys):
    """One file isn't one task, and the places meet the texts without another shuffle of these."""
    from panelspark.plans import catalog_scale

    seen, learn = [], S.learn_sentence_ends
    monkeypatch.setattr(catalog_scale.sentences, "learn_sentence_ends", lambda df, t: seen.append(df) or learn(df, t))
    out = catalog_scale.q_sentence_ends(spark, SF001)
    files = seen[0].inputFiles()
    assert len(files) > 4 and "documents" not in files[0]
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(row") <= 1 and "SortMergeJoin [row" in plan and "Bucketed: true" in plan
    keys = seen[0].select("row")
    assert keys.distinct().count() == keys.count() == spark.read.parquet(f"{SF001}/documents.parquet").where("text is not null").count()

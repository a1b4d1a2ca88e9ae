"""Sentence ends learned from the corpus.

A period ends a sentence or an abbreviation. Which words are abbreviations, which words start sentences and
which pairs belong together across a period is learned from counts over the whole corpus, without labels, by the
log-likelihood tests of Kiss and Strunk (Unsupervised Multilingual Sentence Boundary Detection, 2006). The counts are one
aggregate with partial sums. What is learned from them are three tables, each as long as it is; a table of the periods that end
no sentence is made from them, which texts meet in a join. As lists they steer a native split of any text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .text import WS, WS_CHARS

# Thresholds of the published method: of abbreviations, of pairs that belong together, of sentence starters.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Most rows of a learned table that goes to every task; longer ones meet others in merge joins.
LIST_SIZE = 5000
NUMBER = "##"
#: Punctuation around a word that isn't part of it.
OPENERS, CLOSERS = "\"'([{“‘«¿¡", "\"')]}”’»,;:"
#: White space; most characters are ruled out by one test.
BLANK = f"(?![!-~]){WS}"
#: How a token ends behind which a sentence may end.
END = r"[.!?][\"')\]”’»]?"
#: A noncharacter; no text holds it.
_MARK = "﷐"


class SentenceEnds:
    """Word types (lower case, without the last period) that are abbreviations, words that start sentences, and
    "word next" pairs that a period doesn't part. Each is given as a tuple, or as a table whose only column is collected
    when the list is asked for. ``going_on``: (type, follow, capital) of the periods of the texts learned from that end no sentence."""

    def __init__(self, abbreviations: tuple[str, ...] | DataFrame = (), starters: tuple[str, ...] | DataFrame = (), together: tuple[str, ...] | DataFrame = (),
                 going_on: DataFrame | None = None):
        self.given = (abbreviations, starters, together)
        self.going_on = going_on

    @cached_property
    def _lists(self) -> tuple[tuple[str, ...], ...]:
        return tuple(tuple(sorted(r[0] for r in x.collect())) if isinstance(x, DataFrame) else tuple(x) for x in self.given)

    abbreviations = property(lambda self: self._lists[0])
    starters = property(lambda self: self._lists[1])
    together = property(lambda self: self._lists[2])

    def __eq__(self, other: object) -> bool:
        return isinstance(other, SentenceEnds) and self._lists == other._lists

    def __hash__(self) -> int:
        return hash(self._lists)


def _word(token: Column) -> Column:
    """The token without punctuation around it."""
    return F.rtrim(F.ltrim(token, F.lit(OPENERS)), F.lit(CLOSERS))


def _type(word: Column) -> Column:
    """Lower case without the last period; numbers are all one type."""
    bare = F.when(word.endswith("."), F.left(word, F.length(word) - 1)).otherwise(word)
    return F.when(F.rlike(bare, F.lit("^[0-9][0-9.,]*$")), F.lit(NUMBER)).otherwise(F.lower(bare))


def _capital(word: Column) -> Column:
    return F.rlike(word, F.lit(r"^\p{Lu}"))


def _pairs(text: Column, made) -> Column:
    """What is made of each token of a text and the next one (null behind the last). The first and last are empty where the
    text has white space there."""
    # bound once: a name used twice in a plan is worked out twice, the whole text with it
    paired = lambda ts: F.transform(ts, lambda t, i: made(t, F.get(ts, i + 1)))
    return F.transform(F.array(F.split(text, f"(?:{BLANK})+", -1)), paired)[0]


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """(type, dotted, follow, capital, n): the word types of all texts, whether a period is at their end, and behind a
    period the next word's type in the text and whether it has a capital."""
    pairs = _pairs(F.col(text), lambda t, nxt: F.struct(t.alias("token"), F.when(F.contains(t, F.lit(".")), nxt).alias("next")))
    # tokens are counted as they stand, words and types are made of the different ones only
    raw = df.select(F.inline(pairs)).groupBy("token", "next").agg(F.count("*").alias("n"))
    rows = raw.select(_word(F.col("token")).alias("word"), _word(F.col("next")).alias("next"), "n").where(F.length("word") > 0)
    dotted = F.col("word").endswith(".") & ~F.col("word").endswith("..")
    follow = F.when(dotted & (F.length("next") > 0), F.col("next"))
    seen = rows.select(_type(F.col("word")).alias("type"), dotted.alias("dotted"), _type(follow).alias("follow"), _capital(follow).alias("capital"), "n")
    return seen.groupBy("type", "dotted", "follow", "capital").agg(F.sum("n").alias("n"))


def type_counts(counts: DataFrame) -> DataFrame:
    """(type, n, n_dotted): how often a word type comes, and how often a period follows it."""
    return counts.groupBy("type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("dotted"), F.col("n")).otherwise(0)).alias("n_dotted"))


def _lean(hits: Column, of: Column, share: Column) -> Column:
    """Log-likelihood of ``hits`` among ``of`` where each has the chance ``share``; 0 * log(0) is 0."""
    part = lambda k, p: F.when(k > 0, k * F.log(F.greatest(p, F.lit(1e-300)))).otherwise(0.0)
    return part(hits, share) + part(of - hits, 1 - share)


def abbreviations(counts: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(type, n, n_dotted, score) of every type with a letter that a period follows at least once. ``types``: ``type_counts`` of
    the counts, where they are at hand."""
    whole = counts.agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("dotted"), F.col("n")).otherwise(0)).alias("dots"))
    types = type_counts(counts) if types is None else types
    tokens, dots = (whole.select(c).scalar() for c in ("tokens", "dots"))
    n, hits, share = F.col("n").cast("double"), F.col("n_dotted").cast("double"), dots / tokens
    ratio = -2 * (_lean(hits, n, share) - _lean(hits, n, F.lit(0.99)))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.length("type") - inner).cast("double")
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -(n - hits))
    return types.where((F.col("n_dotted") > 0) & F.rlike("type", F.lit(r"\p{L}"))).select("type", "n", "n_dotted", score.alias("score"))


def _joint(a: Column, b: Column, both: Column, tokens: Column) -> Column:
    """Log-likelihood ratio of ``both`` among a and b of all tokens being more than chance; 0 where it is less."""
    p, p1, p2 = b / tokens, both / a, (b - both) / (tokens - a)
    ratio = -2 * (_lean(both, a, p) + _lean(b - both, tokens - a, p) - _lean(both, a, p1) - _lean(b - both, tokens - a, p2))
    return F.when(tokens * both > a * b, ratio).otherwise(0.0)


def _met(table: DataFrame) -> DataFrame:
    """A written table as the side of a join that the other rows meet: broadcast if it is short. Its planned size is that of
    its compressed file and says little."""
    return F.broadcast(table) if table.count() <= LIST_SIZE else table.hint("merge")


def learn_sentence_ends(df: DataFrame, text: str) -> SentenceEnds:
    """What is learned from all texts, whole. Empty corpora give empty lists; null texts have no words."""
    counts = materialize(token_counts(df, text))
    types = materialize(type_counts(counts))
    short = materialize(abbreviations(counts, types).where(F.col("score") >= ABBREVIATION).select("type"))
    periods = counts.where("dotted").join(_met(short.withColumn("short", F.lit(True))), "type", "left")
    periods = materialize(periods.select("type", "follow", "capital", "n", F.col("short").isNotNull().alias("short")))
    first = materialize(starters(periods, types).where(F.col("score") >= STARTER).select("type"))
    tied = materialize(together(periods, types, first).where(F.col("score") >= COLLOCATION).select("type", "follow"))
    return SentenceEnds(short, first, tied.select(F.concat_ws(" ", "type", "follow")), materialize(going_on(periods, first, tied)))


def _initial(kind: Column) -> Column:
    return F.rlike(kind, F.lit(r"^\p{L}$"))


def _is_short() -> Column:
    return F.col("short") | (F.col("type") == NUMBER) | _initial(F.col("type"))


def starters(periods: DataFrame, types: DataFrame) -> DataFrame:
    """(type, score) of words with a capital behind a period that ends a sentence for sure."""
    ends = periods.where(~_is_short())
    all_ends, tokens = (x.agg(F.sum("n").alias("x")).scalar().cast("double") for x in (ends, types))
    after = ends.where(F.col("capital")).groupBy(F.col("follow").alias("type")).agg(F.sum("n").alias("after"))
    both, n = F.col("after").cast("double"), F.col("n").cast("double")
    return after.join(types.hint("merge"), "type").where(F.rlike("type", F.lit(r"\p{L}"))).select("type", _joint(all_ends, n, both, tokens).alias("score"))


def together(periods: DataFrame, types: DataFrame, first: DataFrame) -> DataFrame:
    """(type, follow, score) of words with a period and the next word: short forms and any next word but a starter, and any word
    before a number."""
    pairs = periods.where(F.col("follow").isNotNull() & (_is_short() | (F.col("follow") == NUMBER))).groupBy("type", "follow").agg(F.sum("n").alias("both"))
    pairs = pairs.join(_met(first.select(F.col("type").alias("follow"))), "follow", "left_anti")
    tokens = types.agg(F.sum("n").alias("x")).scalar().cast("double")
    joined = pairs.join(types.select("type", F.col("n").alias("n_type")).hint("merge"), "type")
    joined = joined.join(types.select(F.col("type").alias("follow"), F.col("n").alias("n_follow")).hint("merge"), "follow")
    score = _joint(F.col("n_type").cast("double"), F.col("n_follow").cast("double"), F.col("both").cast("double"), tokens)
    return joined.select("type", "follow", score.alias("score"))


def going_on(periods: DataFrame, first: DataFrame, tied: DataFrame) -> DataFrame:
    """(type, follow, capital) of the periods that end no sentence; ``follow`` is empty where no word is next. All others but
    those behind short forms and before numbers end one."""
    near = periods.select("type", F.coalesce("follow", F.lit("")).alias("follow"), F.coalesce("capital", F.lit(False)).alias("capital"), "short")
    near = near.where(_is_short() | (F.col("follow") == NUMBER)).distinct()
    near = near.join(_met(first.select(F.col("type").alias("follow"), F.lit(True).alias("first"))), "follow", "left")
    near = near.join(_met(tied.withColumn("tied", F.lit(True))), ["type", "follow"], "left")
    opens = (F.col("short") | _initial(F.col("type"))) & ~(F.col("capital") & F.col("first").isNotNull())
    return near.where(opens | F.col("tied").isNotNull()).select("type", "follow", "capital")


def _places(text: Column) -> Column:
    """(word, next) at each white space where a sentence may end. Both are whole tokens still."""
    pairs = _pairs(text, lambda t, nxt: F.struct(t.alias("word"), nxt.alias("next")))
    return F.filter(pairs, lambda x: x["next"].isNotNull() & F.rlike(x["word"], F.lit(rf"{END}\z")))


def open_ends(df: DataFrame, row: str, text: str, ends: SentenceEnds, name: str) -> DataFrame:
    """``df`` and a column ``name``: the places (0, 1, ...) among those where a sentence may end, in order, at which none
    does. Null: there are none. ``row`` is another value in each row and the same whenever it is read, best in buckets; ``ends`` are learned from the same texts."""
    places = df.select(row, F.posexplode(_places(F.col(text))).alias("place", "x")).select(row, "place", _word(F.col("x.word")).alias("word"), _word(F.col("x.next")).alias("next"))
    places = places.where(F.col("word").endswith("."))
    places = places.select(row, "place", _type(F.col("word")).alias("type"), _type(F.col("next")).alias("follow"), _capital(F.col("next")).alias("capital"), F.col("word").endswith("..").alias("dots"))
    places = places.where(~(F.col("dots") & F.col("capital")))
    short = ends.given[0]
    if short.count() <= LIST_SIZE:  # all but those of ``going_on`` can be left out before the join
        places = places.join(F.broadcast(short.withColumn("short", F.lit(True))), "type", "left")
        places = places.where(F.col("dots") | F.coalesce("short", F.lit(False)) | (F.col("type") == NUMBER) | _initial(F.col("type")) | (F.col("follow") == NUMBER))
    found = places.join(_met(ends.going_on.withColumn("goes_on", F.lit(True))), ["type", "follow", "capital"], "left")
    found = found.where(F.col("dots") | F.col("goes_on").isNotNull())
    found = found.groupBy(row).agg(F.sort_array(F.collect_list("place")).alias(name))
    return df.join(found.hint("merge"), row, "left")


def sentence_array(paragraph: Column, ends: SentenceEnds | Column) -> Column:
    """The sentences of a text, in order, without the white space between them.

    A ``!`` or ``?``, with closing quotes or brackets behind it, ends a sentence before white space. A period does unless the
    word before it is an abbreviation, an initial or a number that the next word goes with: the next word has no capital or isn't a known
    starter, or the pair belongs together. Three dots end one only before a capital. ``ends``: lists, which go to every task, or the column
    of ``open_ends``, which has been worked out from tables of any length.
    """

    def goes_on(x: Column) -> Column:
        word, nxt = x["word"], x["next"]
        kind, follow, capital = _type(word), _type(nxt), _capital(nxt)
        pair = F.concat_ws(" ", kind, follow).isin(list(ends.together))
        bound = F.when(kind.isin(list(ends.abbreviations)) | _initial(kind), ~(capital & follow.isin(list(ends.starters))) | pair).otherwise(pair)
        return word.endswith(".") & F.when(word.endswith(".."), ~capital).otherwise(bound)

    def marked(x: Column) -> Column:
        piece = lambda p, i: F.when(F.coalesce(F.get(x["open"], i), F.lit(False)), p).otherwise(F.concat(p, F.lit(_MARK)))
        last = F.element_at(x["pieces"], -1)
        return F.split(F.concat(F.array_join(F.transform(F.slice(x["pieces"], 1, F.size(x["pieces"]) - 1), piece), ""), last), _MARK, -1)

    if isinstance(ends, Column):
        # a flag a place up to the last open one: a search for each place would take the square of their number
        upto = lambda at, i: F.concat(F.array_repeat(F.lit(False), at - F.coalesce(F.get(ends, i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))
        flags = F.flatten(F.transform(ends, upto))
    else:
        words = F.transform(_places(paragraph), lambda x: F.struct(_word(x["word"]).alias("word"), _word(x["next"]).alias("next")))
        flags = F.transform(words, goes_on)
    pieces = F.split(paragraph, rf"(?<={END})(?={WS})", -1)
    whole = F.transform(F.array(F.struct(pieces.alias("pieces"), flags.alias("open"))), marked)[0]
    return F.transform(whole, lambda s, i: F.when(i > 0, F.ltrim(s, F.lit(WS_CHARS))).otherwise(s))

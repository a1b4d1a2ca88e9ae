"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base spans come from three patterns (``KINDS``). Beyond them, long opaque runs are candidates: 20 or
more characters of a key alphabet with a digit, a letter and at least DISTINCT different characters,
outside every base span. The value of every span and candidate is hashed, and over the whole corpus
each hash gets its number of distinct repositories and of distinct owners. A value that WIDE or more
owners hold is a widely copied example; one with fewer owners is specific to them and, if it has the
look of a random key, live-looking. Live-looking candidates are added as spans of kind ``key``;
widely copied ones are not. Base spans always stay.

The counts are three nested aggregates - (hash, owner, repository), (hash, owner), hash - each
with partial sums before its shuffle, so a value that a third of all documents hold is
one row a task at each.

Offsets are code points, ends exclusive. A pattern's matches and the pieces between them give the
offsets by adding up lengths.

Defined cases: null text is empty; a null owner or repository is one owner or repository of its own;
repeated rows of a repository count once in frequencies and each get their spans; other columns
are never looked at by the scan and kept as they are by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import written

#: Kind -> (pattern, group that holds the value, fewest characters of it). ASCII letter case only.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ that are long enough
}
#: Candidates: runs of the key alphabet.
CANDIDATE = ("key", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", 0, 20)
DISTINCT = 10
#: Owners from which on a value is a widely copied example.
WIDE = 3
MARK = "[REDACTED]"
#: Matches of a text that are looked at together.
PART = 128

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the value, which is computed once however often ``then`` uses it, inside lambdas too."""
    return F.transform(F.array(value), then)[0]


def _cut(items: Column) -> Column:
    """The array in arrays of at most PART elements (one, empty, for an empty array)."""
    places = lambda i: F.sequence(F.lit(0), F.greatest(F.size(i) - 1, F.lit(0)), F.lit(PART))
    return _bound(items, lambda i: F.transform(places(i), lambda at: F.slice(i, at + 1, PART)))


def _located(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind, in order."""
    rows = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    length = lambda x: F.length(x["piece"]) + F.coalesce(F.length(x["whole"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + F.length(x["piece"]), acc["at"] + length(x)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def spans(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda acc: acc["out"])

    def begins(parts: Column) -> Column:
        # where each part begins: a list grows by one element a part, not by one a match
        def add(acc: Column, part: Column) -> Column:
            return F.struct((acc["at"] + F.aggregate(part, F.lit(0), lambda n, x: n + length(x))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add, lambda acc: acc["out"])

    located = _bound(_cut(rows), lambda parts: F.flatten(F.zip_with(parts, begins(parts), spans)))
    return F.when(F.rlike(text, F.lit(pattern)), located).otherwise(F.array().cast(_SPAN))


def _random_look(value: Column) -> Column:
    return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT)


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``_base`` and ``_keys``: base spans and, outside of them, candidate spans."""
    text = F.coalesce(docs[text_col], F.lit(""))
    base = F.array_sort(F.concat(*(_located(text, i, kind, *how) for i, (kind, how) in enumerate(KINDS.items()))))
    keys = F.filter(_located(text, len(KINDS), *CANDIDATE), lambda k: _random_look(k["value"]))
    found = docs.withColumn("_base", base).withColumn("_keys", keys)
    meets = lambda a, b: (a["start"] < b["end"]) & (a["end"] > b["start"])
    parts = F.transform(_cut(F.col("_base")), lambda p: F.struct(
        F.array_min(F.transform(p, lambda b: b["start"])).alias("start"), F.array_max(F.transform(p, lambda b: b["end"])).alias("end"), p.alias("spans")))
    near = lambda k, ps: F.exists(ps, lambda p: F.when(meets(p, k), F.exists(p["spans"], lambda b: meets(b, k))).otherwise(False))
    clear = _bound(parts, lambda ps: F.filter("_keys", lambda k: ~near(k, ps)))
    return found.withColumn("_keys", F.when((F.size("_base") > 0) & (F.size("_keys") > 0), clear).otherwise(F.col("_keys")))


def ownership(values: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) from rows of (hash, owner, repo); a repository belongs to the owner it is seen with."""
    repos = values.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))


def judged(found: DataFrame) -> DataFrame:
    """(row, spans) from rows of (row, owner, repo, _base, _keys): base spans and live-looking candidates, in order,
    each with its value's n_owners and n_repos."""
    spans = found.select("row", "owner", "repo", F.inline(F.concat("_base", "_keys"))).withColumn("hash", F.sha2("value", 256))
    look = spans.join(ownership(spans.select("hash", "owner", "repo")), "hash").withColumn("live", (F.col("n_owners") < WIDE) & _random_look(F.col("value")))
    kept = look.filter((F.col("rank") < len(KINDS)) | F.col("live"))
    return kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "hash", "n_owners", "n_repos", "live"))).alias("spans"))


def scan(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and its spans, an array of (start, rank, end, kind, hash, n_owners, n_repos, live)."""
    narrow = docs.select(docs[id_col].alias("id"), docs[owner_col].alias("owner"), docs[repo_col].alias("repo"), docs[text_col].alias("text"))
    found = written(with_spans(narrow).select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repo", "_base", "_keys"), "candidates")
    out = found.select("row", "id").join(judged(found), "row", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("spans", F.array().cast(dict(out.dtypes)["spans"])).alias("spans"))


def written_out(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _redacted(text: Column, spans: Column) -> Column:
    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]  # else it overlaps what is already marked
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(acc["out"], before, F.lit(MARK))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with every span (overlapping ones as one) replaced by MARK in the text.

    The scanned rows are written once. Only those with spans or candidates wait for the corpus-wide counts; the others
    never meet a shuffle.
    """
    names = docs.columns
    found = with_spans(docs.select(F.struct(*names).alias("doc"), docs[text_col].alias("_text")), "_text")
    text = F.coalesce("_text", F.lit(""))
    any_span = F.size("_base") + F.size("_keys") > 0
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "candidates")
    some = found.filter(any_span)
    spans = judged(some.select("row", F.col(f"doc.{owner_col}").alias("owner"), F.col(f"doc.{repo_col}").alias("repo"), "_base", "_keys"))
    place = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    marked = some.join(spans, "row", "left").select("doc", "_text", F.coalesce(place, none).alias("_spans"))
    both = found.filter(~any_span).select("doc", "_text", none.alias("_spans")).unionByName(marked)
    new = F.when(F.col("_text").isNotNull(), _redacted(text, F.col("_spans")))
    return both.select(*(new.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in names))

"""Sections of annual reports by aligning all their item headings (V1, K5).

A filing names its items several times: in the table of contents, in cross references, in running heads. Every
line that begins with "item" and a number is a hit, unless prose goes on behind it in lower case ("Item 7 of this report"). The sections of a filing are the chain of hits, with rising
item numbers, whose own stretches - up to the next hit - hold the most characters but white space: contents lines hold none, a cross
reference breaks the order or holds less than the item it names. A section runs from its hit to the next hit of the
chain, so what follows a cross reference inside it stays in it; hits of one item right after another count as one.

All of it is one expression over the text: one pattern cuts the text at the hits, and a fold over the hits keeps the best chain that ends at
each item. Items may be absent; those named as required send the filing to the dead letters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .text import WS_CHARS, WS_INLINE, clean_sections

#: The items of an annual report, in order.
ITEM_ORDER = ("1", "1A", "1B", "1C", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "9C", "10", "11", "12", "13", "14", "15", "16")
#: The three sections and their items.
ITEM_SECTIONS = {"item1": "1", "item1a": "1A", "item7": "7"}
#: A heading line of at most so many characters is a title and left out of the section; of a longer one only the item's number is.
TITLE_CHARS = 150

_NUMBER = rf"(?i){WS_INLINE}*items?{WS_INLINE}+([0-9]{{1,2}})\(?([a-c]?)\)?(?![0-9a-z])"
# behind it the line ends, or a mark or a capital follows; "Items 1 and 2." is one heading
_HEAD = rf"{_NUMBER}(?:{WS_INLINE}*(?:and|&|,){WS_INLINE}*(?:items?{WS_INLINE}+)?[0-9]{{1,2}}[a-c]?(?![0-9a-z]))?(?={WS_INLINE}*(?:[^\s0-9a-z]|$|\n|(?-i:[A-Z])))"
# a line end before a heading; the heading itself stays with what follows
_CUT = rf"\n(?={_HEAD})"


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once."""
    return F.transform(F.array(value), fn)[0]


def _best_chain(nodes: Column) -> Column:
    """Indices of the hits of the best chain; ``nodes``: (rank, chars) of each hit, rank 0 for no item of the order."""
    size = len(ITEM_ORDER)
    link = "struct<chars:bigint,picks:array<int>>"
    empty = F.struct(F.lit(0).cast("long").alias("chars"), F.array().cast("array<int>").alias("picks"))
    state = f"struct<at:int,rank:int,before:{link},own:bigint,best:array<{link}>>"
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("rank"), empty.alias("before"), F.lit(0).cast("long").alias("own"),
                     F.array(*[empty] * size).alias("best")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        again = acc["rank"] == x["rank"]
        # the best chain of lower items, with this hit at its end; a repeated heading goes on with the hit before it
        lower = F.when(x["rank"] > 1, F.array_max(F.slice(acc["best"], 1, F.greatest(x["rank"] - 1, F.lit(1))))).otherwise(empty)
        joined = F.struct(lower["chars"].alias("chars"), F.concat(lower["picks"], F.array(acc["at"])).alias("picks"))
        before = F.when(again, acc["before"]).otherwise(joined)
        own = F.when(again, acc["own"]).otherwise(F.lit(0)) + x["chars"]

        def put(bw: Column) -> Column:
            total = F.struct((bw["before"]["chars"] + bw["own"]).alias("chars"), bw["before"]["picks"].alias("picks"))
            better = lambda b, j: (j == x["rank"] - 1) & (total["chars"] > b["chars"])
            best = F.transform(acc["best"], lambda b, j: F.when(better(b, j), total).otherwise(b))
            return F.struct((acc["at"] + 1).alias("at"), x["rank"].alias("rank"), bw["before"].alias("before"), bw["own"].alias("own"), best.alias("best"))

        return _let(F.struct(before.alias("before"), own.alias("own")), put).cast(state)

    return F.aggregate(nodes, begin, step, lambda acc: F.array_max(acc["best"])["picks"])


def section_texts(text: Column, sections: Mapping[str, str] = ITEM_SECTIONS) -> Column:
    """A struct of the sections' texts, null where the filing has none; a null text gives nulls."""
    unknown = [i for i in sections.values() if i not in ITEM_ORDER]
    if unknown:
        raise ValueError(f"no items of an annual report: {', '.join(unknown)}")
    order = F.array(*(F.lit(i) for i in ITEM_ORDER))

    def node(piece: Column) -> Column:
        head = F.left(piece, F.lit(200))
        label = F.upper(F.concat(F.regexp_replace(F.regexp_extract(head, _HEAD, 1), "^0", ""), F.regexp_extract(head, _HEAD, 2)))
        title = F.substring_index(piece, "\n", 1)
        body = F.when(F.length(title) <= TITLE_CHARS, F.substr(piece, F.length(title) + 1)).otherwise(F.regexp_replace(piece, "^" + _HEAD, ""))
        return F.struct(F.array_position(order, label).cast("int").alias("rank"), F.length(F.translate(body, WS_CHARS, "")).cast("long").alias("chars"), body.alias("body"), piece.alias("piece"))

    def texts(n: Column) -> Column:
        chain = _best_chain(F.transform(n["nodes"], lambda x: F.struct(x["rank"].alias("rank"), x["chars"].alias("chars"))))

        def cut(c: Column) -> Column:
            out = []
            for name, item in sections.items():
                rank = ITEM_ORDER.index(item) + 1
                # this section's place in the chain, from 1; 0 if it isn't in it
                at = F.array_position(F.transform(c["picks"], lambda p: F.get(n["nodes"], p)["rank"]), F.lit(rank)).cast("int")

                def own(a: Column) -> Column:
                    first = F.get(c["picks"], a - 1)
                    last = F.coalesce(F.get(c["picks"], a), F.size(n["nodes"]))
                    rest = F.transform(F.slice(n["nodes"], first + 2, F.greatest(last - first - 1, F.lit(0))), lambda x: x["piece"])
                    return F.when(a > 0, F.array_join(F.concat(F.array(F.get(n["nodes"], first)["body"]), rest), "\n"))

                out.append(_let(at, own).alias(name))
            return F.struct(*out)

        return _let(F.struct(chain.alias("picks")), cut)

    def nodes(pieces: Column) -> Column:
        hits = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), node)
        return _let(F.struct(hits.alias("nodes")), texts)

    return F.when(text.isNotNull(), _let(F.split(F.concat(F.lit("\n"), text), _CUT, -1), nodes))


def aligned_sections(df: DataFrame, key: str, text: str, sections: Mapping[str, str] = ITEM_SECTIONS,
                     required: Sequence[str] = ("item1",)) -> tuple[DataFrame, DataFrame]:
    """(rows with their sections, rows without text or without a required section) (V1, K5).

    Sections that a filing doesn't have are empty texts, unless they are required. Each text is cut once: the
    sections are written down and both results read them. A table of contents alone, a text without headings and an empty
    text are errors; other columns are kept.
    """
    others = [c for c in df.columns if c != text]
    found = materialize(df.select(*others, section_texts(F.col(text), sections).alias("__sections")))
    ok = F.col("__sections").isNotNull()
    for name in required:
        ok = ok & F.coalesce(F.length(F.btrim(F.col(f"__sections.{name}"))) > 0, F.lit(False))
    texts = [F.coalesce(F.col(f"__sections.{name}"), F.lit("")).alias(name) for name in sections]
    return found.where(ok).select(*others, *texts), found.where(~ok).select(*others)


def filing_items(links: DataFrame, documents: DataFrame, key: str = "fname", text: str = "body", sections: Mapping[str, str] = ITEM_SECTIONS,
                 required: Sequence[str] = ("item1",), min_chars: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The filing-text job (V1, F16, F17, J4) with aligned sections: each distinct linked filing is cut once, flagged, joined to one
    text, and merged back to every firm it is linked to.

    Sections are cut where the documents lie, so whole texts never travel; only sections meet the links.
    Returns (a row per link row whose filing has its required sections, linked filings that don't or that have no document).
    """
    wanted = links.select(key).where(F.col(key).isNotNull()).distinct()
    ok, bad = aligned_sections(documents.select(key, text), key, text, sections, required)
    none = wanted.join(documents.select(key), key, "left_anti")
    return links.join(clean_sections(ok, key, key, min_chars), key), bad.join(wanted, key, "left_semi").unionByName(none)

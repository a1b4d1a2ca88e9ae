"""Filing text: section extraction with a dead-letter split, short-text flags,
conditional concatenation and paragraph/sentence chunking (V1, V2, K5, F16-F21, P13, A13).

Everything is a native string or higher-order array function, so one document
is processed whole inside one task with no Python round trip; the output is one
row per chunk via ``posexplode``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import short_flag

if TYPE_CHECKING:
    from .sentences import SentenceEnds

# The source's chunk cap is twice max(encoder sequence length 512, 1024);
# a section shorter than 10,000 characters is flagged missing.
CHUNK_CAP = 2 * max(512, 1024)
MIN_SECTION_CHARS = 10000

# Whitespace as Python's ``\s`` sees it on text, written as an explicit class so
# the same pattern means the same thing to Java regex and to RE2.
WS = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_WS = WS.replace("[", "[^", 1)
# the same class without the newline: runs of it never cross a paragraph break
WS_INLINE = WS.replace(r"\t\n", r"\t", 1)
SENTENCE_BREAK = r"(?<=[.!?])" + WS + "+"
# the same set as literal characters, for trimming without a regex
WS_CHARS = ("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


# --------------------------------------------------------------------------- F16, F17, A13

def text_flags(df: DataFrame, cols: Sequence[str] = ("item1", "item1a", "item7"),
               min_chars: int = MIN_SECTION_CHARS, suffix: str = "_na") -> DataFrame:
    """``<col>_na`` = 1 when the section has fewer than ``min_chars`` characters (F16)."""
    for c in cols:
        df = df.withColumn(c + suffix, short_flag(c, min_chars))
    return df


def missing_share(df: DataFrame, flag: str = "item1_na") -> DataFrame:
    """Share of rows flagged missing (A13); one row."""
    return df.agg(F.avg(F.col(flag).cast("double")).alias(f"{flag}_share"))


def concat_sections(df: DataFrame, first: str = "item1", second: str = "item1a", third: str = "item7",
                    out: str = "text", suffix: str = "_na") -> DataFrame:
    """Conditional concatenation (F17), in order 1, 1A, 7 with no separator.

    If item 1 is long: drop 7 when only 7 is short, drop 1A when only 1A is
    short, keep item 1 alone when both are short. Otherwise keep all three.
    """
    na = {x: F.col(x + suffix) for x in (first, second, third)}
    long1 = na[first] == 0
    part = lambda x: F.when(long1 & (na[x] == 1), F.lit("")).otherwise(F.col(x))
    return df.withColumn(out, F.concat(F.col(first), part(second), part(third)))


def clean_sections(df: DataFrame, key_in: str = "link", key_out: str = "fname",
                   min_chars: int = MIN_SECTION_CHARS) -> DataFrame:
    """Flags and conditional concatenation of extracted sections (F16, F17), with the
    extraction key renamed to the filing key -- the whole cleaning step in one call."""
    out = concat_sections(text_flags(df, min_chars=min_chars))
    return out.withColumnRenamed(key_in, key_out) if key_in in df.columns else out


# --------------------------------------------------------------------------- V1, K5

def extract_sections(df: DataFrame, key: str, text: str, patterns: Mapping[str, str],
                     require: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Extract one regex capture group per section; split into (ok, errors) (V1, K5).

    A row whose text does not match ``require`` or misses any section goes to
    the error set whole -- one row per document, never a half-filled row. Each
    pattern runs once a row: its first match, or null, is kept in an array.
    """
    t = F.col(text)
    others = [c for c in df.columns if c != text]
    found = F.array(*(F.get(F.regexp_extract_all(t, F.lit(pat), F.lit(1)), F.lit(0)) for pat in patterns.values()))
    marked = df.select(*others, found.alias("__found"), *([F.coalesce(t.rlike(require), F.lit(False)).alias("__fits")] if require else []))
    whole = ~F.exists("__found", lambda s: s.isNull())
    if require:
        whole = whole & F.col("__fits")
    sections = [F.col("__found")[i].alias(name) for i, name in enumerate(patterns)]
    return marked.where(whole).select(*others, *sections), marked.where(~whole).select(*others)


#: Headings of items 1, 1A and 7 of an annual report in plain text; each section runs to the next item's heading.
ITEM_PATTERNS = {
    "item1": r"(?is)(?:^|\n)\s*item\s+1\s*[.:\-]?\s+business\b(.*?)(?=\n\s*item\s+(?:1a|1b|2)\b|\Z)",
    "item1a": r"(?is)(?:^|\n)\s*item\s+1a\s*[.:\-]?\s+risk\s+factors\b(.*?)(?=\n\s*item\s+(?:1b|2)\b|\Z)",
    "item7": r"(?is)(?:^|\n)\s*item\s+7\s*[.:\-]?\s+management(.*?)(?=\n\s*item\s+(?:7a|8)\b|\Z)",
}


def filing_texts(links: DataFrame, documents: DataFrame, key: str = "fname", text: str = "body",
                 patterns: Mapping[str, str] | None = None, min_chars: int = MIN_SECTION_CHARS) -> tuple[DataFrame, DataFrame]:
    """The filing-text job (V1, F16, F17, J4): each distinct linked filing's sections are extracted
    once, flagged and joined to one text, and merged back to every firm the filing is linked to.

    Returns (one row per link row whose filing has all sections, filings that lack one or
    have no document).
    """
    wanted = links.select(key).where(F.col(key).isNotNull()).distinct()
    ok, errors = extract_sections(wanted.join(documents.select(key, text), key, "left"), key, text, patterns or ITEM_PATTERNS)
    return links.join(clean_sections(ok, key, key, min_chars), key), errors


# --------------------------------------------------------------------------- V2, F18-F21, P13

def chunk_array(text: str | Column, sep: str = "\n", cap: int = CHUNK_CAP, ends: SentenceEnds | None = None) -> Column:
    """Paragraphs (split on ``sep``) with whitespace runs collapsed; paragraphs
    longer than ``cap`` characters split at sentence ends; blank chunks dropped.
    ``ends``: sentence ends as learned from the corpus, else every ``.``, ``!`` or ``?`` before white space is one."""
    t = F.col(text) if isinstance(text, str) else text
    if sep == "\n":
        # one pass over the whole text: whitespace runs never span a newline,
        # so this equals collapsing inside each paragraph
        paras = F.split(F.regexp_replace(t, WS_INLINE + "{2,}", " "), "\n", -1)
    else:
        paras = F.transform(F.split(t, _regex_literal(sep), -1),
                            lambda p: F.regexp_replace(p, WS + "{2,}", " "))
    sentences = lambda p: F.split(p, SENTENCE_BREAK, -1)
    if ends is not None:
        from .sentences import sentence_array
        sentences = lambda p: sentence_array(p, ends)
    pieces = F.flatten(F.transform(paras, lambda p: F.when(F.length(p) > cap, sentences(p)).otherwise(F.array(p))))
    # blank = only whitespace: trimming the literal whitespace set leaves nothing
    return F.filter(pieces, lambda c: F.length(F.btrim(c, F.lit(WS_CHARS))) > 0)


def chunk_docs(df: DataFrame, key: str | Sequence[str], text: str, sep: str = "\n",
               cap: int = CHUNK_CAP, keep: Sequence[str] = (), ends: SentenceEnds | None = None) -> DataFrame:
    """One row per chunk: (key..., chunk_no, chunk, n_chars) (V2). Empty texts are skipped.
    ``ends``: learned sentence ends (``learn_sentence_ends``)."""
    keys = [key] if isinstance(key, str) else list(key)
    src = df.where(F.length(F.col(text)) > 0)
    out = src.select(*keys, *keep, F.posexplode(chunk_array(text, sep, cap, ends)).alias("chunk_no", "chunk"))
    return out.withColumn("chunk_no", F.col("chunk_no").cast("long")) \
              .withColumn("n_chars", F.length("chunk").cast("long"))


def _regex_literal(s: str) -> str:
    import re
    return re.escape(s) if s != "\n" else "\n"

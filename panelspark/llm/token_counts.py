"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenization takes the longest vocabulary entry at each place of a word. The
vocabulary is a trie; where a walk can't go on, the node's failure link leads to the node for what
is left after the pieces that the greedy rule surely has taken by then, and the link carries
how many pieces those are. So a word is counted in one pass over its characters, without
backing up and without building a piece. Pieces inside a word may have a prefix of their own
(``##``), whose node is then the root for what follows the first piece.

Words are runs of characters other than space and 0x09-0x0D, each with ``word_start`` in front
(byte-level vocabularies spell the space before a word as a character). A word that the
vocabulary can't spell counts as one unknown piece.

Defined cases: null or empty text has no words; repeated rows are counted one by one; an empty
vocabulary makes every word unknown.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .stage import by_value, text_batches

#: Most words whose counts a task remembers; beyond that it forgets them all and goes on.
REMEMBERED = 500_000


class Automaton:
    """Trie of the vocabulary with failure links and the pieces popped on each."""

    def __init__(self, vocabulary: Iterable[str], inside: str = ""):
        self.children: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in vocabulary:
            at = 0
            for c in piece:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    ends.append(False)
                at = self.children[at][c]
            ends[at] = ends[at] or at != 0
        self.rest = 0  # where a walk stands after whole pieces
        for c in inside:
            if c not in self.children[self.rest]:
                self.children[self.rest][c] = len(self.children)
                self.children.append({})
                ends.append(False)
            self.rest = self.children[self.rest][c]
        n = len(self.children)
        self.link, self.popped = [-1] * n, [0] * n
        queue: deque[int] = deque([0] if self.rest == 0 else [0, self.rest])
        done = {0, self.rest}
        # shallower nodes first, seen from either root: a link always leads to less text than its node has
        while queue:
            u = queue.popleft()
            for c, v in self.children[u].items():
                if v in done:
                    continue
                done.add(v)
                queue.append(v)
                if ends[v]:
                    self.link[v], self.popped[v] = self.rest, 1
                    continue
                z, count = self.link[u], self.popped[u]
                while z >= 0 and c not in self.children[z]:
                    count += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.popped[v] = self.children[z][c], count

    def count(self, word: str) -> int:
        """Pieces of the word, 0 if the vocabulary can't spell it."""
        children, link, popped, rest = self.children, self.link, self.popped, self.rest
        at = pieces = 0
        for c in word:
            while c not in children[at]:
                if link[at] < 0:
                    return 0
                pieces += popped[at]
                at = link[at]
            at = children[at][c]
        while at != rest:
            if link[at] < 0:
                return 0
            pieces += popped[at]
            at = link[at]
        return pieces


def byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies spell each byte with."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def token_counts(docs: DataFrame, vocabulary_path: str, inside: str = "", word_start: str = " ", byte_level: bool = True,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_tokens (unknown words count 1), n_unknown.

    ``vocabulary_path``: a tokenizers JSON file; special tokens are no pieces of words.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
    shared = by_value(docs.sparkSession, Automaton((p for p in spec["model"]["vocab"] if p not in special), inside))  # a vocabulary: its size doesn't follow the data
    text_batches(docs.sparkSession)
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, letters = shared(), byte_alphabet()
        spell = {b: c for b, c in enumerate(letters)}
        known: dict[bytes, int] = {}

        def count(word: bytes) -> int:
            if len(known) >= REMEMBERED:
                known.clear()
            text = (word_start.encode() + word).decode("latin-1").translate(spell) if byte_level else word_start + word.decode()
            known[word] = n = automaton.count(text)
            return n

        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                words = text.split() if text else []
                got = [known[w] if w in known else count(w) for w in words]
                unknown = got.count(0)
                rows.append((len(got), sum(got) + unknown, unknown))
            cols = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["id", "n_words", "n_tokens", "n_unknown"])

    return narrow.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)

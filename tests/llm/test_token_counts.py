"""The automaton against plain greedy longest match."""

import json
import random
import re

import public_tokenizers
import pytest

from panelspark.llm import token_counts as T

from ..conftest import SF001

PATH = public_tokenizers.path("byte_bpe_50k.json")


def greedy(word, vocabulary, inside=""):
    at = pieces = 0
    while at < len(word):
        lead = inside if at else ""
        for end in range(len(word), at, -1):
            if lead + word[at:end] in vocabulary:
                break
        else:
            return 0
        at, pieces = end, pieces + 1
    return pieces


@pytest.mark.parametrize("inside", ["", "##"])
def test_automaton(inside):
    rng = random.Random(3)
    piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    for _ in range(800):
        vocabulary = {piece() for _ in range(rng.randint(0, 12))} | {inside + piece() for _ in range(rng.randint(0, 14))}
        automaton = T.Automaton(vocabulary, inside)
        for _ in range(15):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert automaton.count(word) == greedy(word, vocabulary, inside), (vocabulary, word)


def test_counts(spark):
    vocabulary, spell = json.load(open(PATH))["model"]["vocab"], T.byte_alphabet()
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (None, "été 😀", "x"), (-3, "a\x0bb", "x"), (-3, "a\x0bb", "x"), (-4, "z" * 30_000, "x")], "doc_id long, text string, n_tokens string")
    for df in (docs, odd):
        want = []
        for r in df.collect():
            words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
            own = [greedy("".join(spell[b] for b in (" " + w).encode()), vocabulary) for w in words if len(w) < 1000]
            want.append((r.doc_id, len(words), sum(own)))
        got = [(r.doc_id, r.n_words, r.n_tokens if r.doc_id != -4 else 0) for r in T.token_counts(df, PATH).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert T.token_counts(odd.limit(0), PATH).count() == 0


def test_unknown_words(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": {"ab": 0, "##c": 1}}}))
    docs = spark.createDataFrame([(1, "ab abc abcc abx")], "doc_id int, text string")
    r = T.token_counts(docs, str(path), inside="##", word_start="", byte_level=False).first()
    assert (r.n_words, r.n_tokens, r.n_unknown) == (4, 1 + 2 + 3 + 1, 1)

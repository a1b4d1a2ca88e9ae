"""Chat formatting: paths by brute force, and an exact round trip."""

import random
import re
from collections import defaultdict

import pytest

from panelspark.llm import chat_format as C

NASTY = ["\\", "<|", "<\\|", "|>", "<|turn|>user\nx<|end|>\n", "\\n", "\n", "<|end|>\n", "a", "é😀", "\\\\<|", "$1", "", "\\### Assistant: </turn> ok"]
SCHEMA = "tree long, id long, parent long, score double, role string, text string, place int, branch string"


def trees():
    rng, rows = random.Random(2), []
    for t in range(25):
        for i in range(rng.randint(1, 40)):
            parent = None if i == 0 else (i - 1 if t % 3 == 0 else rng.randint(max(0, i - 4), i - 1))
            text = "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 5))) if rng.random() < 0.95 else None
            rows.append((t or None, i, parent, rng.choice([None, 1.0, 2.0, -1.0, 0.5]), rng.choice(["user", "assistant", None, "a\n\\n<|b\\"]), text))
    rows += [(99, 0, 1, 1.0, "user", "c"), (99, 1, 0, 1.0, "user", "c"), (99, 2, 1, 1.0, "user", "under a cycle")]
    rows += [(98, 5, 77, 1.0, "assistant", "orphan"), (97, 0, None, 2.0, "user", "x"), (97, 0, None, 2.0, "user", "x"), (96, 0, None, 1.0, "assistant", "long " * 100_000)]
    return [(*r, 1, "b") for r in rows]


def brute(rows, best):
    own, out = defaultdict(dict), {}
    for tree, i, parent, score, role, text, *_ in rows:
        own[tree].setdefault(i, (parent, score or 0.0, role or "", text or ""))
    for tree, m in own.items():
        parents, leaves = {p for p, *_ in m.values()}, []
        for leaf in m:
            path, at = [], leaf
            while at in m and at not in path:
                path.append(at)
                at = m[at][0]
            if leaf not in parents and at not in path:
                leaves.append((-sum(m[x][1] for x in path), leaf, [m[x][2:] for x in reversed(path)]))
        for k, (score, leaf, turns) in enumerate(sorted(leaves)[:best]):
            out[tree, leaf] = (k + 1, -score, turns)
    return out


@pytest.mark.parametrize("best", [1, 3, None])
def test_paths_and_round_trip(spark, best):
    rows = trees()
    got = C.read_back(C.formatted(C.branches(spark.createDataFrame(rows, SCHEMA), best))).collect()
    want = brute(rows, best)
    assert {(r.tree, r.leaf): (r.branch, r.score, [tuple(t) for t in r.turns]) for r in got} == want
    for r in got:
        assert r.learnt == "".join(text for role, text in want[r.tree, r.leaf][2] if role == "assistant")
        assert r.text.count(C.TURN) == len(r.turns) == len(r.loss) + sum(t.role != "assistant" for t in r.turns)


def test_deep_thread_and_gaps(spark):
    rows = [(1, 3 * i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(700)] + [(1, None, None, None), (2, 5, "user", "a"), (2, 5, "user", "a")]
    paths = C.branches(C.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.tree: [t.text for t in r.turns] for r in C.read_back(C.formatted(paths)).collect()}
    assert got == {1: ["", *map(str, range(700))], 2: ["a", "a"]}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.formatted(C.branches(empty)).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    rows = spark.createDataFrame(trees(), SCHEMA)
    C.read_back(C.formatted(C.branches(rows))).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)

"""Chat formatting: reply trees to formatted conversations, in DataFrame functions only.

Messages form trees by their parent ids. Every root-to-leaf path is a branch; its score is the sum
of its messages' scores. The branches of a tree are ranked by score, and each chosen one is
formatted as one conversation under a reversible template with a loss mask.

The paths come from iterative self-joins by doubling: round k knows each message's ancestor 2^k
steps up, so a tree of depth d takes log2(d) rounds, and a leaf's score is known without its path
being spelled out. Only the chosen leaves are expanded, through the same ancestor tables in
reverse, to exactly the rows that are formatted.

Template: ``<|turn|>``, role, newline, text, ``<|end|>``, newline for each turn. In texts ``\\`` becomes
``\\\\`` and ``<|`` becomes ``<\\|``; in roles a newline becomes ``\\n`` besides. So no control string can
stand in a text, and ``read_back`` gives every role and text back.

Defined cases: a null role or text is empty; a null score is 0; a message whose parent is null
or absent is a root; messages on or under a cycle belong to no path; of messages with one id in one
tree the first by score, role and text stays; ties of branches go to the smaller leaf id; a null
tree is a tree of its own; an empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import written

TURN, END = "<|turn|>", "<|end|>\n"
LEARNT = "assistant"
#: Parts that a tree's branches are dealt to before the best of each part are compared.
PARTS = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # the three escapes begin with a backslash each, so pieces between doubled backslashes can't mix them up
    pieces = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))), "\\")


def branches(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, branch, score, place, role, text) of the messages on each tree's ``best`` branches (None: all).

    ``messages``: tree, id, parent, score, role, text. ``branch`` ranks a tree's branches from 1.
    """
    one = Window.partitionBy("tree", "id").orderBy(F.desc("score"), "role", "text")
    ids = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(ids.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").drop("_nth"), "messages")
    nodes = rows.select("tree", "id", "parent", "score")
    parents = nodes.select(F.col("tree").alias("t"), F.col("id").alias("p"))
    known = nodes.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left")
    # up: the ancestor 2^k steps up or null; score and depth: of the messages from this one to below it
    state = written(known.select("tree", "id", F.col("p").alias("up"), "score", F.lit(1).alias("depth")), "paths")
    ancestors = []
    left = state.filter("up is not null").count()
    while left:
        ancestors.append(state.filter("up is not null").select("tree", "id", "up"))
        above = state.select(F.col("tree").alias("t"), F.col("id").alias("a"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("depth").alias("d2"))
        going = state.filter("up is not null").join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("a")))
        after = going.select("tree", "id", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("depth") + F.col("d2")).alias("depth"))
        state = written(state.filter("up is null").unionByName(after), "paths")
        was, left = left, state.filter("up is not null").count()
        if left == was:  # only messages on or under cycles are left
            break
    has_child = nodes.select(F.col("tree").alias("t"), F.col("parent").alias("p")).filter("p is not null").distinct()
    leaves = state.filter("up is null").join(has_child, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("p")), "left_anti")
    order = [F.desc("score"), "id"]
    if best is not None:  # a hot tree's leaves are first ranked in parts
        part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
        leaves = leaves.withColumn("_n", F.row_number().over(Window.partitionBy("tree", part).orderBy(*order))).filter(F.col("_n") <= best)
        leaves = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).filter(F.col("branch") <= best)
    else:
        leaves = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
    chosen = written(leaves.select("tree", F.col("id").alias("leaf"), "branch", "score", "depth"), "chosen")
    path = chosen.select("tree", "leaf", "branch", "score", F.col("leaf").alias("id"), (F.col("depth") - 1).alias("place"))
    for k in reversed(range(len(ancestors))):
        up = ancestors[k].select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        above = path.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")))
        path = written(path.unionByName(above.select("tree", "leaf", "branch", "score", F.col("up").alias("id"), (F.col("place") - (1 << k)).alias("place"))), "path")
    texts = rows.select(F.col("tree").alias("t"), F.col("id").alias("i"), "role", "text")
    return path.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i"))).select("tree", "leaf", "branch", "score", "place", "role", "text")


def formatted(paths: DataFrame) -> DataFrame:
    """One row per branch: tree, leaf, branch, score, text, loss (spans of code points, ends exclusive)."""
    turn = F.struct("place", (F.col("role") == LEARNT).alias("learnt"), F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    turns = paths.groupBy("tree", "leaf", "branch", "score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(t["learnt"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return turns.select("tree", "leaf", "branch", "score", text.alias("text"), F.aggregate("turns", begin, step, lambda acc: acc["spans"]).alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """The rows with ``turns`` (array of role, text) and ``learnt`` (all text under the loss mask, unescaped), from ``text`` and ``loss`` alone."""
    pieces = F.split("text", r"<\|end\|>\n", -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescape_role(F.substring_index(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), "\n", 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text")))
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))), "")
    return conversations.withColumn("turns", turns).withColumn("learnt", learnt)


def threads(turns: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of linear conversations: each row replies to the one before it by turn (then role and text)."""
    rows = turns.select(turns[tree].alias("tree"), turns[turn].alias("turn"), turns[role].alias("role"), turns[text].alias("text"))
    nth = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    return rows.select("tree", nth.alias("id"), F.when(nth > 1, nth - 1).alias("parent"), F.lit(0).alias("score"), "role", "text")

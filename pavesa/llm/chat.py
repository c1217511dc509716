"""Reply trees: branches are found by iterative self-joins, ranked by score, and each chosen one is formatted as a conversation.

Messages have a tree, an id, the id of the message they answer, a role, a text and a score. Ancestors are found by pointer doubling: a
message 400 replies deep takes nine joins, not 400. Only ids travel in the joins; texts meet them once, at the end.

A template turn is ``<s>role`` + newline + body + ``</s>``; the body of an assistant is its text and carries the loss, any other body is
``[INST] text [/INST]``. Control strings inside roles and texts are escaped with a backslash code, so that the output can be read back.

Defined cases: null text and null role are empty; a message whose parent is null or absent is a root; messages that answer each other in
a circle have no root and so are on no path; ties of score go to the smaller leaf id; repeated rows are distinct messages in ``by_turn``.
A null tree id is a tree of its own. Other columns are not read. No messages give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pavesa.llm.common import cut_lineage

#: Escape codes, in the order in which they are put in; the backslash goes first and comes back last.
CODES = [("\\", "\\0"), ("<s>", "\\1"), ("</s>", "\\2"), ("[INST]", "\\3"), ("[/INST]", "\\4")]
ROLE_CODES = [*CODES, ("\n", "\\5")]


def escape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def by_turn(rows: DataFrame) -> DataFrame:
    """Conversation rows as trees without forks: each row answers the one before it by (turn, role, text)."""
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.select(F.col("conv_id").alias("tree"), at.cast("long").alias("id"), "role", "text").withColumns(
        {"parent": F.when(F.col("id") > 1, F.col("id") - 1), "score": F.lit(0.0)}
    )


def _keyed(messages: DataFrame) -> DataFrame:
    """A key without nulls for the tree."""
    return messages.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("")))


def _ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables k = 0, 1, ... of the messages with an ancestor 2^k up, and all messages that lead to a root with that root, depth and score.

    A message leaves the joins as soon as its root is known, so a few deep trees don't make the others join again.
    """
    ids = nodes.select("key", F.col("id").alias("parent"), F.lit(True).alias("known"))
    start = nodes.join(ids, ["key", "parent"], "left").select(
        "key", "id", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("id").alias("top"), F.lit(1).cast("long").alias("depth"), F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("total")
    )
    step = cut_lineage(start, "tree")
    jumps, rooted = [step.where("up is not null")], step.where("up is null")
    # Paths are shorter than the number of messages; whoever still has an ancestor after that many steps sits in or under a circle.
    for _ in range(nodes.count().bit_length()):
        if jumps[-1].isEmpty():
            break
        a, b = jumps[-1].alias("a"), jumps[-1].unionByName(rooted).alias("b")
        step = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.up") == F.col("b.id"))).select(
            "a.key", "a.id", F.col("b.up").alias("up"), F.col("b.top").alias("top"), (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.total") + F.col("b.total")).alias("total")
        )
        step = cut_lineage(step, "tree")
        jumps.append(step.where("up is not null"))
        rooted = rooted.unionByName(step.where("up is null"))
    return jumps, rooted


def branches(messages: DataFrame, best: int | None = None) -> DataFrame:
    """One row per message of each chosen root-to-leaf path: tree, leaf, id, position from the root, branch score and rank in its tree.

    ``best``: paths kept per root (None: all).
    """
    nodes = _keyed(messages)
    links = nodes.select("tree", "key", "id", "parent", "score")
    jumps, reached = _ancestors(links)
    answered = links.select("key", F.col("parent").alias("id")).where("id is not null").distinct()
    leaves = reached.join(answered, ["key", "id"], "left_anti")
    rank = F.row_number().over(W.partitionBy("key", "top").orderBy(F.col("total").desc(), "id"))
    ranked = leaves.withColumn("rank", rank)
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    path = cut_lineage(ranked.select("key", F.col("id").alias("leaf"), "id"), "path")
    for jump in jumps:
        more = path.join(jump.select("key", "id", "up"), ["key", "id"]).select("key", "leaf", F.col("up").alias("id"))
        path = cut_lineage(path.unionByName(more), "path")
    place = reached.select("key", "id", F.col("depth").alias("position"))
    chosen = ranked.select("key", F.col("id").alias("leaf"), F.col("total").alias("branch_score"), "rank")
    names = nodes.select("key", "tree", "id", "role", "text")
    return path.join(chosen, ["key", "leaf"]).join(place, ["key", "id"]).join(names, ["key", "id"])


def render(path_rows: DataFrame) -> DataFrame:
    """Paths as text: tree, leaf, branch_score, rank, formatted, and loss: per assistant turn its number, first character and length there."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(escape(role, ROLE_CODES), F.lit("\n"))
    learned = role == "assistant"
    body = F.when(learned, escape(text)).otherwise(F.concat(F.lit("[INST] "), escape(text), F.lit(" [/INST]")))
    turn = F.struct(
        F.col("position"), F.concat(head, body, F.lit("</s>")).alias("piece"),
        F.when(learned, F.struct((F.length(head) + 1).alias("start"), F.length(escape(text)).alias("length"))).alias("span"),
    )
    turns = path_rows.groupBy("key", "leaf").agg(F.first("tree").alias("tree"), F.first("branch_score").alias("branch_score"), F.first("rank").alias("rank"), F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t, i: F.when(t["span"].isNotNull(), F.struct(i.alias("turn"), t["span"]["start"].alias("start"), t["span"]["length"].alias("length")))), lambda s: s.isNotNull())
    pieces = F.transform("turns", lambda t: F.concat(F.lit("<s>"), t["piece"]))
    return turns.select("tree", "leaf", "branch_score", "rank", F.array_join(pieces, "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Formatted rows with ``turns`` (role and text, as they were before formatting) and ``learned``: the text under the loss mask."""
    pieces = F.split("formatted", "<s>")
    parts = formatted.withColumn("_pieces", F.slice(pieces, F.lit(2), F.size(pieces)))

    def parsed(p: Column) -> Column:
        at = F.instr(p, "\n")
        body = F.substring(p, at + 1, F.length(p) - at - F.lit(len("</s>")))
        bare = F.when(F.startswith(body, F.lit("[INST] ")), F.substring(body, F.lit(8), F.length(body) - F.lit(len("[INST]  [/INST]")))).otherwise(body)
        return F.struct(unescape(F.substring(p, F.lit(1), at - 1), ROLE_CODES).alias("role"), unescape(bare).alias("text"))

    under = F.transform("loss", lambda s: unescape(F.substring(F.col("_pieces")[s["turn"]], s["start"], s["length"])))
    return parts.withColumns({"turns": F.transform("_pieces", parsed), "learned": F.array_join(under, "")}).drop("_pieces")

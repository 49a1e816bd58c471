"""Chat formatting over reply trees, with DataFrame functions only.

Messages name their parent. Leaves start paths; ancestors are found by joins of the tree with itself whose reach doubles
each round, so a thread of depth d takes log2(d) rounds and only (leaf, ancestor) id pairs move. Branches are ranked by
the sum of their messages' scores, and each chosen path becomes one text with the spans that count for the loss.

A turn reads ``<turn ROLE>``, newline, text, ``</turn>``, newline. ``\\`` is written ``\\b``, ``<`` is written ``\\l`` and,
in roles only, ``>`` is written ``\\g``: no text can hold a control string, and reading back undoes exactly this.

NULL text or role: empty. NULL tree: a tree of its own. A parent that is not there: the message is a root. Repeated node
ids: one row counts (the smallest). Messages that reply in a circle are rejected. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinloom.llm.common import same
from twinloom.session import cut

CLOSE = "</turn>\n"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def chains(rows: DataFrame) -> DataFrame:
    """Conversations as trees without branches: each row replies to the one before it by turn (then role, then text)."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select(
        F.col("conv_id").alias("tree"), at.alias("node"), F.when(at > 1, at - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every message on the way from a leaf to its root, ``up`` steps above the leaf."""
    nodes = cut(messages.groupBy("tree", "node").agg(F.min("parent").alias("parent")))
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    above = nodes.join(known, same(F.col("tree"), F.col("_t")) & (F.col("parent") == F.col("_n")), "left").select("tree", "node", F.col("_n").alias("up"))
    above = cut(above.where("up is not null"))
    parents = above.select(F.col("tree").alias("_t"), F.col("up").alias("_n")).distinct()
    leaves = nodes.join(parents, same(F.col("tree"), F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    step, most = 1, nodes.count()
    while not above.isEmpty():
        if step > most:
            raise ValueError("messages reply in a circle")
        jump = above.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"))
        further = found.join(jump, same(F.col("tree"), F.col("_t")) & (F.col("node") == F.col("_n")))
        found = cut(found.union(further.select("tree", "leaf", F.col("_up").alias("node"), F.col("up") + step)))
        twice = above.join(jump, same(F.col("tree"), F.col("_t")) & (F.col("up") == F.col("_n")))
        above = cut(twice.select("tree", "node", F.col("_up").alias("up")))
        step *= 2
    return found


def best(scored: DataFrame, branches: int, spread: int = 64) -> DataFrame:
    """The ``branches`` paths of a tree with the highest score (ties: smallest leaf). Each tree is ranked in ``spread``
    parts first, so a tree with very many leaves isn't one task."""
    order = [F.col("score").desc(), "leaf"]
    part = scored.withColumn("_part", F.pmod(F.xxhash64("leaf"), F.lit(spread)))
    first = part.withColumn("_r", F.row_number().over(Window.partitionBy("tree", "_part").orderBy(*order))).where(F.col("_r") <= branches)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).where(F.col("rank") <= branches).drop("_part", "_r")


def formatted(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, score, rank, formatted, spans): the chosen paths as texts; ``spans`` are the code points under the loss."""
    reach = paths(messages)
    body = messages.groupBy(F.col("tree").alias("_t"), F.col("node").alias("_n")).agg(
        F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m")
    )
    on_path = same(F.col("tree"), F.col("_t")) & (F.col("node") == F.col("_n"))
    scores = body.select("_t", "_n", F.col("m.score").alias("s"))
    scored = reach.join(scores, on_path).groupBy("tree", "leaf").agg(F.sum("s").alias("score"))
    chosen = best(scored, branches).select(F.col("tree").alias("_ct"), F.col("leaf").alias("_cl"), "score", "rank")
    rows = reach.join(chosen, same(F.col("tree"), F.col("_ct")) & (F.col("leaf") == F.col("_cl"))).join(body, on_path)
    head = F.concat(F.lit("<turn "), F.replace(escaped(F.col("m.role")), F.lit(">"), F.lit("\\g")), F.lit(">\n"))
    rows = rows.select("tree", "leaf", "score", "rank", "up", (F.col("m.role") == LEARNED).alias("learned"), head.alias("head"), escaped(F.col("m.text")).alias("body"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    end = F.sum(size.cast("long")).over(Window.partitionBy("tree", "leaf").orderBy(F.col("up").desc())) - len(CLOSE)
    rows = rows.withColumn("end", end)
    turn = F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "learned", (F.col("end") - F.length("body")).alias("start"), "end")
    held = rows.groupBy("tree", "leaf").agg(F.first("score").alias("score"), F.first("rank").alias("rank"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return held.select(
        "tree", "leaf", "score", "rank",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("spans"),
    )


def parsed(df: DataFrame) -> DataFrame:
    """``df`` of ``formatted`` with ``turns`` (role, text) and ``loss`` (the texts under the mask), read from the text."""
    def turn(piece: Column) -> Column:
        cutoff = F.instr(piece, ">")
        role = F.replace(unescaped(F.substring(piece, F.lit(7), cutoff - 7)), F.lit("\\g"), F.lit(">"))
        return F.struct(role.alias("role"), unescaped(F.substring(piece, cutoff + 2, F.length(piece))).alias("text"))

    pieces = F.slice(F.split("formatted", CLOSE), F.lit(1), F.size(F.split("formatted", CLOSE)) - 1)
    return df.withColumn("_pieces", pieces).select(
        *df.columns,
        F.transform("_pieces", turn).alias("turns"),
        F.transform("spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("loss"),
    )

"""Chat formatting: reply trees to conversations under one template, with a loss mask.

Native DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

# A user turn, an assistant turn, and any other turn with its role. Control strings inside texts get a backslash
# after their first character, and backslashes are doubled, so texts can be read back exactly.
USER, USER_END = "[INST] ", " [/INST]"
REPLY, REPLY_END = "<s>", "</s>"
OTHER, OTHER_ROLE, OTHER_END = "<<SYS>>", "<<|>>", "<</SYS>>"
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, r"\[(?=/?INST\])", r"[\\")
    return F.regexp_replace(text, r"<(?=/?s>|</?SYS>>|<\|>>)", r"<\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def reply_paths(nodes: DataFrame) -> DataFrame:
    """All root-to-leaf paths, as rows (tree_id, leaf, node_id, up) with up = steps above the leaf.

    ``nodes`` has (tree_id, node_id, parent_id). Iterative self-joins double the reach: round k joins the ancestors
    found so far with the ancestor 2^k steps above each node, so a path of n messages takes about log2(n) rounds.
    A parent that does not exist, or is the node itself, makes a root; leaves below a cycle have no root and no path.
    """
    parents = nodes.select(F.col("tree_id").alias("t"), F.col("parent_id").alias("p")).distinct()
    leaves = nodes.join(parents, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("p")), "left_anti")
    known = nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"))
    hop = nodes.where("parent_id != node_id").join(
        known, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("n")), "left_semi"
    )
    hop = stage(hop.select("tree_id", "node_id", F.col("parent_id").alias("above")), "hop")
    paths = stage(leaves.select("tree_id", F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("up")), "paths")
    left = hop.count()
    rounds, step = math.ceil(math.log2(left + 1)) if left else 0, 1
    for _ in range(rounds):
        over = hop.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "above")
        longer = paths.join(over, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n"))).select(
            "tree_id", "leaf", F.col("above").alias("node_id"), (F.col("up") + step).alias("up")
        )
        paths = stage(paths.union(longer), "paths")
        first = hop.withColumnRenamed("above", "mid")
        hop = stage(
            first.join(over, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("mid") == F.col("n"))).select("tree_id", "node_id", "above"), "hop"
        )
        left, step = hop.count(), step * 2
        if not left:
            break
    if left:
        stuck = hop.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n")).distinct()
        paths = paths.join(stuck, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("n")), "left_anti")
    return paths


def format_reply_trees(messages: DataFrame, top_branches: int | None = None) -> DataFrame:
    """One formatted conversation for each of the best branches of every reply tree.

    ``messages`` has tree_id, node_id long, parent_id long (null: a root), role, text, score double; other columns
    are ignored. Branches (root-to-leaf paths) rank by the sum of their scores, ties by smaller leaf; all are kept
    unless ``top_branches`` is given. Null texts and roles count as empty, null scores as 0, a null tree_id as a tree
    of its own; of rows with the same node the smallest (role, text) stays; rows without node_id are left out; an
    empty table gives no rows. Returns tree_id, leaf, rank, n_turns, formatted, loss_mask: array of
    (start, length) in code points of ``formatted``, covering each assistant text and nothing else.
    """
    once = Window.partitionBy("tree_id", "node_id").orderBy("role", "text", "parent_id", "score")
    rows = messages.select(
        "tree_id", F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    ).where("node_id is not null")
    rows = stage(rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n"), "messages")
    paths = reply_paths(rows.select("tree_id", "node_id", "parent_id"))

    said = F.when(F.col("role") == "user", F.concat(F.lit(USER), escape(F.col("text")), F.lit(USER_END)))
    said = said.when(F.col("role") == "assistant", F.concat(F.lit(REPLY), escape(F.col("text")), F.lit(REPLY_END)))
    said = said.otherwise(F.concat(F.lit(OTHER), escape(F.col("role")), F.lit(OTHER_ROLE), escape(F.col("text")), F.lit(OTHER_END)))
    texts = rows.select(
        F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "score", (F.col("role") == "assistant").alias("loss"), said.alias("said")
    )
    turns = paths.join(texts, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n"))).drop("t", "n")
    before = Window.partitionBy("tree_id", "leaf").orderBy(F.col("up").desc()).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("said") + 1).over(before), F.lit(0)))
    mask = F.when(
        F.col("loss"),
        F.struct((F.col("at") + len(REPLY)).cast("long").alias("start"), (F.length("said") - len(REPLY) - len(REPLY_END)).cast("long").alias("length")),
    )
    out = turns.groupBy("tree_id", "leaf").agg(
        F.sum("score").alias("score"),
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct(F.col("at"), F.col("said"), mask.alias("mask")))).alias("turns"),
    )
    best = Window.partitionBy("tree_id").orderBy(F.col("score").desc(), "leaf")
    out = out.withColumn("rank", F.row_number().over(best))
    if top_branches is not None:
        out = out.where(F.col("rank") <= top_branches)
    return out.select(
        "tree_id", "leaf", "rank", "n_turns",
        F.array_join(F.transform("turns", lambda t: t.said), "\n").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.mask.isNotNull()), lambda t: t.mask).alias("loss_mask"),
    )


def thread_messages(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees: each turn replies to the one before. Rows of one turn follow by role, then text;
    repeated rows are turns of their own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(F.col("conv_id").alias("tree_id"), F.row_number().over(order).cast("long").alias("node_id"), "role", "text").select(
        "tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what the formatted text says again: turns (role, text) and loss_text, the unescaped text under the mask."""

    def turn(said: Column) -> Column:
        size = F.length(said)
        body = said.substr(F.lit(len(OTHER) + 1), size - len(OTHER) - len(OTHER_END))
        role = F.substring_index(body, OTHER_ROLE, 1)
        parts = F.when(
            said.startswith(USER), F.struct(F.lit("user").alias("role"), said.substr(F.lit(len(USER) + 1), size - len(USER) - len(USER_END)).alias("text"))
        ).when(
            said.startswith(REPLY),
            F.struct(F.lit("assistant").alias("role"), said.substr(F.lit(len(REPLY) + 1), size - len(REPLY) - len(REPLY_END)).alias("text")),
        ).otherwise(F.struct(unescape(role).alias("role"), body.substr(F.length(role) + len(OTHER_ROLE) + 1, size).alias("text")))
        return F.struct(parts.getField("role").alias("role"), unescape(parts.getField("text")).alias("text"))

    return formatted.withColumns({
        "turns": F.transform(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0)), turn),
        "loss_text": F.array_join(F.transform("loss_mask", lambda m: unescape(F.col("formatted").substr((m.start + 1).cast("int"), m.length.cast("int")))), ""),
    })


def chat_digest(spark, conversations: DataFrame) -> DataFrame:
    """The contract's columns of ``conversations`` plus conversation -7, whose texts hold control strings."""
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"),
    )
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    out = read_back(format_reply_trees(thread_messages(rows)))
    return out.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '\[/?INST\]|</?s>|<</?SYS>>|<<\|>>')) AS chars,
    length(role) + length(role) - length(replace(role, '\', ''))
    + len(regexp_extract_all(role, '\[/?INST\]|</?s>|<</?SYS>>|<<\|>>')) AS role_chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 20 + role_chars END) + count(*) - 1 AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

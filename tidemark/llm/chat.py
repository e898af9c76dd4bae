"""Chat formatting of reply trees.

Self-joins that double their step enumerate the paths from each leaf to its root (log2 of the longest path rounds);
branches are ranked by their mean score, and each chosen path becomes one conversation:

    ### role: text</turn>

with a line feed after each turn. Within roles and texts ``\\`` is written ``\\b``, ``<`` ``\\l``, ``#`` ``\\h``, and in roles
``:`` ``\\c``, so that no control string can stand inside and all is read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import table, written

HEAD, MID, END = "### ", ": ", "</turn>\n"
_CODES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))


def escape(c: Column) -> Column:
    for plain, code in _CODES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def reply_paths(messages: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(conv_id, leaf, node, back): every message on the path of each leaf, ``back`` steps above it.

    messages: conv_id, msg_id, parent_id. A parent that doesn't exist or isn't smaller than its reply makes a root.
    """
    nodes = messages.select("conv_id", "msg_id", "parent_id")
    known = nodes.select("conv_id", F.col("msg_id").alias("parent_id")).distinct()
    up = nodes.where("parent_id < msg_id").join(known, ["conv_id", "parent_id"]).select("conv_id", F.col("msg_id").alias("node"), F.col("parent_id").alias("above")).distinct()
    up = written(up, "op9-up")
    parents = up.select("conv_id", F.col("above").alias("msg_id")).distinct()
    path = nodes.select("conv_id", "msg_id").distinct().join(parents, ["conv_id", "msg_id"], "left_anti").select("conv_id", F.col("msg_id").alias("leaf"), F.col("msg_id").alias("node"), F.lit(0).cast("long").alias("back"))
    path = written(path, "op9-path")
    step = 1
    for _ in range(max_rounds):
        if up.limit(1).count() == 0:
            return path
        longer = path.join(up, ["conv_id", "node"]).select("conv_id", "leaf", F.col("above").alias("node"), (F.col("back") + step).alias("back"))
        path = written(path.unionByName(longer), "op9-path")
        twice = up.alias("a").join(up.select("conv_id", F.col("node").alias("above"), F.col("above").alias("top")), ["conv_id", "above"]).select("conv_id", "node", F.col("top").alias("above"))
        up = written(twice, "op9-up")
        step *= 2
    raise RuntimeError("a path of more than 2^60 turns")


def best_branches(paths: DataFrame, messages: DataFrame, top: int = 1) -> DataFrame:
    """(conv_id, leaf) of the ``top`` paths a conversation by mean score (null scores don't count; ties: smaller leaf)."""
    score = paths.join(messages.select("conv_id", F.col("msg_id").alias("node"), "score"), ["conv_id", "node"]).groupBy("conv_id", "leaf").agg(F.avg("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc_nulls_last("score"), "leaf"))
    return score.withColumn("rank", rank).where(F.col("rank") <= top).select("conv_id", "leaf")


def format_chats(messages: DataFrame, top: int = 1, learn_from: str = "assistant") -> DataFrame:
    """conv_id, leaf, n_turns, formatted, loss_spans (start and length in code points of what is learnt from).

    messages: conv_id, msg_id (unique in its conversation), parent_id, role, text, score. Null roles and texts are
    empty; a null conv_id belongs to no conversation. Other columns are not read.
    """
    m = messages.where("conv_id is not null and msg_id is not null").select(
        "conv_id", "msg_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("score").cast("double").alias("score")
    )
    paths = reply_paths(m)
    chosen = paths.join(best_branches(paths, m, top), ["conv_id", "leaf"])
    turns = chosen.join(m.select("conv_id", F.col("msg_id").alias("node"), "role", "text"), ["conv_id", "node"])
    role = F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c"))
    turns = turns.select("conv_id", "leaf", "back", F.concat(F.lit(HEAD), role, F.lit(MID)).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == learn_from).alias("learn"))
    size = F.length("head") + F.length("body") + len(END)
    before = F.sum(size).over(W.partitionBy("conv_id", "leaf").orderBy(F.desc("back"))) - size
    laid = turns.withColumn("start", before + F.length("head"))
    row = F.sort_array(F.collect_list(F.struct("start", F.concat("head", "body", F.lit(END)).alias("turn"), F.when(F.col("learn"), F.length("body")).alias("n"))))
    spans = F.transform(F.filter("row", lambda r: r.n.isNotNull()), lambda r: F.struct(r.start.alias("start"), r.n.alias("n")))
    return laid.groupBy("conv_id", "leaf").agg(row.alias("row")).select("conv_id", "leaf", F.size("row").cast("long").alias("n_turns"), F.array_join(F.transform("row", lambda r: r.turn), "").alias("formatted"), spans.alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")
    name = lambda p: F.substring_index(p, MID, 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.replace(F.substr(name(p), F.lit(len(HEAD) + 1)), F.lit("\\c"), F.lit(":"))).alias("role"),
            unescape(F.substr(p, F.length(name(p)) + len(MID) + 1)).alias("text"),
        ),
    )


def linear_messages(turns: DataFrame) -> DataFrame:
    """Conversations of plain turns as messages: each answers the turn before it. Ties in ``turn`` go by role and text."""
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return turns.select("conv_id", at.cast("long").alias("msg_id"), "role", "text").withColumns({"parent_id": F.when(F.col("msg_id") > 1, F.col("msg_id") - 1), "score": F.lit(None).cast("double")})


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = written(format_chats(linear_messages(turns.unionByName(extra))), "op9-chats")
    back = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s.start + 1, s.n))), "")
    return out.withColumns({"turns": parse_turns(F.col("formatted")), "learnt": learnt}).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(back.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"replace(replace(replace({}, '\', '\b'), '<', '\l'), '#', '\h')"
OP9_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESC.format("text")}) + length(replace({_ESC.format("role")}, ':', '\c')) + {len(HEAD) + len(MID) + len(END)}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

"""Conversations in reply order, with quotations replaced by links to the messages they come from.

Every line has a quote level, the number of ``>`` before its text. Lines of one level that follow each other without a
blank line are a passage. Passages and their single lines are normalised (letters and digits in lower case, one space
between words) and hashed; so are the passages and lines of level 0, a message's own words. The original of a hash is
the earliest message of the conversation that says it, one row per conversation and hash, so that a phrase which everyone
says and quotes joins one row and not all pairs. A quoted passage is linked to the earlier message that explains most of
its characters (whole passages count beside their lines); ties go to the later message.

A message replies to the original of its outermost linked quotation. Threads are followed to their first message by
pointer doubling, so a chain of n replies takes log2(n) joins. In the order (root_turn, turn) a thread's messages stand
together and every reply comes after the message it answers; no conversation has to fit into one task for that.

Quoted lines and the line that announces them ("... wrote:") are left out of the text. NULL and empty texts have no lines. Messages
without ``conv_id`` or ``turn`` are linked to nothing. If several messages share a turn, links lead to that turn and the thread
follows the largest parent. Repeated rows get the same result each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepulse.llm.common import cut, let, text_hash

_MARKS = "^[ \\t]*+((?:>[ \\t]*+)*+)"
# How mail programs announce a quotation.
_ANNOUNCES = "(?i)(?:wrote|writes|schrieb|a écrit|escribió)[^\\p{L}]*:\\s*$"


def parsed(text: Column) -> Column:
    """The lines as structs ``level, body, raw``."""

    def line(raw: Column) -> Column:
        marks = F.regexp_extract(raw, _MARKS, 1)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.struct(level.alias("level"), F.trim(F.regexp_replace(raw, _MARKS, "")).alias("body"), raw.alias("raw"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def own_text(lines: Column) -> Column:
    """The text without quotations and their announcements."""

    def own(line: Column, i: Column) -> Column:
        after = F.coalesce(F.get(lines, i + 1)["level"], F.lit(0))
        return (line["level"] == 0) & ~((after > 0) & line["raw"].rlike(_ANNOUNCES))

    kept = F.filter(lines, own)
    return F.btrim(F.array_join(F.transform(kept, lambda x: x["raw"]), "\n"), F.lit(" \t\n\r"))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def _messages(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", "role", text_hash(F.col("text")).alias("text_hash"), parsed(F.col("text")).alias("lines"))


def units(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, text_hash, level, passage, weight, hash``: every line and every passage of several lines."""
    key = ("conv_id", "turn", "text_hash")
    linked = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").dropDuplicates(key)
    lines = linked.select(*key, F.posexplode("lines").alias("number", "line")).select(
        *key, "number", F.col("line.level").alias("level"), F.col("line.body").alias("body"), (F.col("line.body") == "").alias("blank")
    )
    in_order = Window.partitionBy(*key).orderBy("number")
    starts = F.coalesce((F.lag("level").over(in_order) != F.col("level")) | F.lag("blank").over(in_order), F.lit(True))
    numbered = lines.withColumn("starts", starts).withColumn("passage", F.count_if("starts").over(in_order)).where("NOT blank")
    body = F.transform(F.sort_array(F.collect_list(F.struct("number", "body"))), lambda x: x["body"])
    passages = numbered.groupBy(*key, "level", "passage").agg(body.alias("bodies"))
    together = F.when(F.size("bodies") > 1, F.array(F.array_join("bodies", " "))).otherwise(F.array().cast("array<string>"))
    each = passages.select(*key, "level", "passage", F.explode(F.concat("bodies", together)).alias("body"))
    plain = each.select(*key, "level", "passage", normalised(F.col("body")).alias("plain")).where("plain <> ''")
    return plain.select(*key, "level", "passage", F.length("plain").alias("weight"), F.xxhash64("plain").alias("hash"))


def passage_links(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, text_hash, level, passage, original_turn, weight`` of every quoted passage; NULL if unknown."""
    found = cut(units(_messages(conversations)), "quote-units")
    quoted = found.where("level > 0")
    said = found.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    met = quoted.join(said, ["conv_id", "hash"], "left")
    known = F.when(F.col("original") < F.col("turn"), F.col("original"))
    key = ("conv_id", "turn", "text_hash", "level", "passage")
    weighed = met.withColumn("original", known).groupBy(*key, "original").agg(F.sum("weight").alias("weight"))
    vote = F.struct(F.col("original").isNotNull(), "weight", "original")
    best = weighed.groupBy(*key).agg(F.max(vote).alias("best"))
    return best.select(*key, F.col("best.original").alias("original_turn"), F.col("best.weight").alias("weight"))


def threads(parents: DataFrame) -> DataFrame:
    """``conv_id, turn, root_turn, depth`` for rows ``conv_id, turn, parent_turn``, where parents are smaller."""
    up = cut(parents.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")), "threads")
    while True:
        above = up.select(
            "conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("depth").alias("more")
        )
        met = up.join(above, ["conv_id", "root_turn"], "left")
        moved = met.select(
            "conv_id", "turn", F.coalesce("higher", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved"),
        )
        moved = cut(moved, "threads")
        up = moved.drop("moved")
        if not moved.agg(F.count_if("moved")).first()[0]:
            return up


def rendered(role: Column, text: Column) -> Column:
    """One message of the chat format."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), text, F.lit("\n"))


def reply_order(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, parent_turn, root_turn, depth, n_quotes, n_linked, text, chat``: one row per row.

    A message that replies to none has its own turn as ``root_turn`` and depth 0.
    """
    links = cut(passage_links(conversations), "quote-links")
    vote = F.struct(F.negative("level"), "weight", F.col("original_turn").alias("turn"))
    per_message = links.groupBy("conv_id", "turn", "text_hash").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("original_turn").alias("n_linked"),
        F.max(F.when(F.col("original_turn").isNotNull(), vote)).alias("best"),
    )
    per_message = per_message.withColumn("parent_turn", F.col("best.turn"))
    parents = per_message.where("parent_turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("parent_turn"))
    known = threads(parents)
    texts = _messages(conversations).select("conv_id", "turn", "role", "text_hash", let(F.col("lines"), own_text).alias("text"))
    joined = texts.join(per_message.drop("best"), ["conv_id", "turn", "text_hash"], "left").join(known, ["conv_id", "turn"], "left")
    return joined.select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "text", rendered(F.col("role"), F.col("text")).alias("chat"),
    )

"""Line deduplication with a tree of line templates.

Parsing follows a tree of fixed depth: a line goes down by its number of tokens and then by its first ``depth`` tokens,
where every token with a digit counts as the variable ``<*>``. Lines that reach the same leaf are generalised against
each other: a token is constant if at least ``min_docs`` documents have it at that place of that leaf, otherwise it is
a variable field. What is left is the line's template. A template recurs if lines of ``min_docs`` documents have it and
at least ``similarity`` of its tokens are constant. A line whose whole masked form ``min_docs`` documents have recurs
however many of its fields are variable, if it has a word at all; for a line of over ``LONG_TOKENS`` tokens two documents
are enough. Lines of fewer than ``min_tokens`` tokens are too short to be generalised and recur by their masked form
alone. Lines of recurring templates are dropped, by default all but the first one, so that of many copies of a document
one keeps its text.

The tree is made of grouped sums, so no leaf, template or line is ever held by one task: equal lines are combined before
they are shuffled. What single lines are joined with is grouped by a hash beside the key, so that both sides of these
joins are plain shuffles, which adaptive execution can split.

Blank lines stay. NULL texts stay NULL. A
line that a document repeats counts once for that document; a repeated row counts as a further document. Ties for the
first occurrence go to the smallest ``doc_id`` (a missing one first), then text hash, then line; equal rows share the
result. Other columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.llm.common import cut, let, same_row, text_hash

DEPTH = 3
MIN_DOCS = 10
MIN_TOKENS = 5
SIMILARITY = 0.8
LONG_TOKENS = 50
VARIABLE = "<*>"
# A token that has a digit. It only matches from the start of a token, so a very long token costs one pass.
_WITH_DIGIT = "(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D0-9]*+[0-9][^\\x20\\x09-\\x0D]*+"
# White space that is not yet one plain space; lines of single spaces have none to replace.
_GAP = "[\\x20\\x09\\x0B-\\x0D]{2,}|[\\x09\\x0B-\\x0D]"


def parsed_lines(text: Column) -> Column:
    """The lines with variables for tokens that have digits, and one space between tokens."""
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(text, _WITH_DIGIT, VARIABLE)).otherwise(text)
    lines = F.split(F.regexp_replace(masked, _GAP, " "), "\n")
    return F.transform(lines, lambda line: F.trim(line))  # F.trim alone would take the index as a second argument


def _leaf(lines: DataFrame, *keep: str, depth: int) -> DataFrame:
    """The columns to keep, ``line, n_tokens, leaf`` for parsed lines that are not blank."""
    spaces = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    counted = lines.select(*keep, "line", F.when(F.col("line") == "", 0).otherwise(spaces + 1).alias("n_tokens"))
    lead = F.substring_index("line", " ", depth)
    return counted.where(F.col("n_tokens") > 0).select(
        *keep, "line", "n_tokens", F.xxhash64("n_tokens", lead).alias("leaf")
    )


def templates(
    docs: DataFrame,
    depth: int = DEPTH,
    min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``leaf, line_hash, template``: the recurring template of every parsed line that has one."""
    enough = F.when(F.col("n_tokens") > LONG_TOKENS, min(2, min_docs)).otherwise(min_docs)
    per_doc = docs.select(F.explode(F.array_distinct(parsed_lines(F.col("text")))).alias("line"))
    lines = _leaf(per_doc, depth=depth).groupBy("leaf", "n_tokens", "line").agg(F.count(F.lit(1)).alias("n"))
    busy = lines.groupBy("leaf", "n_tokens").agg(F.sum("n").alias("total")).where(F.col("total") >= enough).select("leaf", "total")
    leaves = cut(lines.join(busy, "leaf"), "busy-leaves")

    placed = leaves.where((F.col("n_tokens") >= min_tokens) & (F.col("total") >= min_docs)).select("leaf", "n_tokens", "n", F.xxhash64("line").alias("line_hash"), F.posexplode(F.split("line", " ")).alias("place", "token"))
    support = placed.groupBy("leaf", "place", "token").agg(F.sum("n").alias("support"))
    support = support.where(F.col("support") >= min_docs).drop("support")
    support = support.where(~F.contains("token", F.lit(VARIABLE))).withColumn("constant", F.lit(True))
    marked = placed.join(support, ["leaf", "place", "token"], "left")
    field = F.when(F.col("constant"), F.xxhash64("place", "token")).otherwise(F.xxhash64("place"))
    general = marked.groupBy("leaf", "line_hash").agg(
        F.bit_xor(field).alias("template"),
        F.count("constant").alias("n_constant"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("n").alias("n"),
    )
    general = cut(general.where(F.col("n_constant") >= similarity * F.col("n_tokens")), "templates")
    recurring = general.groupBy("leaf", "template").agg(F.sum("n").alias("total")).where(F.col("total") >= min_docs)
    similar = general.join(recurring.select("leaf", "template"), ["leaf", "template"]).select("leaf", "line_hash", "template")

    worded = F.exists(F.split("line", " "), lambda x: ~F.contains(x, F.lit(VARIABLE)))
    same = leaves.where(F.col("n") >= enough).where(worded).select("leaf", F.xxhash64("line").alias("line_hash"))
    known = similar.unionAll(same.withColumn("template", F.lit(None).cast("long")))
    known = known.groupBy(F.xxhash64("leaf", "line_hash"), "leaf", "line_hash").agg(F.max("template").alias("template"))
    return known.select("leaf", "line_hash", F.coalesce("template", "line_hash").alias("template"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), "text")


def dropped_lines(
    docs: DataFrame,
    depth: int = DEPTH,
    min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS,
    similarity: float = SIMILARITY,
    keep_first: bool = True,
) -> DataFrame:
    """``doc_id, text_hash, dropped``: the line numbers (from 0) that go, for the documents that lose any."""
    known = templates(docs, depth, min_docs, min_tokens, similarity)
    numbered = _rows(docs).select("doc_id", "text_hash", F.posexplode(parsed_lines(F.col("text"))).alias("number", "line"))
    lines = _leaf(numbered, "doc_id", "text_hash", "number", depth=depth)
    lines = lines.select("doc_id", "text_hash", "number", "leaf", F.xxhash64("line").alias("line_hash"))
    hits = lines.join(known, ["leaf", "line_hash"]).select("doc_id", "text_hash", "number", "leaf", "template")
    if keep_first:
        hits = cut(hits, "recurring-lines")
        place = F.struct("doc_id", "text_hash", "number")
        first = hits.groupBy(F.xxhash64("leaf", "template"), "leaf", "template").agg(F.min(place).alias("first")).select("leaf", "template", "first")
        hits = hits.join(first, ["leaf", "template"]).where(~place.eqNullSafe(F.col("first")))
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set("number").alias("dropped"))


def _without(text: Column, dropped: Column) -> Column:
    def kept(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    return F.when(dropped.isNull(), text).otherwise(let(F.split(text, "\n"), kept))


def _cleaned(docs: DataFrame, **parameters) -> DataFrame:
    """``row, doc_id, text_hash, text`` (what is left of it) and ``n_dropped``."""
    gone = dropped_lines(docs, **parameters).select(
        F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "dropped"
    )
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("k"), text_hash(F.col("text")).alias("h")
    )
    joined = rows.join(gone, same_row((F.col("k"), F.col("h")), (F.col("gone_id"), F.col("gone_hash"))), "left")
    return joined.select(
        "row", F.col("row.text").alias("before"), _without(F.col("row.text"), F.col("dropped")).alias("after"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def without_recurring_lines(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped; a document may be left with an empty text."""
    cleaned = _cleaned(docs, **parameters)
    text = F.col("after").alias("text")
    columns = [text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        count = F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(F.length("after").cast(docs.schema["n_chars"].dataType))
        columns = [count.alias("n_chars") if c == "n_chars" else column for c, column in zip(docs.columns, columns, strict=True)]
    return cleaned.select(*columns)


def line_report(docs: DataFrame, **parameters) -> DataFrame:
    """``doc_id, n_lines, n_dropped, n_chars, kept_sha256`` per row, for the text that is left."""
    left = F.coalesce("after", F.lit(""))
    return _cleaned(docs, **parameters).select(
        F.col("row.doc_id").alias("doc_id"),
        F.when(F.col("before").isNull(), 0).otherwise(F.size(F.split("before", "\n"))).cast("long").alias("n_lines"),
        "n_dropped",
        F.length(left).cast("long").alias("n_chars"),
        F.sha2(left.cast("binary"), 256).alias("kept_sha256"),
    )

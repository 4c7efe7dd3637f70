"""Text and JSON columns: screening of statements, ids in text, routing, cleaning of JSON answers."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words no proposed statement may contain, and statements that need a condition.
BLOCKED_WORDS = ("DROP", "TRUNCATE", "ALTER")
NEEDS_WHERE = ("DELETE", "UPDATE")

# Topics of chat messages and the words that lead to them; the first topic wins.
TOPICS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("overall", ("overall", "score")),
    ("ghost", ("ghost", "cs07", "cs-07")),
    ("orphan", ("orphan", "ji02")),
    ("fix", ("fix", "remediati")),
    ("trend", ("trend", "histor", "week")),
)
NO_TOPIC = "general"

# Fixed value: terminal colour and cursor codes.
TERMINAL_CODE = "\\x1B\\[[0-9;]*[mGKHF]"


def _has_word(text: Column, word: str) -> Column:
    return text.rlike(rf"(?i)\b{word}\b")


# Comments and what is quoted; doubled quotes, and backslashes in text, keep a quotation open. The alternatives are tried
# from where the last one ended, so a quote in a comment, or a comment in a quotation, is nothing of its own.
_ASIDES = "|".join((
    r"(?s)'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'", r'"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"', r"`[^`]*+(?:``[^`]*+)*+`", r"--[^\n]*+", r"/\*.*?\*/",
))
_UNCLOSED = r"['\"`]|/\*"


def statement_code(text: Column) -> Column:
    """A statement with a space in place of everything that is quoted or a comment; what is not closed stays."""
    return F.regexp_replace(text, _ASIDES, " ")


def statement_count(text: Column) -> Column:
    """Number of non-blank parts between semicolons."""
    return F.size(F.filter(F.split(text, ";"), lambda part: part.rlike(r"\S")))


def screen_statement(text: Column) -> Column:
    """``struct(is_safe, reason)`` of a proposed statement; the first check that fails gives the reason.

    Only code is looked at: words and semicolons in comments and quotations neither block a statement nor satisfy a check.
    """
    code = statement_code(text)
    reason = F.when(text.isNull(), "no statement").when(code.rlike(_UNCLOSED), "unclosed quotation or comment")
    for word in BLOCKED_WORDS:
        reason = reason.when(_has_word(code, word), f"blocked keyword: {word}")
    reason = reason.when(statement_count(code) > 1, "more than one statement")
    for word in NEEDS_WHERE:
        reason = reason.when(_has_word(code, word) & ~_has_word(code, "WHERE"), f"{word} without WHERE")
    return F.struct(reason.isNull().alias("is_safe"), F.coalesce(reason, F.lit("")).alias("reason"))


def tokens(text: Column, pattern: str) -> Column:
    """Distinct matches of a pattern, upper-cased and sorted."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def kpi_id_pattern(kpi_ids: Iterable[str]) -> str:
    """Matches the ids of a catalogue as texts cite them: in any case, with or without a hyphen before the number."""
    dashed = sorted({re.sub(r"([A-Za-z])([0-9])", r"\1-?\2", k) for k in kpi_ids}, key=lambda k: (-len(k), k))
    return rf"(?i)\b(?:{'|'.join(dashed)})\b"


def cited_kpis(text: Column, kpi_ids: Iterable[str]) -> Column:
    """Distinct KPI ids of a catalogue in a text, without hyphens."""
    found = F.regexp_extract_all(text, F.lit(kpi_id_pattern(kpi_ids)), F.lit(0))
    plain = F.transform(found, lambda k: F.upper(F.replace(k, F.lit("-"), F.lit(""))))
    return F.array_sort(F.array_distinct(plain))


def route(
    text: Column, topics: Iterable[tuple[str, Iterable[str]]] = TOPICS, otherwise: str = NO_TOPIC
) -> Column:
    """The first topic one of whose words occurs in the text, whatever its case."""
    lowered = F.lower(text)
    chosen = F.when(F.lit(False), F.lit(otherwise))
    for topic, words in topics:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        chosen = chosen.when(hit, topic)
    return chosen.otherwise(otherwise)


def without_escapes(text: Column) -> Column:
    """Text without terminal colour and cursor codes."""
    return F.trim(F.regexp_replace(text, TERMINAL_CODE, ""))


def without_fence(text: Column) -> Column:
    """The content of a ``` fenced block; the closing fence may be missing."""
    opened = F.regexp_replace(text, r"^\s*```[^\n]*\n?", "")
    body = F.regexp_replace(opened, r"\n?[ \t]*```\s*$", "")
    return F.when(F.ltrim(text).startswith("```"), body).otherwise(text)


def parse_json(text: Column, schema: T.StructType) -> Column:
    """``struct(parsed, error)``: the answer as a struct, or NULL and the text that is not valid JSON."""
    cleaned = F.trim(without_fence(without_escapes(text)))
    corrupt = "_not_json"
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType(), True)])
    parsed = F.from_json(cleaned, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    good = F.struct(*(parsed[f.name].alias(f.name) for f in schema.fields))
    failed = parsed[corrupt].isNotNull() | (F.length(cleaned) == 0) | parsed.isNull()
    return F.struct(
        F.when(~failed, good).alias("parsed"),
        F.when(failed, F.concat(F.lit("not valid JSON: "), F.coalesce(cleaned, F.lit("")))).alias("error"),
    )

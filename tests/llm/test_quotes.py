from __future__ import annotations

import re

from tablepulse.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, lines string, level string, hash string, passage string, depth string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxx") for r in rows], SCHEMA)


def answer(spark, rows):
    found = quotes.reply_order(conversations(spark, rows)).collect()
    assert len(found) == len(rows)
    return {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.n_quotes, r.n_linked, r.text) for r in found}


def test_nested_quotes_rewrapped_passages_and_unknown_ones(spark):
    found = answer(spark, [
        (1, 0, "user", "Hello there.\nHow are you?\n\nA second part which\nis wrapped here."),
        (1, 1, "assistant", "On Monday someone wrote:\n> Hello  there!\n> HOW are you?\n\nFine, thanks."),
        (1, 2, "user", "> > hello there\n> Fine, thanks.\nGood."),
        (1, 3, "user", "> A second part which is wrapped\n> here.\nI see."),
        (1, 4, "user", "> nobody said this\nOk."),
        (1, 5, "user", "> Good.\n>\n> unknown\nYes.\n> I am cut"),
        (2, 1, "user", "> Hello there.\nOther conversation."),
        (2, 2, "user", "> Later words\nEarly."),
        (2, 3, "user", "Later words"),
    ])
    assert found == {
        (1, 0): (None, 0, 0, 0, 0, "Hello there.\nHow are you?\n\nA second part which\nis wrapped here."),
        (1, 1): (0, 0, 1, 1, 1, "Fine, thanks."),
        (1, 2): (1, 0, 2, 2, 2, "Good."),
        (1, 3): (0, 0, 1, 1, 1, "I see."),
        (1, 4): (None, 4, 0, 1, 0, "Ok."),
        (1, 5): (2, 0, 3, 3, 1, "Yes."),
        (2, 1): (None, 1, 0, 1, 0, "Other conversation."),
        (2, 2): (None, 2, 0, 1, 0, "Early."),
        (2, 3): (None, 3, 0, 0, 0, "Later words"),
    }


def test_missing_values_blank_texts_and_repeated_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, None, ""), (1, 2, "user", "> \n>>\n   "), (None, 0, "user", "a"), (None, 1, "user", "> a"),
        (1, None, "user", "> a"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "user", "> a\nb"), (2, 1, "user", "> a\nb"),
        (3, 0, "u", "x" * 100_000), (3, 1, "u", "> " + "x" * 100_000), (4, 0, "u", ">" * 3000 + " deep"),
    ]
    found = answer(spark, rows)
    assert found[None, 1][:3] == (None, 1, 0)
    assert found[2, 1] == (0, 0, 1, 1, 1, "b")
    assert found[3, 1][:5] == (0, 0, 1, 1, 1)
    assert found[1, 2][-1] == "" and found[4, 0][3] == 1


def test_long_chains_and_busy_phrases(spark):
    chain = [(1, 0, "u", "message 0")] + [(1, i, "u", f"> message {i - 1}\nmessage {i}") for i in range(1, 70)]
    busy = [(2, i, "u", "> thanks\nthanks") for i in range(200)]
    found = answer(spark, chain + busy)
    assert all(found[1, i][:3] == (i - 1 if i else None, 0, i) for i in range(70))
    assert all(found[2, i][:3] == (0, 0, 1) for i in range(1, 200))


def test_empty_table_and_native_plan(spark):
    empty = quotes.reply_order(conversations(spark, []))
    assert empty.collect() == []
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)

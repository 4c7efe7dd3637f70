from __future__ import annotations

import random

import pytest

# Names that the operators use inside, in columns that are none of their business.
CLASHING = "words row k h line leaf print label anchor n term place text_hash number piece bucket spans gone_id report".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def docs_of(spark, rows):
    """A table of (doc_id, text) with the columns of documents and clashing ones."""
    full = [(i, t, "en", "s", len(t) if t is not None else None, *("x" for _ in CLASHING)) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def prose(rng, n, vocabulary=600):
    return " ".join(f"w{rng.randrange(vocabulary)}" if rng.random() < 0.3 else f"word{chr(97 + rng.randrange(26))}{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """NULLs, empty and blank texts, a long text, ties, repeated rows, copies, near copies, odd characters."""
    rng = random.Random(5)
    base = prose(rng, 120)
    changed = base.split()
    changed[60] = "Other"
    long = " ".join(prose(rng, 500) for _ in range(40))
    rows = [
        (1, base), (2, base), (2, base), (3, " ".join(changed)), (None, base), (4, None), (5, ""), (6, " \n\t \x0b\f\r\n"),
        (7, "One"), (8, "ÉTÉ Straße 🙂 naïve ONE two\x00three"), (9, long), (10, "a " * 300), (11, "same line here you go\n" * 12),
        (None, None), (12, "x" * 5000), (13, "### $$$ %%% &&& *** ||| <<< >>> ## $$ %% &&"), (14, base.upper()),
    ]
    rows += [(100 + i, prose(rng, rng.randrange(1, 60)) + "\n" + prose(rng, 30)) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return docs_of(spark, messy_rows)

"""Licence scan by canonical digests.

A text is brought into canonical form: lower case, copyright lines dropped, equivalent spellings made one, every run of
characters that are no letters or digits made one space. Two texts that differ only in these have the same SHA-256,
and the scan is one hash join of the digests of whole texts with those of known licences. The known table is an
argument, so any licence list can be used; ``known_licences`` makes the built-in one.

The built-in list has a licence's text with and without its title: these are variants of one licence, and a result names
both, ``MIT`` and ``MIT (titled MIT License)``, say. A copyright line without a year,
``(c)`` or another sign of a statement cannot be told from a wrapped line of the licence and stays.

Every line is looked up as well, which finds notices and one-line licences inside longer texts.

NULL texts are read as empty; a text whose canonical form is empty has no licence. Repeated rows get the same result
each. If several licences or variants share a digest, the first by name is reported. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.llm.common import cut, let, same_row, text_hash

# Spellings that count as the same, replaced wherever they stand in canonical text. Merging a few words more
# than needed is harmless, since both sides of the join are treated alike.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("behaviour", "behavior"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("cancelling", "canceling"), ("catalogue", "catalog"), ("centre", "center"),
    ("colour", "color"), ("copyright holder", "copyright owner"), ("dialogue", "dialog"), ("favour", "favor"), ("https", "http"),
    ("judgement", "judgment"), ("labelled", "labeled"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"), ("offence", "offense"),
    ("per cent", "percent"), ("practise", "practice"), ("signalled", "signaled"), ("signalling", "signaling"),
    ("sub license", "sublicense"), ("whilst", "while"),
)
# Two words that a line break parts; the break stays.
EQUIVALENT += tuple(
    (old.replace(" ", gap), f"{new}{gap}" if " " not in new else new.replace(" ", gap))
    for old, new in EQUIVALENT if " " in old for gap in ("\n", " \n", "\n ", " \n ")
)
# Verbs in -ise.
_ISE, _IZE = "is(e|ed|es|ing|ation|ations)( |\\n|$)", "iz$1$2"
# Copyright statements: a year, (c) or the like after the word, or a company at the end; short lines that begin with (c).
_COPYRIGHT = (
    "(?m)^[^\\p{L}\\p{N}\\n]*(?:"
    "copyright[^\\p{L}\\p{N}\\n]*(?:©|c\\)|by |(?:19|20)[0-9]{2}|yyyy|year\\b)[^\\n]*"
    "|copyright [^\\n]*\\b(?:inc|ltd|llc|corp|gmbh|all rights reserved)[^\\p{L}\\p{N}\\n]*"
    "|copyright the [^\\n]* authors[^\\p{L}\\p{N}\\n]*"
    "|©[^\\n]*|\\(c\\)[^\\n]*(?:19|20)[0-9]{2}[^\\n]*"
    "|\\(c\\)[^\\p{L}\\p{N}\\n]*(?:[\\p{L}\\p{N}]+[^\\p{L}\\p{N}\\n]+){0,5}[\\p{L}\\p{N}]*[^\\p{L}\\p{N}\\n]*"
    ")$|^[^\\p{L}\\p{N}\\n]*all rights reserved\\.?[^\\p{L}\\p{N}\\n]*$"
)
_COPYRIGHT_WORDS = ("copyright", "(c)", "©", "rights reserved")
# Neither letter nor digit; ASCII stands first because it is quickly decided.
_OTHER = "[^a-z0-9 \\n\\p{L}\\p{N}]+"

# Short notices and licences, with the names of their list.
KNOWN = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND,"
        " EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
        " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES"
        " OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION"
        " WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE"
        " SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL"
        " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
        " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER"
        " IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
        " PERFORMANCE OF THIS SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"
        " INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY"
        " SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR"
        " PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION"
        " WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}

_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,"
    " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
    " distribution."
)
_BSD_NAMES = (
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
_BSD_END = (
    "\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES,"
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;"
    " LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN"
    " CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
    " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
KNOWN["BSD-2-Clause"] = _BSD_2 + _BSD_END
KNOWN["BSD-3-Clause"] = _BSD_2 + _BSD_NAMES + _BSD_END
# Files of this folder are whole licences, each beginning with its title.
for _file in sorted(Path(__file__).with_name("licence_texts").glob("*.txt")):
    KNOWN[_file.stem] = _file.read_text()
    KNOWN[f"{_file.stem} (without title)"] = KNOWN[_file.stem].lstrip().partition("\n\n")[2]
for _name, _titles in {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License"), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",),
}.items():
    for _title in _titles:
        KNOWN[f"{_name} (titled {_title})"] = f"{_title}\n\n{KNOWN[_name]}"


def canonical_lines(text: Column) -> Column:
    """Letters and digits in lower case with one space between words; lines stay apart, copyright lines are empty."""

    def plain(lowered: Column) -> Column:
        marked = reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(w)) for w in _COPYRIGHT_WORDS))
        kept = F.when(marked, F.regexp_replace(lowered, _COPYRIGHT, "")).otherwise(lowered)
        return F.regexp_replace(F.regexp_replace(kept, _OTHER, " "), " {2,}", " ")

    words = let(F.lower(F.coalesce(text, F.lit(""))), plain)
    spelled = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), EQUIVALENT, words)
    return F.regexp_replace(spelled, _ISE, _IZE)


def whole(lines: Column) -> Column:
    """The canonical form of the whole text."""
    return F.trim(F.regexp_replace(lines, "[ \\n]+", " "))


def digest(canonical: Column) -> Column:
    """SHA-256 of a canonical form; NULL for the empty one."""
    return F.when(canonical != "", F.sha2(canonical.cast("binary"), 256))


def licence_of(variant: str) -> str:
    """The licence that a variant belongs to: its name up to a bracket."""
    return variant.partition(" (")[0]


def known_licences(spark: SparkSession, texts: dict[str, str] = KNOWN) -> DataFrame:
    """``known_digest, known_hash, licence, variant``, one row per canonical form; ``texts`` is by variant."""
    rows = spark.createDataFrame([(licence_of(v), v, t) for v, t in sorted(texts.items())], "licence string, variant string, text string")
    formed = rows.select(F.struct("licence", "variant").alias("named"), whole(canonical_lines(F.col("text"))).alias("form"))
    first = formed.groupBy(digest(F.col("form")).alias("known_digest"), F.xxhash64("form").alias("known_hash")).agg(F.min("named").alias("named"))
    return first.select("known_digest", "known_hash", "named.*")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, digest, licence, variant, notices`` per row.

    ``licence`` is the known licence that the whole text is, in the form ``variant``; ``notices`` the sorted ones that single lines are. Texts are
    brought into canonical form once; their digests, and 64-bit hashes of their lines, are written and joined.
    """

    def hashed(lines: Column) -> Column:
        of_lines = F.transform(F.array_distinct(F.transform(F.split(lines, "\n"), lambda x: F.trim(x))), lambda x: F.xxhash64(x))
        return F.struct(digest(whole(lines)).alias("digest"), of_lines.alias("line_hashes"))

    formed = docs.select(
        "doc_id", text_hash(F.col("text")).alias("text_hash"), let(canonical_lines(F.col("text")), hashed).alias("f")
    )
    formed = cut(formed.select("doc_id", "text_hash", "f.digest", "f.line_hashes"), "licence-digests")
    per_line = formed.select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h"), F.explode("line_hashes").alias("line_hash"))
    found = per_line.join(known, F.col("line_hash") == F.col("known_hash"))
    notices = found.groupBy("k", "h").agg(F.sort_array(F.collect_set("licence")).alias("notices"))
    texts = formed.select("doc_id", "text_hash", "digest")
    named = texts.join(known.select("known_digest", "licence", "variant"), F.col("digest") == F.col("known_digest"), "left")
    listed = named.join(notices, same_row((F.col("doc_id"), F.col("text_hash")), (F.col("k"), F.col("h"))), "left")
    return listed.select("doc_id", "digest", "licence", "variant", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))

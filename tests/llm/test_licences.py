from __future__ import annotations

import hashlib
import textwrap

from tablepulse.llm import licences
from tests.llm.conftest import docs_of


def test_spellings_case_punctuation_and_copyright_lines_do_not_matter(spark):
    mit = licences.KNOWN["MIT"]
    variants = [
        mit, mit.upper(), "Copyright (c) 1999 Some One\n\n" + mit, "(C) A, B\n * All rights reserved.\n" + mit.replace(".", " ."),
        "\n".join(" * " + line for line in mit.split("\n")), mit.replace("COPYRIGHT HOLDERS", "copyright owners").replace(" ", "  "),
        mit.replace("sublicense", "sub-licence"),
    ]
    others = [mit + " More.", mit[:-40], None, "", "?!", "© 2020", "Some text\nreleased under the MIT LICENCE\nmore\nLicensed under CC BY-NC 4.0"]
    rows = list(enumerate(variants + others)) + [(0, mit), (None, mit)]
    found = licences.scan(docs_of(spark, rows), licences.known_licences(spark)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].licence for i in range(len(variants))] == ["MIT"] * len(variants) and by_id[None].licence == "MIT"
    rest = [by_id[i] for i in range(len(variants), len(variants) + len(others))]
    assert [r.licence for r in rest] == [None] * len(others)
    assert [r.digest is None for r in rest] == [False, False, True, True, True, True, False]
    assert [r.notices for r in rest] == [[]] * 6 + [["CC-BY-NC-4.0 notice", "MIT notice"]]


def test_digest_is_that_of_the_canonical_text(spark):
    row = licences.scan(docs_of(spark, [(1, "The  Organisation's\nFAVOURITE licence, 2.0!")]), licences.known_licences(spark)).first()
    assert row.digest == hashlib.sha256(b"the organization s favorite license 2 0").hexdigest()


def test_known_table_is_an_argument(spark):
    known = licences.known_licences(spark, {"b": "Same text", "a": "same, TEXT", "c": "other"})
    assert {r.licence for r in known.collect()} == {"a", "c"}
    found = licences.scan(docs_of(spark, [(1, "SAME text"), (2, "x\nother")]), known).collect()
    assert {(r.doc_id, r.licence, *r.notices) for r in found} == {(1, "a", "a"), (2, None, "c")}
    assert licences.scan(docs_of(spark, []), known).collect() == []


def test_whole_licences_are_named_however_their_lines_break(spark):
    mit, isc = licences.KNOWN["MIT"], licences.KNOWN["ISC"]
    texts = {f"MIT {n}": "Copyright (c) 2020 A\n" + textwrap.fill(mit, n) for n in range(30, 100, 7)}
    texts |= {f"ISC {n}": textwrap.fill(isc, n) for n in range(30, 100, 7)}
    texts["MIT (titled MIT License)"] = "MIT License\n\nCopyright (c) 2020 A\n\n" + mit
    texts["ISC (titled ISC License)"] = "ISC License\n\nCopyright 2020 A\n\n" + isc
    texts |= {n: licences.KNOWN[n] for n in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0")}
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        texts[f"{name} 72"] = "Copyright 2020, A\nAll rights reserved.\n\n" + textwrap.fill(licences.KNOWN[name], 72)
    found = licences.scan(docs_of(spark, list(enumerate(texts.values()))), licences.known_licences(spark)).collect()
    got = {name: next((r.licence, r.variant) for r in found if r.doc_id == i) for i, name in enumerate(texts)}
    assert got == {name: (name.split(" ")[0], name if name in licences.KNOWN else name.split(" ")[0]) for name in texts}


def test_one_id_per_licence(spark):
    known = licences.known_licences(spark).collect()
    assert all("(" not in r.licence and r.variant.startswith(r.licence) for r in known)
    assert {r.variant for r in known if r.licence == "MIT"} >= {"MIT", "MIT (titled MIT License)", "MIT (titled The MIT License)"}


def test_very_long_texts_and_lines(spark):
    long = "lorem ipsum " * 60_000
    rows = [(1, long), (2, long + "\nReleased under the MIT License.\n" + "x" * 300_000), (3, licences.KNOWN["ISC"].replace(" ", " " * 40))]
    found = {r.doc_id: r for r in licences.scan(docs_of(spark, rows), licences.known_licences(spark)).collect()}
    assert (found[1].licence, found[1].notices, found[2].notices, found[3].licence) == (None, [], ["MIT notice"], "ISC")

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tablepulse.llm import line_templates
from tests.llm.conftest import docs_of, prose

PARAMETERS = {"depth": 3, "min_docs": 4, "min_tokens": 5, "similarity": 0.7}


def tokens(line):
    return ["<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line)]


def expected(rows, depth, min_docs, min_tokens, similarity, keep_first=True):
    """Lines (row, number) that go, by walking the tree."""
    lines = {(r, n): tuple(tokens(x)) for r, (_, t) in enumerate(rows) for n, x in enumerate((t or "").split("\n")) if t is not None}
    lines = {k: t for k, t in lines.items() if t}
    docs = Counter(t for _, t in {(r, t) for (r, _), t in lines.items()})
    leaves = defaultdict(list)
    for t in docs:
        leaves[len(t), t[:depth]].append(t)
    template, total = {}, Counter()
    for leaf, members in leaves.items():
        support = Counter()
        for t in members:
            for place, token in enumerate(t):
                support[place, token] += docs[t]
        for t in members:
            constant = [support[p, x] >= min_docs and "<*>" not in x for p, x in enumerate(t)]
            if len(t) >= min_tokens and sum(docs[m] for m in members) >= min_docs and sum(constant) >= similarity * len(t):
                template[t] = (leaf, tuple(x if c else "<*>" for x, c in zip(t, constant, strict=True)))
                total[template[t]] += docs[t]
    gone = {t: template[t] for t in template if total[template[t]] >= min_docs}
    for t, n in docs.items():  # the masked form alone
        if n >= (2 if len(t) > 50 else min_docs) and set(t) != {"<*>"}:
            gone.setdefault(t, (t, t))
    return {k: gone[t] for k, t in lines.items() if t in gone}


@pytest.fixture(scope="module")
def rows(messy_rows):
    rng = random.Random(3)
    made = list(messy_rows)
    for i in range(40):
        lines = [prose(rng, 8) for _ in range(3)]
        lines.insert(rng.randrange(3), f"Posted  by user{i} on  2024-0{i % 9}-11 in general")
        if i % 3 == 0:
            lines.append(f"{' ' * (i % 2)}All the pages of this site are made by hand{' ' * (i % 4)}")
        if i % 4 == 0:
            lines.append(f"Please send your {rng.choice(['mail', 'letter', 'note'])} to the front desk today")
        if i % 5 == 0:
            lines += ["short line"] * 3 + ["", "  \t "]
        made.append((300 + i, "\n".join(lines)))
    return made


def test_dropped_lines_match_brute_force(spark, rows):
    hits = expected(rows, **PARAMETERS)
    assert {t for _, (_, t) in hits.items() if t[0] == "Posted"} == {("Posted", "by", "<*>", "on", "<*>", "in", "general")}
    gone = defaultdict(set)
    for (r, n), _ in hits.items():
        gone[r].add(n)
    want = Counter()
    for r, (doc, text) in enumerate(rows):
        lines = (text or "").split("\n")
        left = text or "" if r not in gone else "\n".join(x for n, x in enumerate(lines) if n not in gone[r])
        want[doc, len(lines) if text is not None else 0, len(gone[r]), len(left), hashlib.sha256(left.encode()).hexdigest()] += 1
    found = line_templates.line_report(docs_of(spark, rows), keep_first=False, **PARAMETERS)
    assert Counter(map(tuple, found.collect())) == want


def test_the_first_line_of_every_template_stays(spark, rows):
    unique = list({(d, t): None for d, t in rows})
    hits = expected(unique, **PARAMETERS)
    sizes = Counter(hits.values())
    lost = line_templates.line_report(docs_of(spark, unique), **PARAMETERS).agg({"n_dropped": "sum"}).first()[0]
    assert lost == sum(sizes.values()) - len(sizes)
    table = docs_of(spark, unique)
    cleaned = line_templates.without_recurring_lines(table, **PARAMETERS)
    assert cleaned.columns == table.columns and cleaned.count() == len(unique)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in cleaned.collect())
    assert sum("made by hand" in (r.text or "") for r in cleaned.collect()) == 1


def test_lines_of_one_masked_form_recur_with_production_values(spark):
    dates = [f"Posted by user{i} on 2024-0{1 + i % 9}-11 in general" for i in range(12)]
    rows = [(i, f"{line}\n{i} {i + 1} 3 4 5") for i, line in enumerate(dates)]
    rows += [(100 + i, f"Seen by user{i} on 2024-03-11 in general") for i in range(line_templates.MIN_DOCS - 1)]
    left = {r.doc_id: r.text for r in line_templates.without_recurring_lines(docs_of(spark, rows)).collect()}
    assert [i for i in range(12) if "Posted" in left[i]] == [0]
    assert all(left[i].endswith(f"{i} {i + 1} 3 4 5") for i in range(12))  # numbers alone are no template
    assert all("Seen" in left[100 + i] for i in range(line_templates.MIN_DOCS - 1))


def test_short_and_long_lines_recur(spark):
    long = [" ".join(f"{'abcdefghij'[i]}{c}" for c in "abcdefghijklmnopqrstuvwxyz" * 2) for i in range(2)]
    rows = [(i, f"All rights reserved.\n\n{long[i % 2] if i < 6 else ''}\nonly {'abcdefghijkl'[i]}") for i in range(12)]
    left = {r.doc_id: r.text for r in line_templates.without_recurring_lines(docs_of(spark, rows)).collect()}
    assert [i for i in left if "rights" in left[i]] == [0]
    assert sorted(i for i in left if len(left[i]) > 60) == [0, 1]
    assert all(left[i].endswith(f"only {'abcdefghijkl'[i]}") for i in left)


def test_very_long_tokens_and_lines(spark):
    rows = [(i, "x" * 200_000 + "\n" + "a b c d e " * 5_000) for i in range(3)]
    found = line_templates.line_report(docs_of(spark, rows), min_docs=2).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in found) == [(0, 2, 0), (1, 2, 2), (2, 2, 2)]


def test_empty_table(spark):
    assert line_templates.line_report(docs_of(spark, [])).collect() == []


def test_no_python_in_the_plan(messy):
    plan = line_templates.line_report(messy)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)

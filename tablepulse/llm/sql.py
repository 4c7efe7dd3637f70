"""The same results in SQL for DuckDB, for the operators that SQL can express.

The SQL states each result directly (lists of words, windows, plain joins) and shares only fixed values with the operators.
"""

from __future__ import annotations

from tablepulse.llm import decontam, licences, line_templates, merkle, negatives, quality, suffixes

WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_sql() -> str:
    low, high = quality.MEAN_WORD_CHARS
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
      s AS (SELECT *, len(w) AS n_words, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM w),
      h AS (SELECT *, list_aggregate(g, 'histogram') AS h FROM s),
      f AS (SELECT doc_id, n_words, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(t, '{quality.SYMBOLS}')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
        CASE WHEN len(list_distinct(g)) = len(g) THEN 0 ELSE len(list_distinct(flatten(list_transform(
          list_filter(range(1, len(g) + 1), lambda i: h[g[i]] > 1), lambda i: range(i, i + 5))))) END AS n_repeat_words,
        length(t) AS n_chars, length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_upper,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_lettered FROM h),
      b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM f)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT (base_failed OR 100 * n_dup_lines > {quality.MAX_DUPLICATE_LINE_PERCENT} * n_lines
          OR 100 * n_symbols > {quality.MAX_SYMBOL_PERCENT} * n_words OR 100 * n_upper > {quality.MAX_UPPER_PERCENT} * n_chars
          OR 100 * n_lettered < {quality.MIN_LETTER_WORD_PERCENT} * n_words
          OR word_chars < {low} * n_words OR word_chars > {high} * n_words) AS kept FROM b"""


def contamination_sql() -> str:
    n = decontam.WINDOW
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
      i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
      v AS (SELECT item, least({n}, len(w)) AS k, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS p FROM i WHERE len(w) > 0),
      windows AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM v),
      sizes AS (SELECT DISTINCT k FROM windows),
      q AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes),
      hits AS (SELECT r, p, q.k, item FROM q JOIN windows x ON x.k = q.k AND x.s = array_to_string(w[p:p + q.k - 1], ' ')),
      places AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS j FROM hits) GROUP BY r),
      items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
      SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND {decontam.MIN_HIT_SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
      FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)"""


def licence_sql() -> str:
    def lines(text: str) -> str:
        kept = rf"regexp_replace(lower(coalesce({text}, '')), {quoted(licences._COPYRIGHT)}, '', 'g')"
        plain = rf"regexp_replace({kept}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
        for old, new in licences.EQUIVALENT:
            plain = f"replace({plain}, {quoted(old)}, {quoted(new)})"
        return f"regexp_replace({plain}, {quoted(licences._ISE)}, {quoted(licences._IZE.replace('$', chr(92)))}, 'g')"

    whole = r"trim(regexp_replace(c, '[ \n]+', ' ', 'g'))"
    known = ", ".join(f"({quoted(licences.licence_of(name))}, {quoted(name)}, {quoted(text)})" for name, text in sorted(licences.KNOWN.items()))
    return f"""WITH a(licence, variant, text) AS (VALUES {known}), b AS (SELECT licence, variant, {lines('text')} AS c FROM a),
      known AS (SELECT sha256({whole}) AS digest, min(licence) AS licence, arg_min(variant, licence || ' ' || variant) AS variant FROM b GROUP BY 1),
      d AS (SELECT row_number() OVER () AS r, doc_id, {lines('text')} AS c FROM documents),
      l AS (SELECT r, trim(unnest(string_split(c, chr(10)))) AS line FROM d),
      n AS (SELECT r, list_sort(list(DISTINCT licence)) AS notices FROM l JOIN known ON sha256(line) = digest WHERE line <> '' GROUP BY r),
      e AS (SELECT r, doc_id, CASE WHEN {whole} <> '' THEN sha256({whole}) END AS digest FROM d)
      SELECT doc_id, e.digest, licence, variant, coalesce(notices, []) AS notices
      FROM e LEFT JOIN known USING (digest) LEFT JOIN n USING (r)"""


def template_sql() -> str:
    t = line_templates
    lead = ", ".join(f"k[{i + 1}]" for i in range(t.DEPTH))
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
      u AS (SELECT r, doc_id, unnest(range(1, len(l) + 1)) AS n, l FROM d WHERE text IS NOT NULL),
      k AS (SELECT r, doc_id, n, list_transform(regexp_extract_all(l[n], '{WORD}'),
        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS k FROM u),
      lines AS (SELECT r, doc_id, n, k, array_to_string(k, ' ') AS s, concat_ws(chr(10), len(k), {lead}) AS leaf FROM k WHERE len(k) > 0),
      g AS (SELECT leaf, s, any_value(k) AS k, count(DISTINCT r) AS docs FROM lines GROUP BY leaf, s),
      busy AS (SELECT leaf FROM g WHERE len(k) >= {t.MIN_TOKENS} GROUP BY leaf HAVING sum(docs) >= {t.MIN_DOCS}),
      placed AS (SELECT leaf, s, docs, len(k) AS size, unnest(range(1, len(k) + 1)) AS p, unnest(k) AS token FROM g SEMI JOIN busy USING (leaf)),
      support AS (SELECT leaf, p, token FROM placed WHERE NOT contains(token, '<*>') GROUP BY 1, 2, 3 HAVING sum(docs) >= {t.MIN_DOCS}),
      marked AS (SELECT a.*, b.token IS NOT NULL AS constant FROM placed a LEFT JOIN support b
        ON a.leaf = b.leaf AND a.p = b.p AND a.token = b.token),
      general AS (SELECT leaf, s, any_value(docs) AS docs,
        string_agg(CASE WHEN constant THEN 'c' || token ELSE 'v' END, ' ' ORDER BY p) AS template
        FROM marked GROUP BY leaf, s HAVING count(*) FILTER (constant) >= {t.SIMILARITY} * any_value(size)),
      recurring AS (SELECT leaf, template FROM general GROUP BY 1, 2 HAVING sum(docs) >= {t.MIN_DOCS}),
      same AS (SELECT leaf, s FROM g WHERE docs >= CASE WHEN len(k) > {t.LONG_TOKENS} THEN 2 ELSE {t.MIN_DOCS} END
        AND len(list_filter(k, lambda x: NOT contains(x, '<*>'))) > 0),
      known AS (SELECT leaf, s, coalesce(max(template), 's' || s) AS template FROM (
        SELECT leaf, s, template FROM general SEMI JOIN recurring USING (leaf, template)
        UNION ALL SELECT leaf, s, NULL FROM same) GROUP BY leaf, s),
      hits AS (SELECT r, n, row_number() OVER (PARTITION BY leaf, template ORDER BY doc_id NULLS FIRST, n) AS place
        FROM lines JOIN known USING (leaf, s)),
      gone AS (SELECT r, list(n) AS gone FROM hits WHERE place > 1 GROUP BY r),
      z AS (SELECT doc_id, text, l, gone, CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE array_to_string(
        list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]), chr(10)) END AS kept
        FROM d LEFT JOIN gone USING (r))
      SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(l) END AS n_lines, coalesce(len(gone), 0) AS n_dropped,
        length(kept) AS n_chars, sha256(kept) AS kept_sha256 FROM z"""


def _levels(name: str, first: str, rounds: int) -> str:
    """Tables ``<name>k(t, i, d, n)`` of nodes and ``<name>sk(t, i, grows, l, r)`` of siblings; a tree of one node stays as it is."""
    f, parts = merkle.FANOUT, [f"{name}0 AS ({first})"]
    for k in range(1, rounds + 1):
        below = f"{name}{k - 1}"
        parts += [
            f"""{name}s{k} AS (SELECT a.t, a.i, any_value(a.n) > 1 AS grows, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
            coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
            FROM {below} a JOIN {below} b ON a.t = b.t AND a.i // {f} = b.i // {f} GROUP BY a.t, a.i)""",
            f"""{name}{k} AS (SELECT t, i // {f} AS i, CASE WHEN max(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d,
            (max(n) + {f - 1}) // {f} AS n FROM {below} GROUP BY t, i // {f})""",
        ]
    return ", ".join(parts)


def manifest_sql(leaf_rounds: int = 7, tree_rounds: int = 2) -> str:
    """For up to 8^7 rows of a language and 8^2 languages: the levels are written out one by one."""

    def leaf(text: str) -> str:
        framed = [f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in (text if c == "text" else f"CAST({c} AS VARCHAR)" for c in merkle.FIELDS)]
        return f"sha256({' || '.join(framed)})"

    byte = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, x: {byte}), 4294967295)"
    lowered = leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")
    steps = ["p0 AS (SELECT doc_id, leaf, t, i, seen AS d, '' AS proof FROM o)"]
    steps += [
        f"""p{k} AS (SELECT doc_id, leaf, t, i // {merkle.FANOUT} AS i, CASE WHEN grows THEN sha256(l || d || r) ELSE d END AS d, proof || l || r AS proof
            FROM p{k - 1} JOIN as{k} USING (t, i))""" for k in range(1, leaf_rounds + 1)
    ]
    steps.append(f"""q0 AS (SELECT doc_id, leaf, f0.t, f0.i, p.d, proof, f0.d AS subroot FROM p{leaf_rounds} p JOIN f0 ON f0.lang = p.t)""")
    steps += [
        f"""q{k} AS (SELECT doc_id, leaf, t, i // {merkle.FANOUT} AS i, CASE WHEN grows THEN sha256(l || d || r) ELSE d END AS d, proof || l || r AS proof, subroot
            FROM q{k - 1} JOIN fs{k} USING (t, i))""" for k in range(1, tree_rounds + 1)
    ]
    subroots = f"SELECT '' AS t, t AS lang, row_number() OVER (ORDER BY t) - 1 AS i, d, count(*) OVER () AS n FROM a{leaf_rounds}"
    return f"""WITH h AS (SELECT doc_id, coalesce('=' || lang, '') AS t, {leaf('text')} AS leaf,
        CASE WHEN {crc} % {merkle.TAMPER_EVERY} = 0 THEN {lowered} ELSE {leaf('text')} END AS seen FROM documents),
      o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM h),
      {_levels("a", "SELECT t, i, leaf AS d, n FROM o", leaf_rounds)}, {_levels("f", subroots, tree_rounds)}, {", ".join(steps)}
      SELECT doc_id, leaf, subroot, f{tree_rounds}.d AS root, sha256(proof) AS proof_sha256, q.d AS folded_root, q.d = f{tree_rounds}.d AS verified
      FROM q{tree_rounds} q JOIN f{tree_rounds} USING (t)"""


def repeats_sql() -> str:
    n = suffixes.LENGTH
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
      c AS (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - {n - 1}, 256)) AS a FROM d),
      b AS (SELECT r, doc_id, a, substr(h, 2 * a + 1, {2 * (256 + n - 1)}) AS b FROM c),
      w AS (SELECT r, doc_id, a, b, unnest(range(0, len(b) // 2 - {n - 1})) AS o FROM b),
      k AS (SELECT r, doc_id, a + o AS p, md5(substr(b, 2 * o + 1, {2 * n})) AS k FROM w),
      o AS (SELECT r, p, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, p) AS place FROM k),
      s AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + {n}, true) AS new FROM o WHERE place > 1),
      g AS (SELECT r, p, sum(CAST(new AS INT)) OVER (PARTITION BY r ORDER BY p) AS g FROM s),
      spans AS (SELECT r, min(p) AS a, max(p) + {n} AS b FROM g GROUP BY r, g),
      gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS c FROM spans),
      x AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a)
        || any_value(substr(h, 2 * last + 1)) AS kept FROM (SELECT *, max(b) OVER (PARTITION BY r) AS last FROM gaps) JOIN d USING (r) GROUP BY r)
      SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
        sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN x USING (r)"""


def negatives_sql() -> str:
    m = negatives
    return f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % {m.FLIP_EVERY} = 0 THEN (label + 1) % {m.LABELS} ELSE label END AS label,
        list_transform(embedding, lambda x: floor({m.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {m.ANCHOR_EVERY} = 0),
      p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {m.POSITIVES})
      SELECT anchor_id, p.vec_id AS positive_id,
        CAST(row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id,
        p.score AS positive_score, s.score AS negative_score FROM p JOIN s USING (anchor_id)
      WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= {m.NEGATIVES}"""

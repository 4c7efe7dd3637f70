"""For every registered query, the equivalent SQL over the same tables, written for DuckDB.

The SQL states each operator directly (one scalar query per KPI, plain joins, NOT IN, windows) and
shares nothing with the Spark plans but the catalogue values.
"""

from __future__ import annotations

from tablepulse.plans import warehouse, wording
from tablepulse.plans.queries import CAPTURED_AT, REPLY_TOPICS, TOKEN_PATTERN, TOPICS

RULES = {r.kpi_id: r for r in warehouse.RULES}
ORDINAL = {r.kpi_id: i for i, r in enumerate(warehouse.RULES, 1)}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pct(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN 0.0 ELSE ((2000 * {n} + {d}) // (2 * {d})) / 10.0 END"


LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
DOCS = "documents d LEFT JOIN labels b ON d.doc_id = b.doc_id"
OPEN = "l_linestatus = 'O'"
LATE = "l_shipdate > o_orderdate + INTERVAL 60 DAY"
IN_TIME = "l_shipdate <= o_orderdate + INTERVAL 60 DAY"
KNOWN_TYPES = "('view', 'click', 'purchase', 'signup')"
CENTS = "CAST(round({} * 100) AS BIGINT)"
CS01_GROUPS = f"""SELECT o_orderkey, {CENTS.format('o_totalprice')} AS w, sum({CENTS.format('l_extendedprice')}) AS s
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {OPEN} GROUP BY 1, 2"""
MISSES = "abs(s - w) > w * 0.05::DOUBLE"
LOADED = "(SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"

# kpi_id -> (numerator query, denominator query)
COUNTS = {
    "JI01": (f"SELECT count(DISTINCT o_orderkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {OPEN}",
             "SELECT count(*) FROM orders"),
    "JI02": (f"""SELECT count(*) FROM lineitem LEFT JOIN {LOADED} o ON l_orderkey = o.o_orderkey
             WHERE o.o_orderkey IS NULL""", "SELECT count(*) FROM lineitem"),
    "JI03": ("SELECT count(*) FROM lineitem JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey",
             "SELECT count(*) FROM lineitem"),
    "CP01": (f"SELECT count(*) FROM {DOCS} WHERE quality IS NULL", f"SELECT count(*) FROM {DOCS}"),
    "CP02": (f"SELECT count(*) FROM {DOCS} WHERE toxic IS NULL", f"SELECT count(*) FROM {DOCS}"),
    "CP04": (f"SELECT count(*) FROM {DOCS} WHERE quality IS NULL OR toxic IS NULL", f"SELECT count(*) FROM {DOCS}"),
    "CP05": (f"SELECT count(*) FROM {DOCS} WHERE lang NOT IN ('fr', 'de') AND quality IS NULL",
             f"SELECT count(*) FROM {DOCS} WHERE lang NOT IN ('fr', 'de')"),
    "CS07": (f"""SELECT count(*) FROM (SELECT l_orderkey FROM lineitem WHERE {OPEN}
             GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1)""", "SELECT count(*) FROM orders"),
    "CS01": (f"SELECT count(*) FROM ({CS01_GROUPS}) WHERE {MISSES}", "SELECT count(*) FROM orders"),
    "CS02": (f"SELECT count(*) FROM {LINES} WHERE l_shipdate < o_orderdate", f"SELECT count(*) FROM {LINES}"),
    "RI01": (f"SELECT count(*) FROM events WHERE event_type NOT IN {KNOWN_TYPES}", "SELECT count(*) FROM events"),
    "RI05": ("SELECT count(*) FROM customer WHERE c_acctbal <= 0", "SELECT count(*) FROM customer"),
    "RI05S": ("SELECT count(*) FROM supplier WHERE s_acctbal <= 0", "SELECT count(*) FROM supplier"),
    "TP01": (f"SELECT count(*) FROM {LINES} WHERE {LATE}", f"SELECT count(*) FROM {LINES}"),
    "BIZ01": (f"SELECT count(*) FROM {LINES} WHERE l_linestatus = 'F' AND {IN_TIME}",
              f"SELECT count(*) FROM {LINES} WHERE l_linestatus = 'F'"),
    "BIZ02": ("SELECT count(*) FROM customer WHERE c_acctbal <= 0", "SELECT count(*) FROM customer"),
    "BIZ03": ("SELECT count(*) FROM lineitem WHERE l_returnflag = 'R'", "SELECT count(*) FROM lineitem"),
}
SCORED = [r.kpi_id for r in warehouse.SCORED_RULES]
KPI_COLUMNS = "kpi_id, num, den, value, target_val, higher_is_better"


def counted(kpi_ids, tables: dict[str, str] | None = None) -> str:
    """One row per KPI with its counts and catalogue columns; ``tables`` replaces table names."""
    rows = []
    for k in kpi_ids:
        num, den = COUNTS[k]
        r = RULES[k]
        rows.append(
            f"""SELECT {quoted(k)} AS kpi_id, {ORDINAL[k]} AS ordinal, {quoted(r.name)} AS name,
            {quoted(r.pillar)} AS pillar, {quoted(r.owner)} AS owner, {quoted(r.component)} AS component,
            ({num}) AS num, ({den}) AS den, CAST({r.target} AS DOUBLE) AS target_val,
            {str(r.higher_is_better).lower()} AS higher_is_better"""
        )
    return " UNION ALL ".join(rows)


VALUE, GOAL = (f"CAST(round({c} * 1000000) AS BIGINT)" for c in ("value", "target_val"))
SCORE = f"""CASE WHEN higher_is_better THEN
      CASE WHEN target_val = 0 THEN 100.0 ELSE least(((2000 * {VALUE} + {GOAL}) // (2 * {GOAL})) / 10.0, 100.0) END
    WHEN value <= target_val THEN 100.0
    ELSE ((greatest(100000000 - ({VALUE} - {GOAL}) * 10, 0) * 20 + 1000000) // 2000000) / 10.0 END"""
STATUS = """CASE WHEN higher_is_better AND CAST(value AS DECIMAL(18, 6)) < CAST(target_val AS DECIMAL(18, 6)) * 0.95 THEN 'RED'
    WHEN higher_is_better AND value < target_val THEN 'AMBER'
    WHEN higher_is_better THEN 'GREEN'
    WHEN value > 2 * target_val THEN 'RED'
    WHEN value > target_val THEN 'AMBER' ELSE 'GREEN' END"""
DEVIATION = """CASE WHEN higher_is_better THEN (target_val - value) / greatest(target_val, 1.0)
    WHEN target_val > 0 THEN (value - target_val) / greatest(target_val, 1.0) ELSE value END"""


def kpis(kpi_ids=SCORED, body: str | None = None) -> str:
    """WITH clause that defines ``k``: counts, values, scores, status, deviation."""
    return f"""WITH c AS ({body or counted(kpi_ids)}),
    v AS (SELECT *, CAST({pct('num', 'den')} AS DOUBLE) AS value FROM c),
    k AS (SELECT *, CAST({SCORE} AS DOUBLE) AS score, {STATUS} AS status,
          CAST({DEVIATION} AS DOUBLE) AS deviation FROM v)"""


def mean(column: str) -> str:
    return f"round_even(sum(CAST(round({column} * 10) AS BIGINT)) / (count(*) * 10.0), 0)"


TARGET = """CASE WHEN higher_is_better THEN '≥ ' WHEN target_val = 0 THEN '= ' ELSE '≤ ' END
    || regexp_replace(CAST(target_val AS VARCHAR), '\\.0$', '') || '%'"""
PART = """CASE WHEN component = 'score' THEN score WHEN higher_is_better THEN value ELSE 100 - value END"""
PILLARS = f"SELECT pillar, {mean('part')} AS pillar_score FROM (SELECT *, {PART} AS part FROM k) GROUP BY pillar"
OVERALL = f"(SELECT {mean('score')} FROM k)"


def _entities() -> str:
    rows = []
    for e in warehouse.ENTITIES:
        pieces = [f"(SELECT num FROM k WHERE kpi_id = '{b}')" for b in e.bad]
        pieces += [f"(SELECT den - num FROM k WHERE kpi_id = '{m}')" for m in e.missing]
        total = f"(SELECT den FROM k WHERE kpi_id = '{e.total_of}')"
        rows.append(f"SELECT '{e.name}' AS entity, least({' + '.join(pieces)}, {total}) AS bad_rows, {total} AS total_rows")
    listed = " UNION ALL ".join(rows)
    return f"SELECT *, CAST({pct('(total_rows - bad_rows)', 'total_rows')} AS DOUBLE) AS entity_score FROM ({listed})"


def _breakdown(table: str, column: str) -> str:
    return f"SELECT {column} AS label, count(*) AS n FROM {table} GROUP BY {column}"


def _payload() -> str:
    listed = ", ".join(
        f"""'"{name}":[' || (SELECT string_agg('{{"label":' || coalesce('"' || label || '"', 'null') || ',"count":' || n || '}}',
            ',' ORDER BY n DESC, label NULLS FIRST) FROM ({_breakdown(table, column)} ORDER BY n DESC, label NULLS FIRST LIMIT 50)) || ']'"""
        for name, table, column in sorted(warehouse.BREAKDOWNS)
    )
    counts = " || ',' || ".join(
        f"""'"{e.name}":' || (SELECT den FROM k WHERE kpi_id = '{e.total_of}')"""
        for e in sorted(warehouse.ENTITIES, key=lambda e: e.name)
    )
    return f"""{kpis()} SELECT '{CAPTURED_AT} UTC' AS computed_at, {OVERALL} AS overall_score,
      '{{' || {counts} || '}}' AS counts,
      (SELECT '{{' || string_agg('"' || pillar || '":' || pillar_score, ',' ORDER BY pillar) || '}}'
       FROM ({PILLARS})) AS pillar_scores,
      (SELECT '{{' || string_agg('"' || entity || '":' || entity_score, ',' ORDER BY entity) || '}}'
       FROM ({_entities()})) AS entity_scores,
      (SELECT '{{' || string_agg('"' || kpi_id || '":{{"value":' || value || ',"num":' || num || ',"den":' || den
        || ',"target":"' || {TARGET} || '","target_val":' || target_val || ',"higher_is_better":' || higher_is_better || '}}', ',' ORDER BY kpi_id)
        || '}}' FROM k) AS kpis,
      '{{' || concat_ws(',', {listed}) || '}}' AS breakdowns"""


DATED = """l_orderkey, l_linenumber, l_suppkey, l_linestatus, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date,
    CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ship_date"""
DATED_KEYS = "l_orderkey, l_linenumber, l_suppkey, l_linestatus, CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)"
CUSTOMERS = """SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal <= 0
    ORDER BY 1, 2, 3, 4 LIMIT 50"""
DRILLDOWNS = {
    "JI01": f"""SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date
        FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND {OPEN})
        ORDER BY 1, 2, 3, 4 LIMIT 50""",
    "JI02": f"""SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus
        FROM lineitem LEFT JOIN {LOADED} o ON l_orderkey = o.o_orderkey WHERE o.o_orderkey IS NULL
        ORDER BY 1, 2, 3, 4, 5 LIMIT 50""",
    "CP01": f"SELECT d.doc_id, lang, source, quality FROM {DOCS} WHERE quality IS NULL ORDER BY 1, 2, 3 LIMIT 50",
    "CP02": f"SELECT d.doc_id, lang, source, toxic FROM {DOCS} WHERE toxic IS NULL ORDER BY 1, 2, 3 LIMIT 50",
    "CP05": f"""SELECT d.doc_id, lang, source, quality FROM {DOCS}
        WHERE lang NOT IN ('fr', 'de') AND quality IS NULL ORDER BY 1, 2, 3 LIMIT 50""",
    "CS07": f"""SELECT o_orderkey, o_orderstatus, count(DISTINCT l_suppkey) AS active_supplier_count,
        min(l_suppkey) AS supplier_sample FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {OPEN}
        GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1 ORDER BY 1, 2 LIMIT 50""",
    "CS01": f"""SELECT o_orderkey, w / 100.0 AS order_price, s / 100.0 AS line_price_sum,
        abs(s - w) / 100.0 AS discrepancy, o_orderpriority FROM (
          SELECT o_orderkey, {CENTS.format('o_totalprice')} AS w, o_orderpriority, sum({CENTS.format('l_extendedprice')}) AS s
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {OPEN} GROUP BY 1, 2, 3)
        WHERE {MISSES} ORDER BY 1, 2, 3, 4, 5 LIMIT 50""",
    "CS02": f"SELECT {DATED} FROM {LINES} WHERE l_shipdate < o_orderdate ORDER BY {DATED_KEYS} LIMIT 50",
    "RI01": f"""SELECT event_id, event_type, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date FROM events
        WHERE event_type NOT IN {KNOWN_TYPES} ORDER BY 1, 2, 3, 4 LIMIT 50""",
    "RI05": CUSTOMERS,
    "TP01": f"SELECT {DATED} FROM {LINES} WHERE {LATE} ORDER BY {DATED_KEYS} LIMIT 50",
    "BIZ01": f"""SELECT {DATED}, CAST(date_diff('day', CAST(o_orderdate + INTERVAL 60 DAY AS DATE), CAST(l_shipdate AS DATE))
        AS INTEGER) AS days_early_or_late FROM {LINES} WHERE l_linestatus = 'F' AND {IN_TIME}
        ORDER BY CAST(l_shipdate AS DATE) DESC, {DATED_KEYS} LIMIT 50""",
    "BIZ02": CUSTOMERS,
    "BIZ03": """SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus FROM lineitem
        WHERE l_returnflag = 'R' ORDER BY 1, 2, 3, 4, 5 LIMIT 50""",
}

FAILING = f"""
    SELECT 'RI01' AS kpi_id, event_id AS row_key, 0 AS row_no FROM events WHERE event_type NOT IN {KNOWN_TYPES}
    UNION ALL SELECT 'RI05', c_custkey, 0 FROM customer WHERE c_acctbal <= 0
    UNION ALL SELECT 'BIZ02', c_custkey, 0 FROM customer WHERE c_acctbal <= 0
    UNION ALL SELECT 'CP01', d.doc_id, 0 FROM {DOCS} WHERE quality IS NULL
    UNION ALL SELECT 'CP02', d.doc_id, 0 FROM {DOCS} WHERE toxic IS NULL
    UNION ALL SELECT 'CP05', d.doc_id, 0 FROM {DOCS} WHERE lang NOT IN ('fr', 'de') AND quality IS NULL
    UNION ALL SELECT 'JI01', o_orderkey, 0 FROM orders o
      WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND {OPEN})
    UNION ALL SELECT 'JI02', l_orderkey, l_linenumber FROM lineitem LEFT JOIN {LOADED} o ON l_orderkey = o.o_orderkey
      WHERE o.o_orderkey IS NULL
    UNION ALL (SELECT 'CS07', o_orderkey, 0 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {OPEN}
      GROUP BY o_orderkey, o_orderstatus HAVING count(DISTINCT l_suppkey) > 1)
    UNION ALL (SELECT 'CS01', o_orderkey, 0 FROM (
      SELECT o_orderkey, {CENTS.format('o_totalprice')} AS w, o_orderpriority, sum({CENTS.format('l_extendedprice')}) AS s
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {OPEN} GROUP BY 1, 2, 3) WHERE {MISSES})
    UNION ALL SELECT 'CS02', l_orderkey, l_linenumber FROM {LINES} WHERE l_shipdate < o_orderdate
    UNION ALL SELECT 'TP01', l_orderkey, l_linenumber FROM {LINES} WHERE {LATE}
    UNION ALL SELECT 'BIZ01', l_orderkey, l_linenumber FROM {LINES} WHERE l_linestatus = 'F' AND {IN_TIME}
    UNION ALL SELECT 'BIZ03', l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'"""

MONTHLY = f"""n AS (SELECT date_trunc('month', ts) AS d, 'RI01' AS kpi_id,
      count(*) FILTER (event_type NOT IN {KNOWN_TYPES}) AS num, count(*) AS den FROM events GROUP BY 1
      UNION ALL SELECT date_trunc('month', o_orderdate), 'CS02', count(*) FILTER (l_shipdate < o_orderdate), count(*)
        FROM {LINES} GROUP BY 1
      UNION ALL SELECT date_trunc('month', o_orderdate), 'TP01', count(*) FILTER ({LATE}), count(*) FROM {LINES} GROUP BY 1
      UNION ALL SELECT date_trunc('month', o_orderdate), 'BIZ01', count(*) FILTER (l_linestatus = 'F' AND {IN_TIME}),
        count(*) FILTER (l_linestatus = 'F') FROM {LINES} GROUP BY 1
      UNION ALL SELECT date_trunc('month', l_shipdate), 'BIZ03', count(*) FILTER (l_returnflag = 'R'), count(*)
        FROM lineitem GROUP BY 1),
    h AS (SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS captured_on, kpi_id, num, den,
      CAST({pct('num', 'den')} AS DOUBLE) AS value FROM n),
    monthly AS (SELECT *, CASE WHEN value >= 20 THEN 'high ' || printf('%.1f', value) END AS label FROM h),
    g(kpi_id, target_val, higher_is_better) AS (VALUES {", ".join(
        f"('{r.kpi_id}', CAST({r.target} AS DOUBLE), {str(r.higher_is_better).lower()})" for r in warehouse.RULES)}),
    whole AS (SELECT captured_on, {mean('score')} AS value FROM (SELECT captured_on, CAST({SCORE} AS DOUBLE) AS score
      FROM monthly JOIN g ON monthly.kpi_id = g.kpi_id) GROUP BY 1)"""


def _snapshot(column: str) -> str:
    from tablepulse.sources.schemas import KPI_COLUMNS as kpi_columns, PILLAR_COLUMNS

    parts = [("overall_score", OVERALL)]
    parts += [
        (c, f"(SELECT pillar_score FROM ({PILLARS}) WHERE pillar = '{p}')") for p, c in PILLAR_COLUMNS.items()
    ]
    parts += [(c, f"CAST((SELECT value FROM k WHERE kpi_id = '{c.upper()}') AS DOUBLE)") for c in kpi_columns]
    if column == "wide":
        return f"{kpis()} SELECT '{CAPTURED_AT}' AS captured_at, 'Nightly' AS label, " + ", ".join(
            f"{v} AS {c}" for c, v in parts
        )
    return f"{kpis()} " + " UNION ALL ".join(f"SELECT '{c}' AS kpi_id, {v} AS value" for c, v in parts)


K = "CAST(json_extract(props, '$.k') AS INTEGER)"
EVENT_KPI = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in warehouse.EVENT_KPI.items()) + " END"
ALERTS = f"""a AS (SELECT event_id AS alert_id, ts AS created_at, {EVENT_KPI} AS kpi_id, value AS kpi_value,
    CASE WHEN value > 100 THEN 'RED' WHEN value > 50 THEN 'AMBER' ELSE 'GREEN' END AS severity,
    'event of user ' || user_id AS message,
    CASE WHEN event_type = 'signup' OR {K} < 40 THEN 'Resolved' WHEN {K} < 70 THEN 'Open'
         WHEN {K} < 95 THEN 'In Review' END AS status FROM events)"""
RANK = "CASE severity WHEN 'RED' THEN 1 WHEN 'AMBER' THEN 2 ELSE 3 END"
WORDS = "w(kpi_id, meaning, advice) AS (VALUES " + ", ".join(
    f"({quoted(k)}, {quoted(t.meaning)}, {quoted(t.advice)})" for k, t in wording.ALERT_TEXTS.items()
) + ")"
ONE = "printf('%.1f', {})"
MESSAGE = f"""'For the ' || owner || ': ' || name || ' is ' || {ONE.format('value')} || '% (' || num || ' of ' || den
    || '), target ' || {ONE.format('target_val')} || '%.' || coalesce(' ' || meaning, '')"""
CANDIDATES = f"""x AS (SELECT k.kpi_id, ordinal, owner, value AS kpi_value, target_val AS target_value, status AS severity,
    {MESSAGE} AS message, coalesce(advice, 'Look at the failing rows in the drill-down.') AS recommendation
    FROM k LEFT JOIN w ON k.kpi_id = w.kpi_id WHERE status <> 'GREEN')"""
ALERT_QUERY = f"{kpis()}, {ALERTS}, {WORDS}, {CANDIDATES}"
SHORT = "kpi_id, kpi_value, target_value, severity, owner"
OWNERS = "o(kpi_id, owner) AS (VALUES " + ", ".join(f"('{r.kpi_id}', '{r.owner}')" for r in warehouse.RULES) + ")"

CAUSES = "z(kpi_id, root_cause, corrective_action) AS (VALUES " + ", ".join(
    f"({quoted(k)}, {quoted(c.root_cause)}, {quoted(c.corrective_action)})" for k, c in wording.CAUSES.items()
) + ")"
DATASETS = "t(kpi_id, dataset) AS (VALUES " + ", ".join(
    f"('{r.kpi_id}', '{getattr(r.measure, 'table', None) or r.measure.child}')" for r in warehouse.RULES
) + ")"


def _evidence() -> str:
    """Number of sample rows and the first one as JSON, per KPI."""

    def row(kpi_id, condition, source, fields, order):
        parts = []
        for f in fields:
            text = f.startswith("'")
            name = f.strip("'")
            expr = {"order_date": "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", "doc_id": "d.doc_id",
                    "ship_date": "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)",
                    "event_date": "CAST(CAST(ts AS DATE) AS VARCHAR)",
                    "days_early_or_late": "date_diff('day', CAST(o_orderdate + INTERVAL 60 DAY AS DATE), CAST(l_shipdate AS DATE))",
                    }.get(name, name)
            value = f"coalesce('\"' || {expr} || '\"', 'null')" if text else f"coalesce(CAST({expr} AS VARCHAR), 'null')"
            parts.append(f"'\"{name}\":' || {value}")
        json = "'{' || " + " || ',' || ".join(parts) + " || '}'"
        return f"""SELECT '{kpi_id}' AS kpi_id, least((SELECT count(*) FROM {source} WHERE {condition}), 20) AS n_evidence,
            (SELECT {json} FROM {source} WHERE {condition} ORDER BY {order} LIMIT 1) AS first_evidence"""

    doc = ["doc_id", "'lang'", "'source'", "quality"]
    dated = ["l_orderkey", "l_linenumber", "l_suppkey", "'l_linestatus'", "'order_date'", "'ship_date'"]
    customer = ["c_custkey", "'c_name'", "c_acctbal", "'c_mktsegment'"]
    line = ["l_orderkey", "l_linenumber", "l_suppkey", "'l_returnflag'", "'l_linestatus'"]
    line_keys = "l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus"
    several = f"""(SELECT o_orderkey, o_orderstatus, count(DISTINCT l_suppkey) AS active_supplier_count,
        min(l_suppkey) AS supplier_sample FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {OPEN}
        GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1)"""
    missed = f"""(SELECT o_orderkey, w / 100.0 AS order_price, s / 100.0 AS line_price_sum, abs(s - w) / 100.0 AS discrepancy,
        o_orderpriority FROM (SELECT o_orderkey, {CENTS.format('o_totalprice')} AS w, o_orderpriority,
        sum({CENTS.format('l_extendedprice')}) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {OPEN}
        GROUP BY 1, 2, 3) WHERE {MISSES})"""
    return " UNION ALL ".join(
        [
            row("JI01", f"NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND {OPEN})", "orders o",
                ["o_orderkey", "'o_orderstatus'", "'o_orderpriority'", "'order_date'"],
                "o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE)"),
            row("JI02", "o.o_orderkey IS NULL", f"lineitem LEFT JOIN {LOADED} o ON l_orderkey = o.o_orderkey", line, line_keys),
            row("CS07", "true", several, ["o_orderkey", "'o_orderstatus'", "active_supplier_count", "supplier_sample"],
                "o_orderkey, o_orderstatus, active_supplier_count, supplier_sample"),
            row("CS01", "true", missed, ["o_orderkey", "order_price", "line_price_sum", "discrepancy", "'o_orderpriority'"],
                "o_orderkey, order_price, line_price_sum, discrepancy, o_orderpriority"),
            row("CP01", "quality IS NULL", DOCS, doc, "d.doc_id, lang, source"),
            row("CP05", "lang NOT IN ('fr', 'de') AND quality IS NULL", DOCS, doc, "d.doc_id, lang, source"),
            row("CS02", "l_shipdate < o_orderdate", LINES, dated, DATED_KEYS),
            row("RI01", f"event_type NOT IN {KNOWN_TYPES}", "events",
                ["event_id", "'event_type'", "user_id", "'event_date'"], "event_id, event_type, user_id"),
            row("RI05", "c_acctbal <= 0", "customer", customer, "c_custkey, c_name, c_acctbal, c_mktsegment"),
            row("TP01", LATE, LINES, dated, DATED_KEYS),
            row("BIZ01", f"l_linestatus = 'F' AND {IN_TIME}", LINES, [*dated, "days_early_or_late"],
                f"CAST(l_shipdate AS DATE) DESC, {DATED_KEYS}"),
            row("BIZ02", "c_acctbal <= 0", "customer", customer, "c_custkey, c_name, c_acctbal, c_mktsegment"),
            row("BIZ03", "l_returnflag = 'R'", "lineitem", line, line_keys),
        ]
    )


RCA = f"""{kpis()}, {CAUSES}, {DATASETS}, e AS ({_evidence()}),
    f AS (SELECT *, CASE WHEN higher_is_better THEN den - num ELSE num END AS affected_count FROM k
          WHERE status <> 'GREEN')
    SELECT f.kpi_id, affected_count, name || ' rows=' || affected_count || ', rate ' || {ONE.format('value')} || '%'
        AS issue_summary, dataset,
      f.kpi_id || ': ' || name || ' is ' || {ONE.format('value')} || '%, target ' || {ONE.format('target_val')} || '%'
        AS rule_violated, status AS severity,
      coalesce(root_cause, 'KPI ' || f.kpi_id || ' has ' || affected_count || ' failing rows to look into.') AS root_cause,
      coalesce(n_evidence, 0) AS n_evidence, first_evidence,
      coalesce(corrective_action, 'Review the failing rows and correct them at the source.') AS corrective_action,
      owner, 'Open' AS status
    FROM f LEFT JOIN z ON f.kpi_id = z.kpi_id LEFT JOIN t ON f.kpi_id = t.kpi_id LEFT JOIN e ON f.kpi_id = e.kpi_id"""


def _lines(replaced: str = "", where: str = "true") -> str:
    """Whole lines with some columns replaced, and the date as text."""
    more = f"{replaced}, " if replaced else ""
    return f"""SELECT * REPLACE ({more}strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate) FROM lineitem WHERE {where}"""


def _events(replaced: str) -> str:
    return f"SELECT * REPLACE ({replaced} AS event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts) FROM events"


def _dated(date: str) -> str:
    return f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
        l_linestatus, strftime({date}, '%Y-%m-%d %H:%M:%S') AS l_shipdate,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM {LINES}"""


RETURNED_OPEN = f"l_returnflag = 'R' AND {OPEN}"
LINKED = f"l_orderkey IN {LOADED}"
PENDING = "'Zero Weight - Pending Review'"
SEGMENT = "CASE WHEN c_acctbal <= 0 THEN {} ELSE c_mktsegment END AS c_mktsegment"
DRY_RUN = f"""WITH n(fix, table_name, action, affected_rows, base) AS (
      SELECT 'JI02', 'lineitem', 'delete', (SELECT count(*) FROM lineitem WHERE NOT coalesce({LINKED}, false)), 'HIGH'
      UNION ALL SELECT 'RI05', 'customer', 'update', (SELECT count(*) FROM customer WHERE c_acctbal <= 0), 'MEDIUM'
      UNION ALL SELECT 'BIZ03', 'lineitem', 'update', (SELECT count(*) FROM lineitem WHERE {RETURNED_OPEN}), 'MEDIUM'
      UNION ALL SELECT 'RI01', 'events', 'update', (SELECT count(*) FROM events WHERE event_type = 'error'), 'MEDIUM'
      UNION ALL SELECT 'CS07', 'lineitem', 'update', (SELECT count(*) FROM lineitem WHERE {RETURNED_OPEN}), 'MEDIUM')
    SELECT fix, table_name, action, affected_rows, CASE WHEN affected_rows > 20 THEN 'HIGH' ELSE base END AS risk_level
    FROM n"""

FIXED_TABLES = {
    "lineitem": f"""(SELECT * REPLACE (CASE WHEN {RETURNED_OPEN} THEN 'Inactive' ELSE l_linestatus END AS l_linestatus,
        CASE WHEN {RETURNED_OPEN} THEN 'Re-assigned - Resolved' ELSE l_returnflag END AS l_returnflag)
        FROM lineitem WHERE {LINKED})""",
    "customer": f"""(SELECT * REPLACE (CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal) FROM customer)""",
    "events": "(SELECT * REPLACE (CASE event_type WHEN 'error' THEN 'view' ELSE event_type END AS event_type) FROM events)",
}


def _before_after() -> str:
    after = counted(SCORED)
    for name, fixed in FIXED_TABLES.items():
        for word in ("FROM ", "JOIN "):
            after = after.replace(f"{word}{name} ", f"{word}fixed_{name} ").replace(f"{word}{name})", f"{word}fixed_{name})")
    fixed = ", ".join(f"fixed_{name} AS {body}" for name, body in FIXED_TABLES.items())
    columns = ("num", "value", "score", "status")
    listed = ", ".join(f"b.{c} AS {c}_before, f.{c} AS {c}_after" for c in columns)
    return f"""WITH {fixed}, b AS ({kpis()} SELECT * FROM k), f AS ({kpis(body=after)} SELECT * FROM k)
        SELECT b.kpi_id, {listed}, f.score > b.score AS improved FROM b JOIN f ON b.kpi_id = f.kpi_id"""


DERIVED = """WITH links AS (SELECT l_orderkey || '-' || l_linenumber AS shipment_gid, l_orderkey, l_quantity,
      l_returnflag = 'R' AND l_linestatus <> 'O' AS deleted_stale,
      CASE WHEN l_quantity < 2 THEN 'Zero Qty' WHEN l_tax >= 0.08 THEN 'Split Order'
           WHEN l_discount >= 0.1 THEN 'Re-assigned' ELSE 'OK' END AS flag FROM lineitem
      WHERE l_orderkey || '-' || l_linenumber NOT IN
        (SELECT l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_returnflag = 'A')),
    loaded AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date,
      CASE o_orderstatus WHEN 'F' THEN 'Shipped' WHEN 'O' THEN 'Planned' ELSE 'Cancelled' END AS order_status
      FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 100000),
    j AS (SELECT *, coalesce(order_date, DATE '2025-06-01') AS d FROM links LEFT JOIN loaded ON l_orderkey = o_orderkey),
    s AS (SELECT *, CASE WHEN flag = 'Zero Qty' THEN 1 WHEN deleted_stale THEN 2 WHEN flag = 'Re-assigned' THEN 3
      WHEN order_status = 'Cancelled' THEN 4 WHEN flag = 'Split Order' THEN 5
      WHEN flag = 'OK' AND order_status = 'Shipped' THEN 6 WHEN order_status = 'Planned' THEN 7 ELSE 8 END AS c FROM j)
    SELECT shipment_gid, CAST(d + 1 AS VARCHAR) AS planned_pickup, CAST(d + 3 AS VARCHAR) AS planned_delivery,
      CASE WHEN c IN (3, 5, 6, 8) THEN CAST(d + 1 AS VARCHAR) END AS actual_departure,
      CASE WHEN c IN (3, 5, 6, 8) THEN CAST(d + 3 AS VARCHAR) END AS actual_arrival,
      CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS weight_kg,
      CASE WHEN c IN (1, 2, 7) THEN 'Planned' WHEN c = 4 THEN 'Cancelled' ELSE 'Closed' END AS status,
      CASE c WHEN 1 THEN 'Zero Weight' WHEN 2 THEN 'Ghost - OS link deleted in source system'
             WHEN 3 THEN 'Re-assigned (active)' WHEN 5 THEN 'Split Shipment' ELSE 'OK' END AS dq_flag FROM s"""

ASIDES = r"""(?s)'[^'\\]*(?:(?:\\.|'')[^'\\]*)*'|"[^"\\]*(?:(?:\\.|"")[^"\\]*)*"|`[^`]*(?:``[^`]*)*`|--[^\n]*|/\*.*?\*/"""
SCREENED = rf"""WITH s AS (SELECT event_id, CASE event_type
      WHEN 'view' THEN CASE WHEN value > 50 THEN 'UPDATE visits SET note = ''a;b'', seen = ''it''''s; drop'' WHERE user_id = ' || user_id
                            ELSE 'UPDATE visits SET seen = 1 WHERE user_id = ' || user_id END
      WHEN 'click' THEN CASE WHEN value > 100 THEN 'delete from clicks -- where user_id = ' || user_id
                             WHEN value > 50 THEN 'delete from clicks /* all; */ where user_id = ' || user_id || ' -- not ''truncate'
                             ELSE 'delete from clicks where user_id = ' || user_id || ';' END
      WHEN 'purchase' THEN 'DELETE FROM purchases; -- user ' || user_id
      WHEN 'signup' THEN CASE WHEN value > 50 THEN 'UPDATE users SET active = ' || user_id || ' /* WHERE 1 = 1 */'
                              ELSE 'DELETE FROM signups WHERE name = ''' || user_id END
      WHEN 'error' THEN CASE WHEN value > 100 THEN 'DELETE FROM errors WHERE id = ' || user_id || '; DELETE FROM errors WHERE id = 0'
                             WHEN value > 50 THEN 'Drop table errors_' || user_id
                             ELSE 'ALTER TABLE errors ADD COLUMN c' || user_id END END AS t FROM events),
    c AS (SELECT *, regexp_replace(t, {quoted(ASIDES)}, ' ', 'g') AS q FROM s),
    r AS (SELECT event_id, CASE WHEN t IS NULL THEN 'no statement'
      WHEN regexp_matches(q, '[''"`]|/\*') THEN 'unclosed quotation or comment'
      WHEN regexp_matches(q, '\bdrop\b', 'i') THEN 'blocked keyword: DROP'
      WHEN regexp_matches(q, '\btruncate\b', 'i') THEN 'blocked keyword: TRUNCATE'
      WHEN regexp_matches(q, '\balter\b', 'i') THEN 'blocked keyword: ALTER'
      WHEN len(list_filter(string_split(q, ';'), lambda p: trim(p) <> '')) > 1 THEN 'more than one statement'
      WHEN regexp_matches(q, '\bdelete\b', 'i') AND NOT regexp_matches(q, '\bwhere\b', 'i') THEN 'DELETE without WHERE'
      WHEN regexp_matches(q, '\bupdate\b', 'i') AND NOT regexp_matches(q, '\bwhere\b', 'i') THEN 'UPDATE without WHERE'
      ELSE '' END AS reason FROM c)
    SELECT event_id, reason = '' AS is_safe, reason FROM r"""


def _route() -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), {quoted(w)})" for w in words) + f" THEN '{topic}'"
        for topic, words in TOPICS
    )
    return f"SELECT conv_id, turn, CASE {cases} ELSE 'other' END AS topic FROM conversations"


def _compact() -> str:
    return f"""{kpis()}, {MONTHLY}, {ALERTS} SELECT 'kpi' AS kind, kpi_id AS name,
        '{{"value":' || value || ',"target":"' || {TARGET} || '"}}' AS body FROM k
      UNION ALL SELECT 'capture', coalesce(captured_on, ''),
        '{{"label":"' || coalesce(captured_on, '') || '","overall_score":' || value || '}}' FROM whole
      UNION ALL SELECT 'pillar', pillar, '{{"pillar_score":' || pillar_score || '}}' FROM ({PILLARS})
      UNION ALL SELECT 'alert', coalesce(kpi_id, ''), '{{"severity":"' || severity || '","n_alerts":' || count(*) || '}}'
        FROM a WHERE status <> 'Resolved' GROUP BY kpi_id, severity"""


def _replies() -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), {quoted(w)})" for w in words) + f" THEN '{topic}'"
        for topic, words in REPLY_TOPICS
    )

    def kpi(kpi_id):
        return f"""(SELECT '{kpi_id} is at ' || {ONE.format('value')} || '% (' || num ||
            ' rows); the drill-down lists them.' FROM k WHERE kpi_id = '{kpi_id}')"""

    overall = f"""'The overall score is ' || printf('%.0f', {OVERALL}) || '%, the mean of ' || (SELECT count(*) FROM k) || ' KPIs.'"""
    weakest = f"""(SELECT ' The weakest pillar is ' || pillar || ' at ' || printf('%.0f', pillar_score) || '%.' FROM ({PILLARS})
        ORDER BY pillar_score, pillar LIMIT 1)"""
    answer = f"{overall} || CASE topic WHEN 'overall' THEN {weakest} ELSE '' END"
    return f"""{kpis()}, {MONTHLY},
      e AS (SELECT count(*) AS n, arg_min(value, captured_on) AS v1, arg_max(value, captured_on) AS v2 FROM whole),
      m AS (SELECT conv_id, turn, CASE {cases} ELSE 'general' END AS topic FROM conversations)
      SELECT conv_id, turn, topic, CASE topic WHEN 'ghost' THEN {kpi('CS07')} WHEN 'orphan' THEN {kpi('JI02')}
        WHEN 'fix' THEN 'Open the alert, read its root cause, check the dry run, then approve the fix.'
        WHEN 'trend' THEN (SELECT 'Over ' || n || ' captures it ' || CASE WHEN v2 < v1 THEN 'declined'
          WHEN v2 > v1 THEN 'rose' ELSE 'stayed' END || ' from ' || {ONE.format('v1')} || '% to ' || {ONE.format('v2')}
          || '%.' FROM e)
        ELSE {answer} END AS reply FROM m"""


SUMMARY = f"""{kpis()},
    worst AS (SELECT * FROM k WHERE status = 'RED' ORDER BY deviation DESC, ordinal LIMIT 1),
    best AS (SELECT * FROM k WHERE CASE WHEN higher_is_better THEN value >= target_val ELSE value = 0 END
             ORDER BY ordinal LIMIT 1),
    s AS (SELECT {OVERALL} AS overall_score)
    SELECT (SELECT kpi_id FROM worst) AS worst_kpi, (SELECT kpi_id FROM best) AS best_kpi, overall_score,
      concat_ws(' ', 'Overall data quality is at ' || printf('%.0f', overall_score) || '%.',
        (SELECT 'The most pressing issue is ' || kpi_id || ' at ' || {ONE.format('value')} || '% against a target of '
           || {ONE.format('target_val')} || '%.' FROM worst),
        (SELECT 'On the positive side, ' || kpi_id || ' stands at ' || {ONE.format('value')}
           || '% and meets its target of ' || {ONE.format('target_val')} || '%.' FROM best),
        'Next step: raise alerts and look into the root cause of the most pressing one.') AS summary FROM s"""

_KPI_NAMES = {
    "ji01_match_rate": "JI01", "ji02_orphan_rate": "JI02", "ji03_resolve_rate": "JI03", "cp01_null_rate": "CP01",
    "cp02_null_rate": "CP02", "cp04_any_null_rate": "CP04", "cp05_cond_null_rate": "CP05",
    "cs07_ambiguous_rate": "CS07", "cs01_sum_mismatch_rate": "CS01", "cs02_date_order_rate": "CS02",
    "ri01_domain_rate": "RI01", "ri05_range_rate": "RI05", "ri05s_range_rate": "RI05S", "tp01_late_rate": "TP01",
    "biz01_on_time_rate": "BIZ01", "biz02_range_rate": "BIZ02", "biz03_flag_rate": "BIZ03",
}
_OF_ORDER = ", ".join(quoted(r.kpi_id) for r in warehouse.RULES if "order" in r.entities)

ORACLE_SQL: dict[str, str] = {
    **{name: f"{kpis([k])} SELECT {KPI_COLUMNS} FROM k" for name, k in _KPI_NAMES.items()},
    "kpi_table": f"{kpis()} SELECT {KPI_COLUMNS} FROM k",
    "kpi_report": f"{kpis(list(COUNTS))} SELECT {KPI_COLUMNS} FROM k",
    "kpi_scores": f"{kpis()} SELECT kpi_id, value, target_val, score FROM k",
    "kpi_rag": f"{kpis()} SELECT kpi_id, value, target_val, status FROM k",
    "kpi_deviation": f"{kpis()} SELECT kpi_id, value, target_val, round(deviation, 6) AS deviation FROM k",
    "pillar_scores": f"{kpis()} {PILLARS}",
    "overall_score": f"{kpis()} SELECT {mean('score')} AS overall_score, count(*) AS n_kpis FROM k",
    "entity_scores": f"{kpis()} {_entities()}",
    "entity_kpis": f"{kpis()} SELECT kpi_id, name, pillar, value FROM k WHERE kpi_id IN ({_OF_ORDER})",
    "kpi_payload": _payload(),
    "kpi_report_lines": f"""{kpis(list(COUNTS))} SELECT CAST(ordinal AS INTEGER) AS ordinal, pillar,
        regexp_replace(kpi_id, '^([A-Z]+)([0-9])', '\\1-\\2') || ' ' || name || ': ' || num || '/' || den || ' = '
        || {ONE.format('value')} || '% (target ' || {TARGET} || ')' AS line FROM k ORDER BY ordinal""",
    **{f"breakdown_{name}": _breakdown(table, column) for name, table, column in warehouse.BREAKDOWNS},
    **{f"drilldown_{k.lower()}": sql for k, sql in DRILLDOWNS.items()},
    "failing_samples": f"""WITH f AS ({FAILING}), r AS (SELECT *, row_number() OVER (PARTITION BY kpi_id
        ORDER BY row_key, row_no) AS sample_no, count(*) OVER (PARTITION BY kpi_id) AS total_failing FROM f)
        SELECT kpi_id, row_key, CAST(row_no AS INTEGER) AS row_no, CAST(sample_no AS INTEGER) AS sample_no, total_failing, CASE WHEN total_failing > 20
        THEN '...and ' || (total_failing - 20) || ' more rows' ELSE '' END AS note FROM r WHERE sample_no <= 20""",
    "history": f"WITH {MONTHLY} SELECT captured_on, kpi_id, num, den, value, coalesce(label, '') AS label FROM monthly",
    "history_delta": f"""WITH {MONTHLY} SELECT captured_on, kpi_id, value, (CAST(round(value * 10) AS BIGINT)
        - CAST(round(lag(value) OVER (PARTITION BY kpi_id ORDER BY captured_on) * 10) AS BIGINT)) / 10.0 AS delta FROM monthly""",
    "history_overall": f"""WITH {MONTHLY} SELECT captured_on, value, (CAST(round(value * 10) AS BIGINT)
        - CAST(round(lag(value) OVER (ORDER BY captured_on) * 10) AS BIGINT)) / 10.0 AS delta FROM whole""",
    "history_trend": f"""WITH {MONTHLY}, e AS (SELECT kpi_id, count(*) AS n_captures, arg_min(value, captured_on) AS first_value,
        arg_max(value, captured_on) AS last_value FROM (SELECT captured_on, kpi_id, value FROM monthly
          UNION ALL SELECT captured_on, 'overall_score', value FROM whole) GROUP BY kpi_id)
        SELECT *, CASE WHEN n_captures >= 2 THEN 'Over ' || n_captures || ' captures it ' || CASE
          WHEN last_value < first_value THEN 'declined' WHEN last_value > first_value THEN 'rose' ELSE 'stayed' END
          || ' from ' || {ONE.format('first_value')} || '% to ' || {ONE.format('last_value')} || '%.'
          ELSE 'No trend yet.' END AS sentence FROM e""",
    "history_without_label": f"""WITH {MONTHLY} SELECT captured_on, kpi_id, value, label FROM monthly
        WHERE label IS NULL OR label NOT LIKE '%high 2%'""",
    "history_not_captured": """SELECT event_id, event_type FROM events e WHERE event_type <> 'purchase' AND NOT EXISTS
        (SELECT 1 FROM events p WHERE event_type = 'purchase' AND date_trunc('second', p.ts) = date_trunc('second', e.ts))""",
    "snapshot_wide": _snapshot("wide"),
    "snapshot_long": _snapshot("long"),
    "alerts_candidates": f"""{ALERT_QUERY} SELECT kpi_id, owner, kpi_value, target_value, severity, message,
        recommendation FROM x""",
    "alerts_new": f"""{ALERT_QUERY} SELECT {SHORT} FROM x
        WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.kpi_id = x.kpi_id AND status <> 'Resolved')""",
    "alerts_new_only_open": f"""{ALERT_QUERY} SELECT {SHORT} FROM x
        WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.kpi_id = x.kpi_id AND status = 'Open' AND a.kpi_id <> 'CS07')""",
    "alerts_raised": f"""{ALERT_QUERY} SELECT (SELECT max(alert_id) FROM a) + row_number() OVER (ORDER BY ordinal) AS alert_id,
        '{CAPTURED_AT}' AS created_at, kpi_id, kpi_value, target_value, severity, message, recommendation,
        'Open' AS status FROM x WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.kpi_id = x.kpi_id AND status <> 'Resolved')""",
    "alerts_ranked": f"""WITH {ALERTS} SELECT alert_id, kpi_id, kpi_value, severity, status, {RANK} AS severity_rank
        FROM a WHERE status <> 'Resolved' ORDER BY severity_rank, created_at DESC, alert_id""",
    "alerts_by_owner": f"""WITH {ALERTS}, {OWNERS} SELECT owner, a.kpi_id, severity, count(*) AS n_alerts
        FROM a LEFT JOIN o ON a.kpi_id = o.kpi_id WHERE status <> 'Resolved' GROUP BY 1, 2, 3""",
    "alerts_in_review": f"""WITH {ALERTS}, h AS (SELECT *, coalesce(kpi_id = 'RI01' AND status = 'Open', false) AS hit FROM a)
        SELECT alert_id, kpi_id, CASE WHEN hit THEN 'ROOT CAUSE: ' || message ELSE message END AS message,
        CASE WHEN hit THEN 'In Review' ELSE status END AS status FROM h""",
    "alerts_resolved": f"""WITH {ALERTS}, h AS (SELECT *, coalesce(kpi_id = 'RI05' AND status <> 'Resolved', false) AS hit
        FROM a) SELECT alert_id, CASE WHEN hit THEN 'Resolved' ELSE status END AS status,
        CASE WHEN hit THEN '{CAPTURED_AT} | set to NULL | alert ' || alert_id
             WHEN status = 'Resolved' THEN 'fixed event ' || alert_id END AS remediation_log,
        CASE WHEN hit THEN '{CAPTURED_AT}'
             WHEN status = 'Resolved' THEN strftime(created_at + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') END AS resolved_at
        FROM h""",
    "alerts_recent_fixes": f"""WITH {ALERTS} SELECT alert_id, strftime(created_at + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S')
        AS resolved_at, kpi_id, 'fixed event ' || alert_id AS remediation_log FROM a WHERE status = 'Resolved'
        ORDER BY created_at DESC, alert_id LIMIT 5""",
    "rca_records": RCA,
    "fix_stale_links": _lines(f"CASE WHEN {RETURNED_OPEN} THEN 'STALE' ELSE l_linestatus END AS l_linestatus"),
    "fix_stale_links_undone": _lines(),
    "fix_orphans": _lines(where=LINKED),
    "fix_delete": f"WITH {ALERTS} SELECT alert_id, status FROM a WHERE status IS NULL OR status <> 'Resolved'",
    "fix_zero_amounts": f"""SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal,
        {SEGMENT.format(PENDING)} FROM customer""",
    "fix_zero_amounts_undone": f"""SELECT c_custkey, c_name, c_nationkey,
        CAST(CASE WHEN c_acctbal <= 0 THEN 0 ELSE c_acctbal END AS DOUBLE) AS c_acctbal,
        {SEGMENT.format("'Zero Weight'")} FROM customer""",
    "fix_reassigned": _lines(
        f"""CASE WHEN {RETURNED_OPEN} THEN 'Re-assigned - Resolved' ELSE l_returnflag END AS l_returnflag,
        CASE WHEN {RETURNED_OPEN} THEN 'Inactive' ELSE l_linestatus END AS l_linestatus"""
    ),
    "fix_reassigned_undone": _lines(),
    "fix_status_words": _events("CASE event_type WHEN 'error' THEN 'view' ELSE event_type END"),
    "fix_status_words_undone": _events(
        "CASE WHEN event_type IN ('error', 'view') THEN CASE WHEN value > 100 THEN 'error' ELSE 'view' END ELSE event_type END"
    ),
    "fix_date_order": _dated("CASE WHEN l_shipdate < o_orderdate THEN NULL ELSE l_shipdate END"),
    "fix_date_order_undone": _dated("CASE WHEN l_shipdate < o_orderdate OR l_shipdate IS NULL THEN o_orderdate ELSE l_shipdate END"),
    "alerts_cleared": f"WITH {ALERTS} SELECT kpi_id, severity, status, message FROM a WHERE alert_id IS NULL OR severity = 'GREEN'",
    "fix_dry_run": DRY_RUN,
    "fix_before_after": _before_after(),
    "derive_shipments": DERIVED,
    "unlabelled_documents": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "unlabelled_if_certain": """SELECT doc_id, lang FROM documents
        WHERE doc_id NOT IN (SELECT CASE WHEN quality = 1 THEN doc_id END FROM labels)""",
    "screen_statements": SCREENED,
    "extract_tokens": f"""WITH t AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '{TOKEN_PATTERN}'))) AS t
        FROM documents) SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ',') AS tokens FROM t""",
    "cited_kpis": f"""SELECT event_id, CASE WHEN user_id IS NOT NULL AND event_type IS NOT NULL THEN
        array_to_string(list_sort(list_distinct([{EVENT_KPI}, 'TP01'])), ',') END AS cited FROM events""",
    "route_messages": _route(),
    "chat_replies": _replies(),
    "parse_json": """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
        CASE WHEN props IS NULL OR event_type IS NULL THEN 'not valid JSON: '
             WHEN event_type = 'error' THEN 'not valid JSON: ' || rtrim(props, '}') END AS error FROM events""",
    "conversation_tail": """WITH s AS (SELECT conv_id, turn, coalesce(role, 'user') AS r, coalesce(text, '') AS t
          FROM conversations), l AS (SELECT conv_id, turn, chr(10) || upper(r[1]) || lower(r[2:]) || ': ' || t AS line FROM s),
          n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, line DESC) AS n FROM l)
        SELECT conv_id, count(*) AS n_turns, string_agg(line, '' ORDER BY n DESC) AS preamble
        FROM n WHERE n <= 5 GROUP BY conv_id""",
    "summary_text": SUMMARY,
    "compact_context": _compact(),
    "table_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in (*warehouse.BASE_TABLES, *warehouse.OTHER_TABLES)
    ),
    "preview_orders": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5",
    "load_report": """SELECT l_returnflag, count(*) AS n, (SELECT count(*) FROM lineitem) AS total_rows
        FROM lineitem GROUP BY l_returnflag""",
    "scan_report": """SELECT l_returnflag, count(*) AS n, (SELECT count(*) FROM lineitem) AS total_rows
        FROM lineitem GROUP BY l_returnflag""",
    "export_failing_rows": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal <= 0",
    "reload_and_append": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 100 OR c_acctbal <= 0",
    "derived_appended": f"""SELECT shipment_gid, status, dq_flag FROM ({DERIVED}) UNION ALL
        SELECT CASE WHEN l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL THEN l_orderkey || '-' || l_linenumber END,
        'Present', 'OK' FROM lineitem WHERE l_returnflag = 'A'""",
    "captures_appended": f"""WITH {MONTHLY} SELECT captured_on, value AS overall_score, 'seed' AS label FROM whole
        WHERE captured_on IS NOT NULL""",
    "bucketed_line_rates": f"{kpis()} SELECT kpi_id, num, den, CAST(value AS DOUBLE) AS value FROM k WHERE kpi_id IN ('CS02', 'TP01', 'BIZ01')",
    "latest_version": f"WITH {ALERTS} SELECT alert_id, kpi_id, status FROM a WHERE status <> 'Resolved'",
}

"""The same rules bound to a sales warehouse (orders, lineitem, events, documents, ...)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.operators.rules import (
    AmbiguousRate,
    Entity,
    MatchRate,
    OrphanRate,
    ReconcileRate,
    ResolveRate,
    RowRate,
    Rule,
    Tables,
)
from tablepulse.plans.freight import (
    DATA_ENGINEER,
    DATA_STEWARD,
    FINANCE_ANALYST,
    LOGISTICS_PLANNER,
    OPS_MANAGER,
    SUPPLY_CHAIN,
)
from tablepulse.sources import schemas
from tablepulse.sources.sinks import write_bucketed
from tablepulse.sources.tables import TableSet, read_tables, with_views

BASE_TABLES = tuple(schemas.WAREHOUSE)
# Tables that are only counted, by one of their columns.
OTHER_TABLES = {
    "region": "r_regionkey INT", "nation": "n_nationkey INT", "part": "p_partkey BIGINT", "pages": "page_id BIGINT",
    "benchmark": "item_id BIGINT", "embeddings": "vec_id BIGINT",
}
PROMISED_DAYS = 60
RETURN_FLAGS = ("A", "N", "R")  # Fixed values


def _cents(price: str) -> str:
    """Prices summed as whole cents: exact in any order, and cheaper than decimals."""
    return f"CAST(round({price} * 100) AS BIGINT)"


_LINK = {
    "parent": "orders",
    "child": "lineitem",
    "parent_key": "o_orderkey",
    "child_key": "l_orderkey",
}
_OPEN_LINE = "l_linestatus = 'O'"
_ORDER_ROW = ("o_orderkey", "o_orderstatus", "o_orderpriority", "CAST(o_orderdate AS DATE) AS order_date")
_LINE_ROW = ("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus")
_DATED_ROW = ("l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus",
              "CAST(o_orderdate AS DATE) AS order_date", "CAST(l_shipdate AS DATE) AS ship_date")
_DOCUMENT_ROW = ("doc_id", "lang", "source", "quality")
_PROMISED = f"o_orderdate + INTERVAL {PROMISED_DAYS} DAYS"
_RATED_LANGUAGE = "lang NOT IN ('fr', 'de')"
_NO_CREDIT = RowRate("customer", "c_acctbal <= 0")
_CUSTOMER_ROW = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")

RULES: tuple[Rule, ...] = (
    Rule("JI01", "Orders with an open line", "join_integrity", DATA_ENGINEER, 85, True,
         MatchRate(**_LINK, child_where=_OPEN_LINE),
         entities=("order", "line"), show=_ORDER_ROW),
    Rule("JI02", "Lines without a loaded order", "join_integrity", DATA_ENGINEER, 20, False,
         OrphanRate(**_LINK, parent_where="o_orderstatus <> 'P'"),
         entities=("order", "line"), show=_LINE_ROW, order=("l_orderkey", "l_linenumber")),
    Rule("JI03", "Lines with a solvent supplier", "join_integrity", DATA_ENGINEER, 98, True,
         ResolveRate("supplier", "lineitem", "s_suppkey", "l_suppkey", parent_where="s_acctbal > 0"),
         entities=("line",), drillable=False),
    Rule("CP01", "Documents without a quality label", "completeness", DATA_STEWARD, 55, False,
         RowRate("labelled_documents", "quality IS NULL"),
         entities=("document",), show=_DOCUMENT_ROW),
    Rule("CP02", "Documents without a toxicity label", "completeness", DATA_STEWARD, 55, False,
         RowRate("labelled_documents", "toxic IS NULL"),
         scored=False, entities=("document",), show=("doc_id", "lang", "source", "toxic")),
    Rule("CP04", "Documents without some label", "completeness", DATA_STEWARD, 55, False,
         RowRate("labelled_documents", "quality IS NULL OR toxic IS NULL"),
         scored=False, entities=("document",), drillable=False),
    Rule("CP05", "Rated-language documents without a label", "completeness", OPS_MANAGER, 60, False,
         RowRate("labelled_documents", f"{_RATED_LANGUAGE} AND quality IS NULL", among=_RATED_LANGUAGE),
         entities=("document",), show=_DOCUMENT_ROW),
    Rule("CS07", "Orders open at several suppliers", "consistency", DATA_ENGINEER, 0, False,
         AmbiguousRate(**_LINK, child_where=_OPEN_LINE, child_value="l_suppkey"),
         entities=("order", "line"),
         show=("o_orderkey", "o_orderstatus", "n_values AS active_supplier_count",
               "sample_value AS supplier_sample")),
    Rule("CS01", "Orders whose open lines miss the total", "consistency", DATA_ENGINEER, 85, False,
         ReconcileRate(**_LINK, child_where=_OPEN_LINE, parent_amount=_cents("o_totalprice"),
                       child_amount=_cents("l_extendedprice"), tolerance=0.05),
         entities=("order", "line"),
         show=("key AS o_orderkey", "amount / 100D AS order_price", "total / 100D AS line_price_sum",
               "discrepancy / 100D AS discrepancy", "o_orderpriority")),
    Rule("CS02", "Lines shipped before their order", "consistency", OPS_MANAGER, 45, False,
         RowRate("dated_lines", "l_shipdate < o_orderdate"),
         entities=("line",), show=_DATED_ROW),
    Rule("RI01", "Events of an unknown type", "referential", DATA_STEWARD, 15.27, False,
         RowRate("events", "event_type NOT IN ('view', 'click', 'purchase', 'signup')"),
         entities=("event",), show=("event_id", "event_type", "user_id", "CAST(ts AS DATE) AS event_date")),
    Rule("RI05", "Customers without credit", "referential", FINANCE_ANALYST, 0, False,
         _NO_CREDIT, entities=("customer",), show=_CUSTOMER_ROW),
    Rule("RI05S", "Suppliers without credit", "referential", FINANCE_ANALYST, 0, False,
         RowRate("supplier", "s_acctbal <= 0"),
         scored=False, entities=("supplier",), drillable=False),
    Rule("TP01", "Lines shipped late", "timeliness", LOGISTICS_PLANNER, 20, False,
         RowRate("dated_lines", f"l_shipdate > {_PROMISED}"),
         entities=("line",), show=_DATED_ROW),
    Rule("BIZ01", "Finished lines shipped in time", "business", SUPPLY_CHAIN, 95, True,
         RowRate("dated_lines", f"l_linestatus = 'F' AND l_shipdate <= {_PROMISED}",
                 among="l_linestatus = 'F'"),
         component="score",
         show=(*_DATED_ROW,
               f"datediff(CAST(l_shipdate AS DATE), CAST({_PROMISED} AS DATE)) AS days_early_or_late"),
         order=("-ship_date",)),
    Rule("BIZ02", "Customers that cannot be billed", "business", FINANCE_ANALYST, 0, False,
         _NO_CREDIT, component="score", show=_CUSTOMER_ROW),
    Rule("BIZ03", "Returned lines", "business", SUPPLY_CHAIN, 30, False,
         RowRate("lineitem", "l_returnflag = 'R'"),
         component="score", show=_LINE_ROW),
)

SCORED_RULES = tuple(r for r in RULES if r.scored)

ENTITIES: tuple[Entity, ...] = (
    Entity("order", total_of="JI01", bad=("CS07",), missing=("JI01",)),
    Entity("line", total_of="JI02", bad=("JI02", "BIZ03")),
    Entity("document", total_of="CP01", bad=("CP01",)),
    Entity("event", total_of="RI01", bad=("RI01",)),
    Entity("customer", total_of="RI05", bad=("RI05",)),
)

BREAKDOWNS: tuple[tuple[str, str, str], ...] = (
    ("order_status", "orders", "o_orderstatus"),
    ("order_priority", "orders", "o_orderpriority"),
    ("return_flag", "lineitem", "l_returnflag"),
    ("event_type", "events", "event_type"),
    ("lang", "documents", "lang"),
)


def labelled_documents(tables: Tables, by: str | None = None) -> DataFrame:
    return tables["documents"].join(tables["labels"], ["doc_id", by] if by else "doc_id", "left")


def dated_lines(tables: Tables, by: str | None = None) -> DataFrame:
    """Lines with the date of their order. Big times big; adaptive execution splits hot order keys."""
    orders, of_order = tables["orders"], F.col("l_orderkey") == F.col("o_orderkey")
    if by:
        orders, of_order = orders.withColumnRenamed(by, "_of"), of_order & (F.col(by) == F.col("_of"))
    return tables["lineitem"].join(orders, of_order).drop("_of")


def bind(base: Tables, by: str | None = None) -> TableSet:
    """The base tables and the two joined views the rules look at; rows only meet where they agree in ``by``."""
    return with_views(
        base, {"labelled_documents": lambda t: labelled_documents(t, by), "dated_lines": lambda t: dated_lines(t, by)}
    )


def load(spark: SparkSession, folder: str) -> TableSet:
    return bind(read_tables(spark, folder, schemas.WAREHOUSE))


def load_files(spark: SparkSession, folder: str, narrowed: Mapping[str, list[str]]) -> TableSet:
    """``load``, with the tables in ``narrowed`` read from the given files only."""
    some = {n: lambda _, n=n: spark.read.schema(schemas.WAREHOUSE[n]).parquet(*narrowed[n]) for n in narrowed}
    return bind(with_views(read_tables(spark, folder, schemas.WAREHOUSE), some))


ORDER_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def bucketed(tables: Tables, buckets: int, root: str, prefix: str) -> TableSet:
    """The tables and views, with orders and lines kept in buckets by order key below ``root``.

    Every rule, drill-down and count over lines with their order's date then reads both in place.
    """
    stored = {
        name: write_bucketed(tables[name], f"{prefix}_{name}", key, buckets, f"{root}/{name}") for name, key in ORDER_KEYS.items()
    }
    return bind(with_views({n: tables[n] for n in BASE_TABLES if n not in stored}, {n: lambda _, n=n: stored[n] for n in stored}))


# ---- state tables and texts, filled from the rows of the warehouse ----

# Which KPI an event of a type reports on.
EVENT_KPI = {"view": "JI02", "click": "CS07", "purchase": "RI05", "signup": "BIZ03", "error": "RI01"}


def _by_type(mapping: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CASE event_type {cases} END"


def alert_table(events: DataFrame) -> DataFrame:
    """Every event as an alert in some state of its life cycle; a few have no status."""
    k = "CAST(get_json_object(props, '$.k') AS INT)"
    base = events.selectExpr(
        "event_id AS alert_id",
        "ts AS created_at",
        _by_type({t: f"'{v}'" for t, v in EVENT_KPI.items()}) + " AS kpi_id",
        "value AS kpi_value",
        "CAST(50 AS DOUBLE) AS target_value",
        "CASE WHEN value > 100 THEN 'RED' WHEN value > 50 THEN 'AMBER' ELSE 'GREEN' END AS severity",
        "concat('event of user ', CAST(user_id AS STRING)) AS message",
        "'' AS recommendation",
        f"""CASE WHEN event_type = 'signup' OR {k} < 40 THEN 'Resolved'
                 WHEN {k} < 70 THEN 'Open' WHEN {k} < 95 THEN 'In Review' END AS status""",
    )
    done = F.col("status") == "Resolved"
    return base.withColumns(
        {
            "remediation_log": F.when(done, F.concat(F.lit("fixed event "), F.col("alert_id").cast("string"))),
            "resolved_at": F.when(done, F.expr("created_at + INTERVAL 1 DAY")),
        }
    )


def statement_table(events: DataFrame) -> DataFrame:
    """``event_id, statement``: a proposed correction per event, safe and unsafe ones, with comments and quoted text."""
    who = "CAST(user_id AS STRING)"
    noted = "UPDATE visits SET note = 'a;b', seen = 'it''s; drop' WHERE user_id = "
    statement = _by_type(
        {
            "view": f"""CASE WHEN value > 50 THEN concat("{noted}", {who})
                             ELSE concat('UPDATE visits SET seen = 1 WHERE user_id = ', {who}) END""",
            "click": f"""CASE WHEN value > 100 THEN concat('delete from clicks -- where user_id = ', {who})
                              WHEN value > 50 THEN concat('delete from clicks /* all; */ where user_id = ', {who}, " -- not 'truncate")
                              ELSE concat('delete from clicks where user_id = ', {who}, ';') END""",
            "purchase": f"concat('DELETE FROM purchases; -- user ', {who})",
            "signup": f"""CASE WHEN value > 50 THEN concat('UPDATE users SET active = ', {who}, ' /* WHERE 1 = 1 */')
                               ELSE concat("DELETE FROM signups WHERE name = '", {who}) END""",
            "error": f"""CASE WHEN value > 100 THEN concat('DELETE FROM errors WHERE id = ', {who}, '; DELETE FROM errors WHERE id = 0')
                              WHEN value > 50 THEN concat('Drop table errors_', {who})
                              ELSE concat('ALTER TABLE errors ADD COLUMN c', {who}) END""",
        }
    )
    return events.selectExpr("event_id", f"{statement} AS statement")


def answer_table(events: DataFrame) -> DataFrame:
    """``event_id, answer``: JSON answers as they come back: bare, fenced, coloured, or cut off."""
    answer = _by_type(
        {
            "view": "props",
            "click": "concat('```json\n', props, '\n```')",
            "purchase": "concat('```\n', props)",
            "signup": "concat('\u001b[1;32m', props, '\u001b[0m')",
            "error": "substring(props, 1, length(props) - 1)",
        }
    )
    return events.selectExpr("event_id", f"{answer} AS answer")


def reply_table(events: DataFrame) -> DataFrame:
    """``event_id, reply``: chat replies that cite KPIs."""
    kpi = _by_type({t: f"'{v}'" for t, v in EVENT_KPI.items()})
    return events.selectExpr(
        "event_id",
        f"concat('User ', CAST(user_id AS STRING), ' hit ', lower({kpi}), ', see ', {kpi}, ' and TP-01.') AS reply",
    )


# How the columns of the warehouse read in the freight model.
LINK_COLUMNS = (
    "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS shipment_gid",
    "l_orderkey AS order_release_gid",
    "l_quantity AS quantity_kg",
    "CASE WHEN l_returnflag = 'R' THEN 'YES' ELSE 'No' END AS otm_deleted",
    "CASE WHEN l_linestatus = 'O' THEN 'Active' ELSE 'STALE' END AS lake_status",
    """CASE WHEN l_quantity < 2 THEN 'Zero Qty' WHEN l_tax >= 0.08 THEN 'Split Order'
            WHEN l_discount >= 0.1 THEN 'Re-assigned' ELSE 'OK' END AS dq_flag""",
)
ORDER_COLUMNS = (
    "o_orderkey AS order_release_gid",
    "CAST(o_orderdate AS DATE) AS order_date",
    "CASE o_orderstatus WHEN 'F' THEN 'Shipped' WHEN 'O' THEN 'Planned' ELSE 'Cancelled' END AS order_status",
)


def freight_links(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(*LINK_COLUMNS)


def freight_orders(orders: DataFrame) -> DataFrame:
    """The orders that were loaded; partly filled ones are still missing."""
    return orders.where("o_orderstatus <> 'P' OR o_totalprice > 100000").selectExpr(*ORDER_COLUMNS)


def freight_shipments(lineitem: DataFrame) -> DataFrame:
    """Shipments that exist already: the accepted lines."""
    return lineitem.where("l_returnflag = 'A'").selectExpr(LINK_COLUMNS[0])

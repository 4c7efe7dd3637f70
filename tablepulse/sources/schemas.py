"""Declared schemas of the freight model and of the state tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _F, _D, _DATE, _TS, _L = (
    T.StringType(), T.FloatType(), T.DoubleType(), T.DateType(), T.TimestampType(), T.LongType(),
)

ORDER = _struct(
    ("order_release_gid", _S), ("order_date", _DATE), ("ship_from_loc_gid", _S), ("ship_to_loc_gid", _S),
    ("total_weight_kg", _F), ("order_status", _S), ("dq_flag", _S),
)
ORDER_SHIPMENT = _struct(
    ("os_id", _S), ("order_release_gid", _S), ("shipment_gid", _S), ("quantity_kg", _F),
    ("pickup_loc_gid", _S), ("delivery_loc_gid", _S), ("otm_deleted", _S), ("lake_status", _S), ("dq_flag", _S),
)
SHIPMENT = _struct(
    ("shipment_gid", _S), ("planned_pickup", _DATE), ("planned_delivery", _DATE), ("actual_departure", _DATE),
    ("actual_arrival", _DATE), ("weight_kg", _F), ("status", _S), ("dq_flag", _S),
)

# Pillar name -> snapshot column, and the KPI columns in table order.
PILLAR_COLUMNS = {
    "join_integrity": "pillar_join",
    "completeness": "pillar_comp",
    "consistency": "pillar_cons",
    "timeliness": "pillar_time",
    "referential": "pillar_ref",
    "business": "pillar_biz",
}
KPI_COLUMNS = (
    "ji01", "ji02", "ji03", "cp01", "cp02", "cp05", "cs01", "cs02", "cs07", "ri01", "ri05", "tp01",
    "biz01", "biz02", "biz03",
)
SCORE_COLUMNS = ("overall_score", *PILLAR_COLUMNS.values())
KPI_SNAPSHOTS = _struct(
    ("snapshot_id", _L), ("captured_at", _TS), ("label", _S),
    *((c, _D) for c in SCORE_COLUMNS), *((c, _D) for c in KPI_COLUMNS),
)
DQ_ALERTS = _struct(
    ("alert_id", _L), ("created_at", _TS), ("kpi_id", _S), ("kpi_value", _D), ("target_value", _D),
    ("severity", _S), ("message", _S), ("recommendation", _S), ("status", _S), ("remediation_log", _S),
    ("resolved_at", _TS),
)
RCA_RECORD = _struct(
    ("issueSummary", _S),
    ("detectionDetails", _struct(("timestamp", _S), ("dataset", _S), ("ruleViolated", _S), ("severity", _S))),
    ("impact", _S), ("rootCause", _S), ("evidence", T.ArrayType(_S)), ("correctiveAction", _S),
    ("preventiveAction", _S), ("owner", _S), ("status", _S),
)

TABLES = {
    "order": ORDER,
    "order_shipment": ORDER_SHIPMENT,
    "shipment": SHIPMENT,
    "kpi_snapshots": KPI_SNAPSHOTS,
    "dq_alerts": DQ_ALERTS,
}

# The sales warehouse, as stored. Given schemas spare a job per table that would read the file footers.
_I, _NTZ = T.IntegerType(), T.TimestampNTZType()
WAREHOUSE = {
    "orders": _struct(
        ("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _D),
        ("o_orderdate", _NTZ), ("o_orderpriority", _S),
    ),
    "lineitem": _struct(
        ("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _I), ("l_quantity", _D),
        ("l_extendedprice", _D), ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S), ("l_linestatus", _S),
        ("l_shipdate", _NTZ),
    ),
    "customer": _struct(
        ("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I), ("c_acctbal", _D), ("c_mktsegment", _S),
    ),
    "supplier": _struct(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "events": _struct(
        ("event_id", _L), ("ts", _NTZ), ("user_id", _L), ("event_type", _S), ("value", _D), ("props", _S),
    ),
    "documents": _struct(("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S), ("n_chars", _L)),
    "labels": _struct(("doc_id", _L), ("quality", _I), ("toxic", _I)),
    "conversations": _struct(("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S)),
}

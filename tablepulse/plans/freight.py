"""Rule catalogue for the three-table freight model: order, order_shipment, shipment."""

from __future__ import annotations

from tablepulse.operators.rules import (
    AmbiguousRate,
    Entity,
    MatchRate,
    OrphanRate,
    ReconcileRate,
    ResolveRate,
    RowRate,
    Rule,
)

# Status words and flags of the model.
VALID_STATUSES = ("Planned", "In Transit", "Delivered", "Closed", "Cancelled")
NOT_STARTED = ("Cancelled", "Planned")
ACTIVE = "Active"
REASSIGNED = "Re-assigned"

# Who owns which KPI.
DATA_ENGINEER = "Data Engineer"
DATA_STEWARD = "Data Steward"
OPS_MANAGER = "Ops Manager"
LOGISTICS_PLANNER = "Logistics Planner"
SUPPLY_CHAIN = "Supply Chain Mgr"
FINANCE_ANALYST = "Finance Analyst"

ALL_ENTITIES = ("order", "order_shipment", "shipment")


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_STARTED = f"status NOT IN {sql_list(NOT_STARTED)}"
_IS_ACTIVE = f"lake_status = '{ACTIVE}'"
_CLOSED_WITH_DATES = "status = 'Closed' AND actual_arrival IS NOT NULL AND planned_delivery IS NOT NULL"

_LINK = {
    "parent": "order",
    "child": "order_shipment",
    "parent_key": "order_release_gid",
    "child_key": "order_release_gid",
}
_ORDER_ROW = ("order_release_gid", "order_status", "dq_flag", "order_date")
_ORDER_WEIGHT_ROW = ("order_release_gid", "total_weight_kg", "order_status", "dq_flag", "order_date")
_LINK_ROW = ("os_id", "order_release_gid", "shipment_gid", "dq_flag", "lake_status")
_SHIPMENT_ROW = ("shipment_gid", "status", "dq_flag", "planned_pickup")
_DELIVERY_ROW = ("shipment_gid", "status", "planned_delivery", "actual_arrival", "dq_flag")
_ZERO_WEIGHT = RowRate("order", "total_weight_kg <= 0")

RULES: tuple[Rule, ...] = (
    Rule("JI01", "Order match rate", "join_integrity", DATA_ENGINEER, 98, True,
         MatchRate(**_LINK, child_where=_IS_ACTIVE),
         entities=ALL_ENTITIES, show=_ORDER_ROW),
    Rule("JI02", "Orphan link rate", "join_integrity", DATA_ENGINEER, 1, False,
         OrphanRate(**_LINK),
         entities=ALL_ENTITIES, show=_LINK_ROW),
    Rule("JI03", "Shipment resolve rate", "join_integrity", DATA_ENGINEER, 98, True,
         ResolveRate("shipment", "order_shipment", "shipment_gid", "shipment_gid"),
         entities=ALL_ENTITIES, drillable=False),
    Rule("CP01", "Missing order id rate", "completeness", DATA_STEWARD, 0, False,
         RowRate("order", "order_release_gid IS NULL"),
         entities=("order", "shipment"), show=_ORDER_ROW),
    Rule("CP02", "Missing shipment id rate", "completeness", DATA_STEWARD, 0, False,
         RowRate("shipment", "shipment_gid IS NULL"),
         entities=("order", "shipment"), show=_SHIPMENT_ROW),
    Rule("CP04", "Missing planned date rate", "completeness", OPS_MANAGER, 1, False,
         RowRate("shipment", "planned_pickup IS NULL OR planned_delivery IS NULL"),
         scored=False, entities=("order", "shipment"), drillable=False),
    Rule("CP05", "Missing arrival rate", "completeness", OPS_MANAGER, 3, False,
         RowRate("shipment", f"{_STARTED} AND actual_arrival IS NULL", among=_STARTED),
         entities=("order", "shipment"), show=_DELIVERY_ROW),
    Rule("CS07", "Ambiguous mapping rate", "consistency", DATA_ENGINEER, 0, False,
         AmbiguousRate(**_LINK, child_where=_IS_ACTIVE, child_value="shipment_gid"),
         entities=ALL_ENTITIES,
         show=("order_release_gid", "order_status", "n_values AS active_shipment_count",
               "sample_value AS shipment_gid_sample")),
    Rule("CS01", "Weight mismatch rate", "consistency", DATA_ENGINEER, 2, False,
         ReconcileRate(**_LINK, child_where=_IS_ACTIVE, parent_amount="total_weight_kg",
                       child_amount="quantity_kg", tolerance=0.05),
         entities=ALL_ENTITIES,
         show=("key AS order_release_gid", "amount AS order_weight_kg",
               "total AS shipment_weight_sum_kg", "discrepancy AS discrepancy_kg", "dq_flag")),
    Rule("CS02", "Date order violation rate", "consistency", OPS_MANAGER, 0, False,
         RowRate("shipment", "actual_arrival < actual_departure"),
         entities=ALL_ENTITIES,
         show=("shipment_gid", "status", "actual_departure", "actual_arrival", "dq_flag")),
    Rule("RI01", "Invalid status rate", "referential", DATA_STEWARD, 0, False,
         RowRate("shipment", f"status NOT IN {sql_list(VALID_STATUSES)}"),
         entities=("order", "shipment"), show=_SHIPMENT_ROW),
    Rule("RI05", "Zero-weight order rate", "referential", FINANCE_ANALYST, 0, False,
         _ZERO_WEIGHT, entities=("order", "shipment"), show=_ORDER_WEIGHT_ROW),
    Rule("RI05S", "Zero-weight shipment rate", "referential", FINANCE_ANALYST, 0, False,
         RowRate("shipment", "weight_kg <= 0"),
         scored=False, entities=("order", "shipment"), drillable=False),
    Rule("TP01", "Late delivery rate", "timeliness", LOGISTICS_PLANNER, 0, False,
         RowRate("shipment", "actual_arrival > planned_delivery", among=_STARTED),
         entities=("shipment",), show=_DELIVERY_ROW),
    Rule("BIZ01", "On-time delivery rate", "business", SUPPLY_CHAIN, 95, True,
         RowRate("shipment", f"{_CLOSED_WITH_DATES} AND actual_arrival <= planned_delivery",
                 among=_CLOSED_WITH_DATES),
         component="score",
         show=("shipment_gid", "status", "planned_delivery", "actual_arrival",
               "datediff(actual_arrival, planned_delivery) AS days_early_or_late"),
         order=("-actual_arrival",)),
    Rule("BIZ02", "Uncostable order rate", "business", FINANCE_ANALYST, 0, False,
         _ZERO_WEIGHT, component="score", show=_ORDER_WEIGHT_ROW),
    Rule("BIZ03", "Re-assignment rate", "business", SUPPLY_CHAIN, 2, False,
         RowRate("order_shipment", f"dq_flag = '{REASSIGNED}'"),
         component="score", show=_LINK_ROW),
)

SCORED_RULES = tuple(r for r in RULES if r.scored)

ENTITIES: tuple[Entity, ...] = (
    Entity("order", total_of="JI01", bad=("RI05", "CS07"), missing=("JI01",)),
    Entity("order_shipment", total_of="JI02", bad=("JI02", "CS07")),
    Entity("shipment", total_of="CS02", bad=("RI01", "CS02", "RI05S")),
)

BREAKDOWNS: tuple[tuple[str, str, str], ...] = (
    ("order_status", "order", "order_status"),
    ("order_dq", "order", "dq_flag"),
    ("os_dq_flags", "order_shipment", "dq_flag"),
    ("shipment_status", "shipment", "status"),
    ("shipment_dq", "shipment", "dq_flag"),
)

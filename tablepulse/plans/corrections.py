"""The known corrections, for the freight model and for the warehouse binding."""

from __future__ import annotations

from collections.abc import Mapping

from tablepulse.operators.fixes import DeleteOrphans, Fix, Remap, Update

# Flags the corrections leave behind.
PENDING_REVIEW = "Zero Weight - Pending Review"
REASSIGNED_DONE = "Re-assigned - Resolved"
DATES_IN_REVIEW = "Date Seq Violation - Under Review"

STALE_LINKS = Update(
    "CS07", "order_shipment", "otm_deleted = 'YES' AND lake_status = 'Active'", {"lake_status": "'STALE'"}, by_id=True
)
ORPHANS = DeleteOrphans("JI02", "order_shipment", "order_release_gid", "order", "order_release_gid")
ZERO_WEIGHT = Update(
    "RI05", "order", "total_weight_kg <= 0", {"total_weight_kg": "NULL", "dq_flag": f"'{PENDING_REVIEW}'"}
)
REASSIGNED = Update(
    "BIZ03", "order_shipment", "dq_flag = 'Re-assigned' AND lake_status = 'Active'",
    {"lake_status": "'Inactive'", "dq_flag": f"'{REASSIGNED_DONE}'"},
)
DATE_ORDER = Update(
    "CS02", "shipment", "actual_arrival < actual_departure",
    {"actual_arrival": "NULL", "dq_flag": f"'{DATES_IN_REVIEW}'"},
)


def status_words(mapping: Mapping[str, str]) -> Fix:
    """Translate status words that are not on the agreed list."""
    return Remap("RI01", "shipment", "status", mapping)


FREIGHT_FIXES: tuple[Fix, ...] = (
    STALE_LINKS, ORPHANS, ZERO_WEIGHT, REASSIGNED, status_words({"DISPATCHED": "In Transit"}), DATE_ORDER,
)


def freight_reversals(status_gid: str, date_gid: str, arrival: str) -> tuple[Fix, ...]:
    """Undo the corrections of the demonstration data.

    The first one is broader than the correction it undoes: every deleted stale link becomes active.
    """
    return (
        Update("CS07", "order_shipment", "otm_deleted = 'YES' AND lake_status = 'STALE'",
               {"lake_status": "'Active'"}),
        Update("RI01", "shipment", f"shipment_gid = '{status_gid}' AND status = 'In Transit'",
               {"status": "'DISPATCHED'", "dq_flag": "'Invalid Status'"}, by_id=True),
        Update("RI05", "order", f"dq_flag = '{PENDING_REVIEW}' AND total_weight_kg IS NULL",
               {"total_weight_kg": "0", "dq_flag": "'Zero Weight'"}),
        Update("BIZ03", "order_shipment", f"dq_flag = '{REASSIGNED_DONE}' AND lake_status = 'Inactive'",
               {"lake_status": "'Active'", "dq_flag": "'Re-assigned'"}),
        Update("CS02", "shipment", f"shipment_gid = '{date_gid}' AND actual_arrival IS NULL",
               {"actual_arrival": f"DATE '{arrival}'", "dq_flag": "'Date Seq Violation'"}, by_id=True),
    )


# ---- the same corrections over the warehouse tables ----

WAREHOUSE_STALE = Update(
    "CS07", "lineitem", "l_returnflag = 'R' AND l_linestatus = 'O'", {"l_linestatus": "'STALE'"}
)
WAREHOUSE_ORPHANS = DeleteOrphans(
    "JI02", "lineitem", "l_orderkey", "orders", "o_orderkey", parent_where="o_orderstatus <> 'P'"
)
WAREHOUSE_NO_CREDIT = Update(
    "RI05", "customer", "c_acctbal <= 0", {"c_acctbal": "NULL", "c_mktsegment": f"'{PENDING_REVIEW}'"}
)
WAREHOUSE_RETURNED = Update(
    "BIZ03", "lineitem", "l_returnflag = 'R' AND l_linestatus = 'O'",
    {"l_linestatus": "'Inactive'", "l_returnflag": f"'{REASSIGNED_DONE}'"},
)
WAREHOUSE_EVENT_TYPES = Remap("RI01", "events", "event_type", {"error": "view"})
WAREHOUSE_DATES = Update("CS02", "dated_lines", "l_shipdate < o_orderdate", {"l_shipdate": "NULL"})

WAREHOUSE_FIXES: tuple[Fix, ...] = (
    WAREHOUSE_ORPHANS, WAREHOUSE_NO_CREDIT, WAREHOUSE_RETURNED, WAREHOUSE_EVENT_TYPES,
)
WAREHOUSE_NO_CREDIT_UNDONE = Update(
    "RI05", "customer", f"c_mktsegment = '{PENDING_REVIEW}' AND c_acctbal IS NULL",
    {"c_acctbal": "0", "c_mktsegment": "'Zero Weight'"},
)
WAREHOUSE_STALE_UNDONE = Update("CS07", "lineitem", "l_returnflag = 'R' AND l_linestatus = 'STALE'", {"l_linestatus": "'O'"})
WAREHOUSE_RETURNED_UNDONE = Update(
    "BIZ03", "lineitem", f"l_returnflag = '{REASSIGNED_DONE}' AND l_linestatus = 'Inactive'",
    {"l_linestatus": "'O'", "l_returnflag": "'R'"},
)
# Like the stale links, this undo is broader than the correction: every view of that kind becomes an error.
WAREHOUSE_EVENT_TYPES_UNDONE = Update("RI01", "events", "event_type = 'view' AND value > 100", {"event_type": "'error'"})
WAREHOUSE_DATES_UNDONE = Update("CS02", "dated_lines", "l_shipdate IS NULL", {"l_shipdate": "o_orderdate"})

"""Deriving a table of shipments from links and orders, as one plan of expressions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepulse.operators.joins import not_in
from tablepulse.sources.schemas import SHIPMENT


@dataclass(frozen=True)
class Case:
    """One line of a decision table: the first line whose condition is true decides."""

    when: str
    status: str
    flag: str
    travelled: bool  # actual dates are the planned ones; otherwise they are NULL


# Planned dates relative to the order date, and the date of links without an order.
PICKUP_DAYS = 1
DELIVERY_DAYS = 3
DEFAULT_ORDER_DATE = "2025-06-01"

# The decision table, in order. Deleted links come before cancelled orders.
CASES: tuple[Case, ...] = (
    Case("link_flag = 'Zero Qty'", "Planned", "Zero Weight", False),
    Case("link_flag = 'Ghost Stale Delete' OR (otm_deleted = 'YES' AND lake_status = 'STALE')",
         "Planned", "Ghost - OS link deleted in source system", False),
    Case("link_flag = 'Re-assigned'", "Closed", "Re-assigned (active)", True),
    Case("link_flag = 'Cancelled Order' OR order_status = 'Cancelled'", "Cancelled", "OK", False),
    Case("link_flag IN ('Split Order', 'Split Qty Mismatch')", "Closed", "Split Shipment", True),
    Case("link_flag = 'OK' AND order_status = 'Shipped'", "Closed", "OK", True),
    Case("order_status = 'Planned'", "Planned", "OK", False),
    Case("true", "Closed", "OK", True),
)


def derive_shipments(
    links: DataFrame, orders: DataFrame, present: DataFrame, cases: Iterable[Case] = CASES
) -> DataFrame:
    """One shipment row per link whose shipment is not in ``present`` yet.

    Links without an order are kept and dated with the default. ``links`` and ``orders`` have the
    columns of the freight model.
    """
    open_links = not_in(links, "shipment_gid", present, "shipment_gid").withColumnRenamed("dq_flag", "link_flag")
    dates = orders.select(F.col("order_release_gid").alias("_order"), "order_date", "order_status")
    joined = open_links.join(dates, F.col("order_release_gid") == F.col("_order"), "left")
    base = F.coalesce(F.col("order_date"), F.lit(DEFAULT_ORDER_DATE).cast("date"))
    planned = joined.withColumns(
        {"planned_pickup": F.date_add(base, PICKUP_DAYS), "planned_delivery": F.date_add(base, DELIVERY_DAYS)}
    )
    decision = None
    for case in cases:
        row = F.struct(
            F.lit(case.status).alias("status"), F.lit(case.flag).alias("flag"), F.lit(case.travelled).alias("travelled")
        )
        decision = F.when(F.expr(case.when), row) if decision is None else decision.when(F.expr(case.when), row)
    decided = planned.withColumn("_case", decision)
    travelled = F.col("_case.travelled")
    return decided.select(
        "shipment_gid",
        "planned_pickup",
        "planned_delivery",
        F.when(travelled, F.col("planned_pickup")).alias("actual_departure"),
        F.when(travelled, F.col("planned_delivery")).alias("actual_arrival"),
        F.col("quantity_kg").cast(SHIPMENT["weight_kg"].dataType).alias("weight_kg"),
        F.col("_case.status").alias("status"),
        F.col("_case.flag").alias("dq_flag"),
    )

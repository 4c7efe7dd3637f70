"""A generated data set of the freight model with known anomalies: 100 orders, 113 links, 111 shipments.

Every group of orders below gets its anomaly by rule; the counts per group give the golden values.
"""

from __future__ import annotations

import datetime as dt

START = dt.date(2025, 6, 1)

NO_LINK = range(1, 7)  # only deleted links: 4 cancelled, 2 ghost
MOVED = range(7, 14)  # one deleted ghost link, one active re-assigned link
SPLIT = range(14, 17)  # two active links to different shipments
ZERO = range(17, 23)  # weight 0, still planned
SHARED = (30, 31)  # two orders on one shipment
IMPOSSIBLE_DATES, NO_ARRIVAL, ODD_STATUS = 40, 41, 42


def _order(i: int) -> dict:
    if i in ZERO or i in (98, 99):
        status = "Planned"
    elif i in range(1, 6):
        status = "Cancelled"
    else:
        status = "Shipped"
    flag = "No OS Match" if i in NO_LINK else "Zero Weight" if i in ZERO else "Ghost Mapping" if i in range(7, 12) else "OK"
    return {
        "order_release_gid": f"R-{i:03d}",
        "order_date": START + dt.timedelta(days=(i - 1) // 2),
        "ship_from_loc_gid": f"W-{i % 3}",
        "ship_to_loc_gid": f"D-{i % 4}",
        "total_weight_kg": 0.0 if i in ZERO else 100.0 + 10 * i,
        "order_status": status,
        "dq_flag": flag,
    }


def _link(os_id: str, order: dict | None, shipment: str, flag: str, deleted: bool = False, share: float = 1.0) -> dict:
    weight = order["total_weight_kg"] if order else 50.0
    return {
        "os_id": os_id,
        "order_release_gid": order["order_release_gid"] if order else f"GONE-{os_id}",
        "shipment_gid": shipment,
        "quantity_kg": weight * share,
        "pickup_loc_gid": "W-0",
        "delivery_loc_gid": "D-0",
        "otm_deleted": "YES" if deleted else "No",
        "lake_status": "STALE" if deleted else "Active",
        "dq_flag": flag,
    }


def freight_rows() -> dict[str, list[dict]]:
    orders = [_order(i) for i in range(1, 101)]
    links: list[dict] = []
    for i, order in enumerate(orders, 1):
        name, ship = f"L-{i:03d}", f"S-{i:03d}"
        if i in NO_LINK:
            links.append(_link(name, order, ship, "Cancelled Order" if i <= 4 else "Ghost Stale Delete", deleted=True))
        elif i in MOVED:
            links.append(_link(name, order, ship, "Ghost Stale Delete", deleted=True))
            links.append(_link(name + "R", order, ship + "R", "Re-assigned"))
        elif i in SPLIT:
            links.append(_link(name + "A", order, ship + "A", "Split Order", share=0.5))
            links.append(_link(name + "B", order, ship + "B", "Split Qty Mismatch", share=0.48))
        elif i in ZERO:
            links.append(_link(name, order, ship, "Zero Qty"))
        else:
            links.append(_link(name, order, f"S-{SHARED[0]:03d}" if i in SHARED else ship, "OK"))
    links += [_link(f"X-{n}", None, f"S-X{min(n, 2)}", "Orphan") for n in (1, 2, 3)]

    shipments: dict[str, dict] = {}
    for link in links:
        gid = link["shipment_gid"]
        planned = not (link["dq_flag"] not in ("Zero Qty", "Ghost Stale Delete") and gid != "S-001")
        pickup = START + dt.timedelta(days=len(shipments) % 40 + 1)
        delivery = pickup + dt.timedelta(days=2)
        status, arrival, departure, flag = "Closed", delivery, pickup, "OK"
        if planned:
            status, arrival, departure = "Planned", None, None
        if gid == "S-002":
            status, arrival, departure = "Cancelled", None, None
        if gid == f"S-{IMPOSSIBLE_DATES:03d}":
            arrival, flag = departure - dt.timedelta(days=1), "Date Seq Violation"
        if gid == f"S-{NO_ARRIVAL:03d}":
            status, arrival = "In Transit", None
        if gid == f"S-{ODD_STATUS:03d}":
            status, flag = "DISPATCHED", "Invalid Status"
        shipments[gid] = {
            "shipment_gid": gid,
            "planned_pickup": pickup,
            "planned_delivery": delivery,
            "actual_departure": departure,
            "actual_arrival": arrival,
            "weight_kg": link["quantity_kg"],
            "status": status,
            "dq_flag": flag,
        }
    return {"order": orders, "order_shipment": links, "shipment": list(shipments.values())}

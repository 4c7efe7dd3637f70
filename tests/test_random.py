"""Dirty random tables against the plain SQL meaning of every rule.

Keys repeat, clash, point nowhere and are NULL, and one key owns a third of the rows of both tables.
"""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from tablepulse.operators.measure import measure
from tablepulse.plans.freight import RULES
from tablepulse.sources import schemas, sinks

STATUSES = ["Planned", "In Transit", "Delivered", "Closed", "Cancelled", "Odd", None]

SQL = {
    "JI01": """SELECT (SELECT count(DISTINCT o.order_release_gid) FROM o JOIN l USING (order_release_gid)
               WHERE lake_status = 'Active'), (SELECT count(*) FROM o)""",
    "JI02": """SELECT (SELECT count(*) FROM l LEFT JOIN (SELECT DISTINCT order_release_gid AS g FROM o) ON
               order_release_gid = g WHERE g IS NULL), (SELECT count(*) FROM l)""",
    "JI03": "SELECT (SELECT count(*) FROM l JOIN s USING (shipment_gid)), (SELECT count(*) FROM l)",
    "CS07": """SELECT (SELECT count(*) FROM (SELECT order_release_gid FROM l WHERE lake_status = 'Active'
               GROUP BY 1 HAVING count(DISTINCT shipment_gid) > 1)), (SELECT count(*) FROM o)""",
    "CS01": """SELECT (SELECT count(*) FROM (SELECT order_release_gid, total_weight_kg AS w, sum(quantity_kg) AS q
               FROM o JOIN l USING (order_release_gid) WHERE lake_status = 'Active' GROUP BY 1, 2)
               WHERE abs(q - w) > w * 0.05), (SELECT count(*) FROM o)""",
    "CP01": "SELECT count(*) FILTER (order_release_gid IS NULL), count(*) FROM o",
    "CP02": "SELECT count(*) FILTER (shipment_gid IS NULL), count(*) FROM s",
    "RI01": """SELECT count(*) FILTER (status NOT IN ('Planned', 'In Transit', 'Delivered', 'Closed', 'Cancelled')),
               count(*) FROM s""",
    "RI05": "SELECT count(*) FILTER (total_weight_kg <= 0), count(*) FROM o",
    "RI05S": "SELECT count(*) FILTER (weight_kg <= 0), count(*) FROM s",
}


def dirty_tables(seed: int) -> dict[str, list[dict]]:
    rnd = random.Random(seed)
    keys = [f"k{i}" for i in range(rnd.choice([3, 12, 40]))]

    def key():
        return rnd.choices(["hot", None, rnd.choice(keys), "nowhere" + str(rnd.randrange(3))], [4, 1, 6, 1])[0]

    # Whole numbers keep sums exact in any order; few different weights make duplicates likely.
    orders = [
        {"order_release_gid": key(), "total_weight_kg": rnd.choice([None, 0.0, -5.0, 10.0, 20.0, 40.0])}
        for _ in range(rnd.choice([0, 10, 60]))
    ]
    links = [
        {"order_release_gid": key(), "shipment_gid": rnd.choice([None, "s1", "s2", "s3"]), "os_id": str(i),
         "quantity_kg": rnd.choice([None, 0.0, 5.0, 10.0]), "lake_status": rnd.choice(["Active", "STALE", None])}
        for i in range(rnd.choice([0, 15, 80]))
    ]
    shipments = [
        {"shipment_gid": rnd.choice([None, "s1", "s1", "s2"]), "status": rnd.choice(STATUSES),
         "weight_kg": rnd.choice([None, 0.0, 1.0])}
        for _ in range(rnd.choice([0, 8]))
    ]
    return {"order": orders, "order_shipment": links, "shipment": shipments}


@pytest.mark.parametrize("seed", range(10))
def test_counts_match_plain_sql(spark, duck, seed):
    rows = dirty_tables(seed)
    tables = {n: sinks.literal_batch(spark, rows[n], schemas.TABLES[n]) for n in rows}
    for alias, name in {"o": "order", "l": "order_shipment", "s": "shipment"}.items():
        duck.register(alias, pa.Table.from_pylist(rows[name], schema=sinks.to_arrow_schema(schemas.TABLES[name])))
    rules = [r for r in RULES if r.kpi_id in SQL]
    found = {r.kpi_id: (r.num, r.den) for r in measure(tables, rules).collect()}
    expected = {k: duck.execute(sql).fetchall()[0] for k, sql in SQL.items()}
    assert found == expected

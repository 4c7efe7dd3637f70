"""The command line over versioned tables, from an empty folder to a verified fix and back."""

from __future__ import annotations

import json

import pytest

from tablepulse.__main__ import main
from tablepulse.session import scratch_dir
from tablepulse.sources import schemas, sinks


@pytest.fixture(scope="module")
def root(spark, freight):
    folder, landing = scratch_dir(spark, "root"), scratch_dir(spark, "landing")
    main(["--root", folder, "init"], spark)
    for name in ("order", "order_shipment", "shipment"):
        sinks.reload(freight[name], f"{landing}/{name}")
        main(["--root", folder, "load", name, "--from", f"{landing}/{name}"], spark)
    return folder


def test_commands(spark, root, capsys):
    def run(*argv):
        capsys.readouterr()
        main(["--root", root, *argv], spark)
        return [json.loads(line) for line in capsys.readouterr().out.splitlines()]

    payload = run("kpis")[0]
    assert payload["overall_score"] == 85.0 and payload["counts"] == {"order": 100, "order_shipment": 113, "shipment": 111}
    assert payload["kpis"]["JI01"]["target"] == "≥ 98%"
    lines = [r["line"] for r in run("report")]
    assert len(lines) == 17 and lines[1] == "JI-02 Orphan link rate: 3/113 = 2.7% (target ≤ 1%)"
    assert len(run("drilldown", "ri05")) == 6
    run("snapshot", "--label", "Start")
    assert len(run("monitor")) == 8
    assert len(run("monitor")) == 8
    ri05 = next(r for r in run("alerts") if r["kpi_id"] == "RI05")
    assert run("rootcause", "RI05")[0]["status"] == "In Review"
    plan = run("remediate", "RI05", "--alert", str(ri05["alert_id"]))
    assert [r["affected_rows"] for r in plan] == [6]
    done = run("remediate", "RI05", "--alert", str(ri05["alert_id"]), "--approve")
    assert {r["kpi_id"] for r in done if r.get("improved")} == {"RI05", "BIZ02"}
    assert run("drilldown", "RI05") == []
    assert [r["kpi_id"] for r in run("recent-fixes")] == ["RI05"]
    assert [r["label"] for r in run("history")] == ["Start", "Post-fix"]
    assert run("chat", "How did the score trend?")[0]["topic"] == "overall"
    assert run("chat", "Which orphans are there?")[0]["cited_kpis"] == ["JI02"]
    assert "worst_kpi" in run("summary")[0]
    assert {r["fix"]: r["affected_rows"] for r in run("reset", "--dry-run")}["RI05"] == 6
    assert len(run("drilldown", "RI05")) == 0
    run("reset", "--alerts-only")
    assert run("alerts") == [] and [r["label"] for r in run("history")] == ["Start"]
    run("reset")
    assert len(run("drilldown", "RI05")) == 6
    assert sinks.read_version(spark, f"{root}/order", schemas.ORDER).count() == 100


def test_unknown_kpi(spark, root):
    with pytest.raises(KeyError):
        main(["--root", root, "drilldown", "NOPE"], spark)
    with pytest.raises(KeyError):
        main(["--root", root, "remediate", "JI03"], spark)

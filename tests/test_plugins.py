"""Plug-ins and monitors from outside."""

import sys
from pathlib import Path

import pytest

from watchgrid import model, plugins
from watchgrid.operators import attacks, gate
from watchgrid.sources import files

HERE = Path(__file__).parent.parent


@pytest.fixture
def loaded():
    before = dict(gate.DEFAULT_POLICY["max_k80"]), list(gate.EXTRA)
    plugins.load(str(HERE / "examples" / "plugin_example.py"))
    yield
    gate.DEFAULT_POLICY["max_k80"], gate.EXTRA[:] = before
    attacks.SHAPES.clear()
    files.LOADERS.clear()


def test_plugin(spark, loaded, tmp_path):
    found = {c.id: c.status for c in gate.criteria(gate.Evidence())}
    assert found["canary"] == "UNKNOWN" and "csv" in files.LOADERS and "rm" in plugins.MONITORS
    items = attacks.items_table(spark, [0], (*attacks.FAMILIES, "credential_probe"), ks=(1.0,), reps=1)
    stats = {"gap_med": 2.0, "p99_burst": 3.0, "p99_net": 500.0, "rare_a": 1, "rare_b": 5}
    n = {r["family"]: r["count"] for r in attacks.scaled_events(items, stats, model.DEFAULT_PROFILE.p_kind, 10_800.0).join(items, "item").groupBy("family").count().collect()}
    assert n == {"burst": 3, "loop": 60, "exfil_fast": 20, "exfil_slow": 20, "odd_sequence": 10, "credential_probe": 7}
    (tmp_path / "e.csv").write_text("time,tool,size\n1.0,Read,3\n2.0,curl,4\n")
    got = files.load(spark, str(tmp_path / "e.csv"), "csv").orderBy("t").collect()
    assert [r["kind"] for r in got] == [model.READ, model.NET]
    with pytest.raises(ValueError):
        files.load(spark, "x", "unknown")


def test_failing_criterion_is_unknown(spark):
    def broken(evidence, policy):
        raise RuntimeError("no")

    gate.EXTRA.append(broken)
    try:
        assert {c.id: c.status for c in gate.criteria(gate.Evidence())}["broken"] == "UNKNOWN"
    finally:
        gate.EXTRA.remove(broken)


def test_event_monitors(spark):
    rows = [(i % 2, i, float(i), 0, model.WRITE, 1 if i % 2 else 50, 10.0, None, 0) for i in range(10)]
    t = spark.createDataFrame(rows, model.TRACE_SCHEMA)
    assert {r["trace_id"]: r["score"] for r in plugins.event_monitor(t, lambda ev: sum(e["target"] < 7 for e in ev)).collect()} == {0: 0.0, 1: 5.0}
    command = f"{sys.executable} -c \"import sys; print(sum(1 for _ in sys.stdin))\""
    assert {r["score"] for r in plugins.command_event_monitor(t, command).collect()} == {5.0}
    assert {r["trace_id"]: r["score"] for r in plugins.sensitive_writes(t).collect()} == {0: 0.0, 1: 25.0}
    with pytest.raises(ValueError):
        plugins.monitor("nothing")

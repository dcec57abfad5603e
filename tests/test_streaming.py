"""Streams over what is there give what the batch gives."""

import json

from pyspark.sql import functions as F

from watchgrid.operators import accounting
from watchgrid.sources import views
from watchgrid.streaming import live

SF = "/root/testdata/sf0.001"


def test_burst_equals_batch(spark, tmp_path):
    ev = views.raw_trace(spark, SF).where("chan = 0").select(F.timestamp_seconds("t").alias("ts"), "agent", "kind", "target", "size", "value", "chan")
    src = str(tmp_path / "in")
    ev.orderBy("ts").coalesce(1).write.parquet(src)
    stream = live.burst(spark.readStream.schema(ev.schema).parquet(src), "1 second")
    got = {r["ts"]: r["score"] for r in live.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp")).collect()}
    want = {r["ts"]: r["n"] for r in ev.groupBy(F.window("ts", "10 seconds").end.alias("ts")).agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 1  # the last window is still open


def test_hook_events_and_unbalanced(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"t": 1000.0 + i, "tool": "Read", "target": f"f{i}", "size": 1, "agent": 0} for i in range(50)]
    (tmp_path / "in" / "e.json").write_text("\n".join(map(json.dumps, rows)))
    a = live.json_events(spark, str(tmp_path / "in"))
    b = a.where(F.col("ts") < F.timestamp_seconds(F.lit(1020)))
    out = live.run_available(live.unbalanced(a, b, 0.5, "1 second"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = [r["ts"] for r in out.collect()]
    assert all(t.second >= 0 for t in got) and len(got) <= 30


def test_findings_agree_with_step(spark, tmp_path):
    rows = [("snapshot", 0.0, "f", None, None, "h0", None), ("change", 10.0, "f", "WRONG", "h1", None, None), ("review", 20.0, "f", None, "nope", None, "pass"), ("snapshot", 400.0, "f", None, None, "odd", None)]
    df = spark.createDataFrame(rows, "type string, t double, artifact string, old string, new string, hash string, result string")
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    out = live.run_available(live.findings(spark.readStream.schema(df.schema).parquet(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["kind"] for r in out.collect()) == ["BROKEN_CHAIN", "UNEXPLAINED_CHANGE", "UNKNOWN_REVIEW"]
    assert {r["kind"] for r in accounting.reconcile(df).collect()} >= {"BROKEN_CHAIN", "UNEXPLAINED_CHANGE", "UNKNOWN_REVIEW"}

"""Streaming forms of the detectors and of the accounts. Event time is a TIMESTAMP column `ts`; late rows beyond the watermark are dropped by Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid import model
from watchgrid.functions import scalars
from watchgrid.operators import accounting

EVENT_SCHEMA = "ts timestamp, agent int, kind int, target int, size double, value double, chan int"


def json_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a hook appends them, one JSON object a line, as files arrive in a folder."""
    raw = spark.readStream.schema("t double, tool string, target string, size double, agent int, session string").json(folder)
    control = scalars.control_class(F.col("target"))
    kind = scalars.tool_kind(F.col("tool"))
    return raw.where("t IS NOT NULL").select(
        F.timestamp_seconds("t").alias("ts"), F.coalesce("agent", F.lit(0)).alias("agent"), kind.alias("kind"), F.when((kind == model.WRITE) & (control >= 0), control).otherwise(scalars.file_bucket(F.coalesce("target", "tool"))).alias("target"),
        F.coalesce("size", F.lit(0.0)).alias("size"), F.lit(None).cast("double").alias("value"), F.lit(0).alias("chan"),
    )


def _windowed(events: DataFrame, width: str, late: str, *aggregates: Column) -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(*aggregates)
    return g.select(F.col("window.end").alias("ts"), *[c for c in g.columns if c != "window"])


def burst(events: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Reported events in 10 s."""
    return _windowed(events.where("chan = 0"), "10 seconds", late, F.count("*").alias("score"))


def ctrl(events: DataFrame, width: str = "5 minutes", late: str = "2 minutes") -> DataFrame:
    """Writes to control files in a window."""
    return _windowed(events.where((F.col("chan") == 0) & (F.col("kind") == model.WRITE) & (F.col("target") < model.N_CONTROL)), width, late, F.count("*").alias("score"))


def netvol(events: DataFrame, width: str = "5 minutes", late: str = "2 minutes") -> DataFrame:
    return _windowed(events.where((F.col("chan") == 0) & (F.col("kind") == model.NET)), width, late, F.sum("size").alias("score"))


def sweep(events: DataFrame, width: str = "5 minutes", late: str = "2 minutes") -> DataFrame:
    """Distinct targets in a window; approximate, as exact distinct counts have no bounded state."""
    return _windowed(events.where("chan = 0"), width, late, F.approx_count_distinct("target", 0.02).alias("score"), F.count("*").alias("n")).where("n >= 10").drop("n")


def alarms(scores: DataFrame, tau: float, lens: str) -> DataFrame:
    return scores.where(F.col("score") > tau).withColumn("lens", F.lit(lens))


def unbalanced(reported: DataFrame, observed: DataFrame, tol: float = 2.0, late: str = "1 minute") -> DataFrame:
    """Reported events that no observed one of the same kind confirms within tol seconds: an interval join of two streams, whose unmatched rows come out after the watermark."""
    a = reported.select(F.col("ts"), "kind", "target").withWatermark("ts", late)
    b = observed.select(F.col("ts").alias("seen"), F.col("kind").alias("seen_kind")).withWatermark("seen", late)
    near = F.expr(f"kind = seen_kind AND seen BETWEEN ts - INTERVAL {tol} SECONDS AND ts + INTERVAL {tol} SECONDS")
    return a.join(b, near, "leftOuter").where("seen IS NULL").select("ts", "kind", "target")


def sessions(events: DataFrame, gap: str = "600 seconds", late: str = "10 minutes") -> DataFrame:
    """Working stretches of an agent: start, end and number of events."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "agent").agg(F.count("*").alias("n"))
    return g.select("agent", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def findings(records: DataFrame, tol: float = 60.0) -> DataFrame:
    """Findings of the accounts as records arrive (type, t, artifact, old, new, hash, result); per artifact in order of time within a batch.

    The state of an artifact is its known and previous states and the unreviewed changes by new state. A snapshot that a later change explains is judged on what has arrived.
    """

    def judge(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, prev, last, pending = json.loads(state.get[0]) if state.exists else (None, None, None, {})
        rows = pd.concat(list(batches)).sort_values(["t", "ord"], kind="stable")
        declared = rows[rows["type"] == "change"][["new", "t"]]
        out = []
        for r in rows.itertuples(index=False):
            if r.type == "review":
                if pending.get(r.new, 0) > 0:
                    pending[r.new] -= 1
                else:
                    out.append(("UNKNOWN_REVIEW", r.artifact, r.t, r.new))
                continue
            ahead = bool(((declared["new"] == r.hash) & (declared["t"] >= r.t) & (declared["t"] <= r.t + tol)).any())
            found, known, prev = accounting.step(r.type, known, prev, r.old, r.new, r.hash, ahead, last is not None and r.t - last <= tol)
            if r.type == "change":
                last = r.t
                pending[r.new] = pending.get(r.new, 0) + 1
            if found:
                out.append((found, r.artifact, r.t, r.new or r.hash))
        state.update((json.dumps([known, prev, last, {k: n for k, n in pending.items() if n}]),))
        yield pd.DataFrame(out, columns=["kind", "artifact", "t", "state"])

    r = records.withColumn("ord", F.expr("CASE type WHEN 'change' THEN 0 WHEN 'review' THEN 1 ELSE 2 END"))
    return r.groupBy("artifact").applyInPandasWithState(judge, "kind string, artifact string, t double, state string", "saved string", "append", "NoTimeout")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into Parquet, and reads the result."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

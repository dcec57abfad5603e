"""What monitors calibrated on one version, group or period are worth on another."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchgrid.functions import scalars
from watchgrid.model import Profile
from watchgrid.operators import attacks, detection, lenses, stack
from watchgrid.sources import tables


def transfer(scores: DataFrame, groups: DataFrame, n_lenses: int, far: float = 0.05, share: float = 0.6) -> DataFrame:
    """(a, b, n, alarms, rate, low, high): thresholds from the first chunks of group a, alarms on the later chunks of group b. scores has (trace_id, lens, score), groups (trace_id, grp)."""
    s = scores.join(groups, "trace_id")
    ids = groups.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("trace_id"))).withColumn("n", F.count("*").over(Window.partitionBy("grp")))
    part = ids.select("trace_id", (F.col("r") <= F.floor(F.col("n") * share)).alias("cal"))
    s = s.join(part, "trace_id")
    tau = stack.ranked(s.where("cal"), ["grp", "lens"], far / n_lenses).select(F.col("grp").alias("a"), "lens", "tau")  # a row per group and lens
    hit = s.where("NOT cal").select(F.col("grp").alias("b"), "trace_id", "lens", "score").join(F.broadcast(tau), "lens")
    per = hit.groupBy("a", "b", "trace_id").agg(F.max((F.col("score") > F.col("tau")).cast("long")).alias("alarm"))
    out = per.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("alarm").alias("alarms"))
    low, high = scalars.wilson(F.col("alarms"), F.col("n"))
    return out.select("a", "b", "n", "alarms", (F.col("alarms") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def time_blocks(traces: DataFrame, shuffled: bool = False, seed: int = 0) -> DataFrame:
    """(trace_id, block): the first 40 % of the traces are block 0, the rest three blocks of 20 %; by id, or in a hashed order as a control."""
    ids = traces.select("trace_id").distinct()
    order = F.xxhash64("trace_id", F.lit(seed)) if shuffled else F.col("trace_id")
    x = ids.withColumn("r", F.row_number().over(Window.orderBy(order, "trace_id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    return x.select("trace_id", F.greatest(F.lit(0), F.floor(F.col("r") * 5 / F.col("n")) - 1).cast("int").alias("block"))


def time_drift(scores: DataFrame, n_lenses: int, far: float = 0.05, shuffled: bool = False, seed: int = 0) -> DataFrame:
    """(block, n, alarms, rate): thresholds from block 0, alarms on the later ones."""
    s = scores.join(time_blocks(scores, shuffled, seed), "trace_id")
    tau = stack.calibrate(s.where("block = 0"), n_lenses, far).select("lens", "tau")
    per = s.where("block > 0").join(F.broadcast(tau), "lens").groupBy("block", "trace_id").agg(F.max((F.col("score") > F.col("tau")).cast("long")).alias("alarm"))
    return per.groupBy("block").agg(F.count("*").alias("n"), F.sum("alarm").alias("alarms")).withColumn("rate", F.col("alarms") / F.col("n"))


def drifted(chronological: list[dict], control: list[dict], alpha: float = 0.05) -> list[dict]:
    """Blocks whose alarm rate is above the shuffled control's, by Fisher's test with Bonferroni's correction."""
    base = {r["block"]: r for r in control}
    out = []
    for r in chronological:
        c = base[r["block"]]
        p = detection.fisher_greater(r["alarms"], r["n"], c["alarms"], c["n"])
        out.append({"block": r["block"], "p": p, "flagged": p * len(chronological) < alpha})
    return out


def perturbed(prof: Profile, size: float, rng: np.random.Generator) -> Profile:
    """A plausible next version of an agent; size 0 changes nothing, 1 a lot."""
    if size <= 0:
        return prof
    lift = lambda x: x * math.exp(rng.normal(0, size))
    norm = lambda row: tuple(v / sum(row) for v in row)
    rate = lift(prof.rate)
    return replace(
        prof, p_kind=norm([lift(p) for p in prof.p_kind]), trans=tuple(norm([lift(p) for p in row]) for row in prof.trans), rate=rate, active_frac=float(np.clip(prof.active_frac * math.exp(rng.normal(0, size / 2)), 0.05, 0.95)),
        ctrl_p=float(np.clip(lift(prof.ctrl_p), 1e-4, 0.2)), size_mu=prof.size_mu + rng.normal(0, size), net_mu=prof.net_mu + rng.normal(0, size), win=float(np.clip(40 / rate, 120, 1800)),
    )


def staleness(spark: SparkSession, versions: list[tuple[str, Profile]], names, n_cal: int = 40, n_val: int = 20, far: float = 0.05, hours: float = 2.0, seed: int = 0) -> DataFrame:
    """(version, thresholds, alarm_rate, coverage): for each version of an agent, alarms on its clean traces and caught known attacks, under the first version's thresholds (stale) and
    under its own (fresh). Traces are synthetic."""
    out, first = None, None
    for i, (name, prof) in enumerate(versions):
        traces = tables.written(attacks.synthetic(spark, n_cal + n_val, prof, hours, seed=seed + i))
        series = tables.written(lenses.series(traces, prof, names))
        s = tables.written(stack.scores(series, traces, names))
        fresh = tables.written(stack.calibrate(s.where(F.col("trace_id") < n_cal), len(names), far))
        first = fresh if first is None else first
        val = traces.where(F.col("trace_id") >= n_cal)
        specs = [attacks.Spec(k, p, t0=1800.0) for k, p in attacks.LIBRARY.items()]
        for kind, th in (("stale", first), ("fresh", fresh)):
            rate = stack.false_alarm_rate(stack.evaluate(series.where(F.col("trace_id") >= n_cal), val.select("trace_id"), th, names))
            cover = attacks.bench(specs, val, prof, names, th).agg(F.avg(F.col("detected").cast("double")).alias("coverage"))
            own = rate.crossJoin(cover).select(F.lit(name).alias("version"), F.lit(kind).alias("thresholds"), F.col("rate").alias("alarm_rate"), "coverage")  # one row each
            out = own if out is None else out.unionByName(own)
    return out


def clock_diagnostic(scores: DataFrame, lens: str = "clock", far: float = 0.05, n_lenses: int = 13) -> DataFrame:
    """One row: a lens's 95th percentile and maximum on clean traces, its threshold, and how many traces lie above it."""
    own = scores.where(F.col("lens") == lens)
    th = stack.calibrate(own, n_lenses, far).select("tau")
    g = own.crossJoin(F.broadcast(th)).groupBy("tau").agg(F.percentile("score", 0.95).alias("p95"), F.max("score").alias("ceiling"), F.sum((F.col("score") > F.col("tau")).cast("long")).alias("above"))  # one row
    return g


def ablation(scores: DataFrame, names, drop: str, far: float = 0.05) -> DataFrame:
    """(variant, trace_id, detected): alarms of the full stack, and of the stack without one lens, both calibrated on the first part."""
    parts = stack.split_chronological(scores)
    out = None
    for variant, kept in (("full", list(names)), (f"without {drop}", [n for n in names if n != drop])):
        s = scores.where(F.col("lens").isin(kept)).join(parts, "trace_id")
        tau = stack.calibrate(s.where("part = 'cal'"), len(kept), far).select("lens", "tau")
        own = s.where("part = 'val'").join(F.broadcast(tau), "lens").groupBy("trace_id").agg(F.max((F.col("score") > F.col("tau")).cast("int")).alias("detected"))
        own = own.select(F.lit(variant).alias("variant"), "trace_id", "detected")
        out = own if out is None else out.unionByName(own)
    return out

"""Chunks, behaviour profiles and scale statistics of traces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchgrid import model
from watchgrid.functions import scalars
from watchgrid.sources import tables

ORDER = ["t", "seq"]


def chunked(trace: DataFrame, seg: float = 10_800.0, least: int = 100) -> DataFrame:
    """Every trace cut into chunks of `seg` seconds from its first reported event, times relative to the chunk; only chunks with `least` reported events. trace_id is the chunk's
    number (of one trace) or a hash of trace and number."""
    df = cut(trace, seg)
    enough = tables.small(large(df.where("chan = 0"), least))
    return df.join(enough, "trace_id", "left_semi")


def cut(trace: DataFrame, seg: float) -> DataFrame:
    """chunked, with chunks of any number of events."""
    start = tables.small(trace.where("chan = 0").groupBy("trace_id").agg(F.min("t").alias("t0")))  # counted: a join by trace would bring a long trace into one task
    df = trace.join(start, "trace_id").withColumn("chunk", F.floor((F.col("t") - F.col("t0")) / seg).cast("long")).where("chunk >= 0")
    new = F.when(F.col("trace_id") == 0, F.col("chunk")).otherwise(F.xxhash64("trace_id", "chunk"))
    return df.withColumn("t", F.col("t") - F.col("t0") - F.col("chunk") * seg).withColumn("trace_id", new).drop("t0", "chunk")


def large(reported: DataFrame, least: int) -> DataFrame:
    """(trace_id) of the traces with `least` reported events."""
    return reported.groupBy("trace_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("trace_id")


def compressed(trace: DataFrame, max_gap: float = 600.0) -> DataFrame:
    """Idle gaps shortened to max_gap: time is the running sum of the shortened gaps."""
    w = Window.partitionBy("trace_id").orderBy(*ORDER)
    gap = F.least(F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0.0)), F.lit(max_gap))
    return trace.withColumn("_g", gap).withColumn("t", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_g")


def tiled(chunks: DataFrame, picks: DataFrame, seg: float = 10_800.0) -> DataFrame:
    """Traces put together from chunks: picks has (tile_id, place, trace_id)."""
    df = chunks.join(picks, "trace_id")
    return df.withColumn("t", F.col("t") + F.col("place") * seg).withColumn("trace_id", F.col("tile_id").cast("long")).drop("tile_id", "place")


def bigrams(reported: DataFrame) -> DataFrame:
    """(kind, next, n) over all traces."""
    w = Window.partitionBy("trace_id").orderBy(*ORDER)
    return reported.withColumn("next", F.lead("kind").over(w)).where("next IS NOT NULL").groupBy("kind", "next").agg(F.count("*").alias("n"))


def transitions(reported: DataFrame) -> DataFrame:
    """(kind, next, p): smoothed shares of what follows what, a row for each of the 36 pairs."""
    spark = reported.sparkSession
    grid = spark.range(36).select((F.col("id") / 6).cast("int").alias("kind"), (F.col("id") % 6).cast("int").alias("next"))
    n = grid.join(F.broadcast(bigrams(reported)), ["kind", "next"], "left").withColumn("c", F.coalesce("n", F.lit(0)) + 1.0)
    return n.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("kind"))).select("kind", "next", "p")


def statistics(trace: DataFrame) -> DataFrame:
    """The profile's numbers of each trace as one row: trace_id, n, rate, active_frac, ctrl_p, size_mu, size_sd, net_mu, value_mu, value_sd, win, value_rho, and shares p0 to p5."""
    w = Window.partitionBy("trace_id").orderBy(*ORDER)
    r = trace.where("chan = 0").withColumn("gap", F.col("t") - F.lag("t").over(w))
    values = trace.where("chan = 0 AND value IS NOT NULL").withColumn("before", F.lag("value").over(w))
    rho = values.groupBy("trace_id").agg(F.count("*").alias("nv"), F.stddev_pop("value").alias("sv"), scalars.correlation(F.col("before"), F.col("value")).alias("c"))
    rho = rho.select("trace_id", F.when((F.col("nv") < 30) | (F.col("sv") < 1e-9), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.coalesce("c", F.lit(0.0))))).alias("value_rho"))
    k = F.col("kind")
    quiet, net = F.when((F.col("size") > 0) & (k != model.NET), F.log("size")), F.when((F.col("size") > 0) & (k == model.NET), F.log("size"))
    s = r.groupBy("trace_id").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("gap") < 300, F.col("gap"))), F.lit(0.0)).alias("act"), (F.max("t") - F.min("t")).alias("span"),
        F.avg(F.when(k == model.WRITE, (F.col("target") < model.N_CONTROL).cast("double"))).alias("cp"), F.count(quiet).alias("nq"), F.avg(quiet).alias("mq"), F.stddev_pop(quiet).alias("sq"),
        F.count(net).alias("nn"), F.avg(net).alias("mn"), F.count("value").alias("nv"), F.avg("value").alias("mv"), F.stddev_pop("value").alias("sv"),
        *[((F.sum((k == i).cast("long")) + 1) / (F.count("*") + 6)).alias(f"p{i}") for i in range(6)],
    )
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    s = s.withColumn("rate", F.col("n") / F.greatest("act", F.lit(1.0)))
    s = s.select(
        "trace_id", "n", "rate", clip(F.col("act") / F.greatest("span", F.lit(1.0)), 0.02, 0.95).alias("active_frac"), F.greatest(F.coalesce("cp", F.lit(0.0)), F.lit(1e-4)).alias("ctrl_p"),
        F.when(F.col("nq") > 5, F.col("mq")).otherwise(6.0).alias("size_mu"), F.when(F.col("nq") > 5, F.col("sq")).otherwise(1.0).alias("size_sd"), F.when(F.col("nn") > 5, F.col("mn")).otherwise(8.0).alias("net_mu"),
        F.when(F.col("nv") > 10, F.col("mv")).otherwise(85.0).alias("value_mu"), F.when(F.col("nv") > 10, F.greatest("sv", F.lit(1e-3))).otherwise(6.0).alias("value_sd"),
        clip(40.0 / F.col("rate"), 120.0, 1800.0).alias("win"), *[f"p{i}" for i in range(6)],
    )
    return s.join(rho, "trace_id", "left").withColumn("value_rho", F.coalesce("value_rho", F.lit(0.0)))


def fit(trace: DataFrame) -> model.Profile:
    """The profile of one trace, for the driver; the default one below 50 reported events."""
    rows = statistics(trace).limit(2).collect()
    if len(rows) != 1 or rows[0]["n"] < 50:
        return model.DEFAULT_PROFILE
    r, m = rows[0], [[0.0] * 6 for _ in range(6)]
    for x in transitions(trace.where("chan = 0")).collect():  # 36 rows
        m[x["kind"]][x["next"]] = x["p"]
    names = ("rate", "active_frac", "ctrl_p", "size_mu", "size_sd", "net_mu", "value_mu", "value_sd", "win", "value_rho")
    return model.Profile(tuple(r[f"p{i}"] for i in range(6)), tuple(map(tuple, m)), **{n: float(r[n]) for n in names})


def scale_statistics(chunks: DataFrame) -> DataFrame:
    """One row of yardsticks: 99th percentiles of events per 10 s (empty bins up to a chunk's last event count) and of network sizes, the median positive gap, the rarest pair."""
    r = chunks.where("chan = 0")
    bins = r.groupBy("trace_id", F.floor(F.col("t") / 10).alias("bin")).agg(F.count("*").alias("n"))
    # Of all bins, most are empty: the percentile is taken over the counts of counts.
    all_ = bins.groupBy("trace_id").agg((F.max("bin") + 1 - F.count("*")).alias("empty")).agg(F.sum("empty").alias("empty"))
    sizes = bins.groupBy("n").agg(F.count("*").alias("m")).unionByName(all_.select(F.lit(0).cast("long").alias("n"), F.col("empty").alias("m"))).where("m > 0")
    burst = sizes.agg(F.percentile("n", F.lit(0.99), F.col("m")).alias("p99_burst"))
    net = r.agg(F.coalesce(F.percentile(F.when(F.col("kind") == model.NET, F.col("size")), 0.99), F.percentile("size", 0.99)).alias("p99_net"))
    w = Window.partitionBy("trace_id").orderBy(*ORDER)
    gap = r.withColumn("g", F.col("t") - F.lag("t").over(w)).where("g > 0").agg(F.coalesce(F.percentile("g", 0.5), F.lit(1.0)).alias("gap_med"))
    rare = transitions(r).where("kind <> next").agg(F.min(F.struct("p", "kind", "next")).alias("x")).select(F.col("x.p").alias("rare_p"), F.col("x.kind").alias("rare_a"), F.col("x.next").alias("rare_b"))
    return burst.crossJoin(net).crossJoin(gap).crossJoin(rare)  # one row each


def behaviour_shift(a: model.Profile, b: model.Profile) -> dict[str, float]:
    """How far two profiles lie apart, by part and on average."""

    def jsd(p, q):
        p, q = [x + 1e-12 for x in p], [x + 1e-12 for x in q]
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = lambda x: sum(u * math.log2(u / ((v + w) / 2)) for u, v, w in zip(x, p, q, strict=True))
        return (kl(p) + kl(q)) / 2

    ratio = lambda x, y, floor=1e-12: abs(math.log2(max(y, floor) / max(x, floor)))
    parts = {
        "mix": jsd(a.p_kind, b.p_kind),
        "sequence": sum(map(jsd, a.trans, b.trans)) / len(a.trans),
        "rate": min(1.0, ratio(a.rate, b.rate)),
        "size": min(1.0, abs(b.size_mu - a.size_mu) / (2 * max(a.size_sd, 1e-6))),
        "control": min(1.0, ratio(a.ctrl_p, b.ctrl_p, 1e-4) / 3),
    }
    return parts | {"shift": sum(parts.values()) / len(parts)}

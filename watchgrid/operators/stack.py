"""Calibrated alarms over detector scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchgrid.functions import scalars


def scores(series: DataFrame, traces: DataFrame, names) -> DataFrame:
    """(trace_id, lens, score): the highest of each series, 0 where there is none. traces has the ids; a table of nothing else is taken as it is."""
    lenses = F.broadcast(series.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("lens")))  # a handful
    ids = traces if traces.columns == ["trace_id"] else traces.select("trace_id").distinct()
    none = ids.crossJoin(lenses).select("trace_id", "lens", F.lit(0.0).alias("none"))
    both = series.select("trace_id", "lens", "score").unionByName(none, allowMissingColumns=True)  # a join would wait for both sides
    both = both.groupBy("trace_id", "lens").agg(F.max("score").alias("score"), F.max("none").alias("none")).where("none IS NOT NULL")
    return both.select("trace_id", "lens", F.coalesce("score", "none").alias("score"))


def calibrate(scores_: DataFrame, n_lenses: int, far: float = 0.05) -> DataFrame:
    """(lens, tau, med, scale): a clean trace exceeds some tau with probability of about far. One row per lens."""
    g = ranked(scores_, ["lens"], far / n_lenses)
    return g.select("lens", "tau", "med", F.greatest(F.col("tau") - F.col("med"), 0.1 * F.col("sd"), F.lit(1e-6)).alias("scale"))


def ranked(scores_: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, tau, med, sd): the score that at most `share` of a group's scores exceed (element ceil((1 - share) (n - 1)) in order), their median and deviation. Groups are sorted, not
    gathered: a sort spills where a group is large."""
    group = Window.partitionBy(*keys)
    s = scores_.withColumns({"_r": F.row_number().over(group.orderBy("score")) - 1, "_n": F.count("*").over(group) - 1})
    at = lambda place: F.max(F.when(F.col("_r") == place, F.col("score")))
    middle = F.col("_n") / 2
    return s.groupBy(*keys).agg(at(F.ceil(F.lit(1 - share) * F.col("_n"))).alias("tau"), ((at(F.floor(middle)) + at(F.ceil(middle))) / 2).alias("med"), F.stddev_pop("score").alias("sd"))


def alarms(series: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(trace_id, lens, ts, score) above the threshold."""
    return series.join(F.broadcast(thresholds), "lens").where("score > tau").select("trace_id", "lens", "ts", "score")  # one row per lens


def in_span(series: DataFrame, spans: DataFrame, win: float) -> DataFrame:
    """The part of series within a trace's span (start, end), a window longer."""
    return series.join(spans, "trace_id").where((F.col("ts") >= F.col("start")) & (F.col("ts") <= F.col("end") + win)).drop("start", "end")


def discount(hits: DataFrame, clean: DataFrame, win: float) -> DataFrame:
    """hits without those that have an alarm of the same lens and trace in `clean` within win: a range anti-join by buckets of the window."""
    near = clean.select("trace_id", "lens", F.col("ts").alias("_c"), F.explode(F.array(*[F.floor(F.col("ts") / win) + d for d in (-1, 0, 1)])).alias("_b"))
    h = hits.withColumn("_b", F.floor(F.col("ts") / win))
    return h.alias("h").join(near.alias("c"), (F.col("h.trace_id") == F.col("c.trace_id")) & (F.col("h.lens") == F.col("c.lens")) & (F.col("h._b") == F.col("c._b")) & (F.abs(F.col("h.ts") - F.col("c._c")) <= win), "left_anti").drop("_b")


def evaluate(series: DataFrame, traces: DataFrame, thresholds: DataFrame, names, spans: DataFrame | None = None, clean: DataFrame | None = None, win: float = 300.0) -> DataFrame:
    """One row per trace: detected, first (time of its first alarm), fired (lenses, sorted), n_fired.

    clean: alarms of the same traces without an attack; alarms near one of the same lens there don't count.
    """
    if spans is not None:
        series = in_span(series, spans, win)
    hits = alarms(series, thresholds)
    if clean is not None:
        hits = discount(hits, clean, win)
    g = hits.groupBy("trace_id").agg(F.min("ts").alias("first"), F.array_sort(F.collect_set("lens")).alias("fired"))
    out = traces.select("trace_id").distinct().join(g, "trace_id", "left").withColumn("fired", F.coalesce("fired", F.array().cast("array<string>")))
    return out.select("trace_id", F.col("first").isNotNull().alias("detected"), "first", "fired", F.size("fired").alias("n_fired"))


def margins(scores_: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(trace_id, lens, norm): 1 is at the threshold, between 0 and 20."""
    x = (F.col("score") - F.col("med")) / F.col("scale")
    return scores_.join(F.broadcast(thresholds), "lens").select("trace_id", "lens", F.greatest(F.lit(0.0), F.least(F.lit(20.0), x)).alias("norm"))


def false_alarm_rate(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(F.avg(F.col("detected").cast("double")).alias("rate"))


def split_chronological(traces: DataFrame, share: float = 0.6) -> DataFrame:
    """(trace_id, part): 'cal' for the first share of the traces by id, else 'val'. Ids alone are ordered; there is one per chunk."""
    ids = traces.select("trace_id").distinct()
    n = ids.withColumn("r", F.row_number().over(Window.orderBy("trace_id"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    return n.select("trace_id", F.when(F.col("r") <= F.floor(F.col("n") * share), "cal").otherwise("val").alias("part"))

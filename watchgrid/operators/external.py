"""Monitors from outside under attack: calibrated on early chunks, tried on later ones, and on the same later chunks with injected attacks of graded strength."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.functions import scalars
from watchgrid.model import Profile
from watchgrid.operators import attacks, detection, lenses, profile, stack
from watchgrid.sources import tables

#: A monitor maps traces to (trace_id, score): 0 and 1 are alarms as they are, other scores get a threshold. A trace without a row scores 0.
Monitor = Callable[[DataFrame], DataFrame]
STRENGTHS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
#: Later chunks, by smallest hash, that attacks are laid over.
BASES = 64


def lens_bundle(prof: Profile, names=lenses.DEFAULT, calibration: DataFrame | None = None, far: float = 0.05) -> Monitor:
    """The built-in detectors as one monitor: the highest margin over their thresholds, which come from the calibration traces."""
    own = tables.written(stack.calibrate(stack.scores(lenses.series(calibration, prof, names), calibration, names), len(names), far))

    def score(traces: DataFrame) -> DataFrame:
        margins = stack.margins(stack.scores(lenses.series(traces, prof, names), traces, names), own)
        return margins.groupBy("trace_id").agg(F.max("norm").alias("score"))

    return score


def scored(traces: DataFrame, monitors: dict[str, Monitor]) -> DataFrame:
    """(trace_id, monitor, score) of every monitor on every trace."""
    ids, out = traces.select("trace_id").distinct(), None
    for name, monitor in monitors.items():
        own = ids.join(monitor(traces), "trace_id", "left").select("trace_id", F.lit(name).alias("monitor"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
        out = own if out is None else out.unionByName(own)
    return out


def thresholds(scores: DataFrame, far: float = 0.05) -> DataFrame:
    """(monitor, threshold, numeric): half for monitors that only say 0 and 1, else the (1 - far) quantile of clean scores."""
    g = scores.groupBy("monitor").agg(F.max((~F.col("score").isin(0.0, 1.0)).cast("int")).alias("numeric"), F.collect_list("score").alias("s"))
    return g.select("monitor", F.when(F.col("numeric") == 1, scalars.quantile_higher(F.col("s"), 1 - far)).otherwise(0.5).alias("threshold"), (F.col("numeric") == 1).alias("numeric"))


def _alarms(scores: DataFrame, limits: DataFrame) -> DataFrame:
    return scores.join(F.broadcast(limits), "monitor").select("trace_id", "monitor", (F.col("score") > F.col("threshold")).cast("int").alias("alarm"))  # a row per monitor


@dataclass
class Audit:
    thresholds: DataFrame  # monitor, threshold, numeric
    clean: DataFrame  # item, monitor, detected: on later chunks without an attack
    items: DataFrame  # item, family, k, base, ...
    detections: DataFrame  # item, monitor, detected; null where the monitor alarms on the base chunk itself


def audit(chunks: DataFrame, monitors: dict[str, Monitor], prof: Profile, far: float = 0.05, bases: int = BASES, strengths=STRENGTHS, reps: int = 3, families=attacks.FAMILIES) -> Audit:
    """Calibrates on the first 60 % of the chunks, counts alarms on the later ones, and injects every family at every strength into up to `bases` of these."""
    parts = tables.written(stack.split_chronological(chunks))
    early, late = (tables.written(chunks.join(parts.where(F.col("part") == p), "trace_id", "left_semi")) for p in ("cal", "val"))
    limits = tables.written(thresholds(scored(early, monitors), far))
    clean = tables.written(_alarms(scored(late, monitors), limits))
    ids = [r["trace_id"] for r in late.select("trace_id").distinct().orderBy(F.xxhash64("trace_id"), "trace_id").limit(bases).collect()]
    items = tables.written(attacks.items_table(chunks.sparkSession, ids, (*families, *attacks.SHAPES), strengths, reps))
    stats = profile.scale_statistics(early).first().asDict()
    end = float(late.agg(F.max("t")).first()[0])
    traces = tables.written(attacks.overlaid(late.where(F.col("trace_id").isin(ids)), items, attacks.scaled_events(items, stats, prof.p_kind, end)))
    found = _alarms(scored(traces, monitors), limits).withColumnRenamed("trace_id", "item")
    noisy = clean.where("alarm = 1").select(F.col("trace_id").alias("base"), "monitor", F.lit(True).alias("noisy"))
    found = found.join(items.select("item", "base"), "item").join(noisy, ["base", "monitor"], "left")
    found = tables.written(found.select("item", "monitor", F.when(F.col("noisy").isNull(), F.col("alarm")).alias("detected")))
    return Audit(limits, clean.select(F.col("trace_id").alias("item"), "monitor", F.col("alarm").alias("detected")), items, found)


def of_lenses(chunks: DataFrame, prof: Profile, names, far: float = 0.05, bases: int = BASES, strengths=STRENGTHS, reps: int = 3) -> tuple[Audit, Callable | None, DataFrame]:
    """The same for the built-in detectors, each a monitor of its own: an attack counts where a detector has an alarm within its span that the clean chunk does not have. Attacks go
    into later chunks without any alarm. Also a judge for attacks.hidden, or None below four such chunks, and the evaluated later chunks."""
    parts = tables.written(stack.split_chronological(chunks))
    s = tables.written(stack.scores(lenses.series(chunks, prof, names), chunks, names).join(parts, "trace_id"))
    limits = tables.written(stack.calibrate(s.where("part = 'cal'"), len(names), far))
    late = tables.written(chunks.join(parts.where("part = 'val'"), "trace_id", "left_semi"))
    told = tables.written(stack.evaluate(lenses.series(late, prof, names), late, limits, names))
    each = F.explode(F.array(*[F.lit(n) for n in names]))
    clean = told.select(F.col("trace_id").alias("item"), "fired", each.alias("monitor")).select("item", "monitor", F.array_contains("fired", F.col("monitor")).cast("int").alias("detected"))
    ids = [r["trace_id"] for r in told.where("NOT detected").orderBy(F.xxhash64("trace_id"), "trace_id").limit(bases).select("trace_id").collect()]
    early = chunks.join(parts.where("part = 'cal'"), "trace_id", "left_semi")
    if not ids:  # every later chunk raises an alarm: nothing can be tried
        spark = chunks.sparkSession
        return Audit(limits, clean, spark.createDataFrame([], "item long, family string, k double"), spark.createDataFrame([], "item long, monitor string, detected int")), None, told
    stats = profile.scale_statistics(early).first().asDict()
    items = tables.written(attacks.items_table(chunks.sparkSession, ids, (*attacks.FAMILIES, *attacks.SHAPES), strengths, reps))
    found = tables.written(attacks.injected(late, prof, names, items, limits, stats, prof.p_kind))
    detections = found.select("item", "fired", each.alias("monitor")).select("item", "monitor", F.array_contains("fired", F.col("monitor")).cast("int").alias("detected"))
    judge = attacks.black_box(late, prof, names, ids, limits, stats, prof.p_kind) if len(ids) >= 4 else None
    return Audit(limits.select("lens", "tau", "med", "scale"), clean, items, tables.written(detections)), judge, told


def sensitivity(a: Audit, least: float = 0.8) -> DataFrame:
    """(monitor, family, n, caught, k80): attacks tried and caught, and the smallest strength that is caught in `least` of the runs, null if none is."""
    seen = a.detections.where("detected IS NOT NULL").join(a.items.select("item", "family", "k"), "item")
    at = seen.groupBy("monitor", "family", "k").agg(F.avg("detected").alias("rate"), F.count("*").alias("n"), F.sum("detected").cast("long").alias("caught"))
    return at.groupBy("monitor", "family").agg(F.sum("n").alias("n"), F.sum("caught").alias("caught"), F.min(F.when(F.col("rate") >= least, F.col("k"))).alias("k80"))


def overlap(a: Audit) -> dict:
    """What the monitors catch together: attacks that all could judge, effective number of monitors, share caught by exactly one and by none, and their redundancy without near-copies."""
    table = a.detections
    sets = {frozenset(r["fired"]): r["n"] for r in detection.evaluable(table).groupBy("fired").agg(F.count("*").alias("n")).collect()}  # at most 2^M rows
    total, caught = sum(sets.values()), sum(n for f, n in sets.items() if f)
    rep, copies = detection.independent(table)
    fired = detection.Fired.of(detection.represented(table, rep) if rep else table, sorted(set(rep.values())))
    return {
        "attacks": total, "caught_by_none": 1 - caught / total if total else None, "caught_by_exactly_one": sum(n for f, n in sets.items() if len(f) == 1) / caught if caught else None,
        "effective_monitors": detection.effective_rank(table.where("detected IS NOT NULL").withColumn("detected", F.col("detected").cast("double")), "item", "monitor", "detected").first()[0],
        "near_copies": copies, "groups": fired.groups(), "order": fired.order(), "plateau": fired.plateau(), "without_one": fired.without_one(),
        "failure_correlation": detection.failure_correlation(table).first()[0], "obstruction": detection.obstruction_rate(table).first()[0],
    }

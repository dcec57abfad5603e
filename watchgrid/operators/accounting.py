"""Accounting of self-updates: is every state declared, seen and reviewed in time?

Records are rows (type, t, artifact, old, new, hash, result, ord, seq); ord and seq break ties of time. What needs other records (is a snapshot's state declared within tol, when
was the last change, which review is whose) comes from windows; the known and previous state of an artifact is a fold with constant memory over sorted partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchgrid.functions import scalars
from watchgrid.sources import tables

FINDINGS = ("BROKEN_CHAIN", "PHANTOM_CHANGE", "UNEXPLAINED_CHANGE", "UNKNOWN_REVIEW", "FAILED_REVIEW_STILL_LIVE", "UNREVIEWED_PAST_SLA")
_ORDER = ("t", "ord", "seq")


def step(kind: str, known, prev, old, new, seen, declared: bool, lagging: bool):
    """One record of an artifact: (finding or None, known, prev) after it. declared: a change to the seen state is logged within tol after; lagging: a change was within tol before."""
    if kind == "change":
        return ("BROKEN_CHAIN" if known is not None and old != known else None), new, known
    if kind != "snapshot" or seen == known:
        return None, known, prev
    if known is None:
        return None, seen, prev
    if declared:
        return None, known, prev
    if prev is not None and seen == prev:
        return (None, known, prev) if lagging else ("PHANTOM_CHANGE", seen, known)
    return "UNEXPLAINED_CHANGE", seen, known


def _with_ties(records: DataFrame) -> DataFrame:
    if "ord" not in records.columns:
        records = records.withColumn("ord", F.expr("CASE type WHEN 'change' THEN 0 WHEN 'review' THEN 1 ELSE 2 END"))
    return records if "seq" in records.columns else records.withColumn("seq", F.monotonically_increasing_id())


def states(records: DataFrame, tol: float = 60.0) -> DataFrame:
    """Changes and snapshots with known (the state after them) and finding."""
    r = _with_ties(records).where("type IN ('change', 'snapshot')").withColumn("state", F.coalesce("new", "hash"))
    r = r.withColumn("_c", F.when(F.col("type") == "change", F.col("t")))
    ahead = F.expr(f"min(_c) OVER (PARTITION BY artifact, state ORDER BY t RANGE BETWEEN CURRENT ROW AND {float(tol)!r}D FOLLOWING)")
    behind = Window.partitionBy("artifact").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("declared", ahead.isNotNull()).withColumn("lagging", F.coalesce(F.col("t") - F.max("_c").over(behind) <= tol, F.lit(False)))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        artifact = known = prev = None
        for pdf in batches:
            found, after = [], []
            for a, kind, old, new, seen, declared, lagging in zip(pdf["artifact"], pdf["type"], pdf["old"], pdf["new"], pdf["hash"], pdf["declared"], pdf["lagging"], strict=True):
                if a != artifact:
                    artifact, known, prev = a, None, None
                f, known, prev = step(kind, known, prev, old, new, seen, declared, lagging)
                found.append(f)
                after.append(known)
            yield pdf[["type", "t", "artifact", "new", "ord", "seq"]].assign(known=after, finding=found)

    r = r.select("artifact", *_ORDER, "type", "old", "new", "hash", "declared", "lagging")
    n = int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"type string, t double, artifact string, new string, ord int, seq {r.schema['seq'].dataType.simpleString()}, known string, finding string"
    return r.repartition(n, "artifact").sortWithinPartitions("artifact", *_ORDER).mapInPandas(fold, schema)


def reviewed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes with the review that each gets, first in first out per (artifact, new); and the reviews that find no change.

    With S the running sum of +1 for a change and -1 for a review, a review finds nothing exactly where the running minimum of S (and 0) drops; the others match by ordinal.
    """
    r = _with_ties(records).where("type IN ('change', 'review')").withColumn("d", F.when(F.col("type") == "change", 1).otherwise(-1))
    w = Window.partitionBy("artifact", "new").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("s", F.sum("d").over(w)).withColumn("low", F.least(F.min("s").over(w), F.lit(0)))
    before = F.coalesce(F.lag("low").over(Window.partitionBy("artifact", "new").orderBy(*_ORDER)), F.lit(0))
    r = r.withColumn("lost", (F.col("type") == "review") & (F.col("low") < before))
    kept = r.where("NOT lost").withColumn("j", F.row_number().over(Window.partitionBy("artifact", "new", "type").orderBy(*_ORDER)))
    changes = kept.where("type = 'change'").select("artifact", "new", "t", "j", "seq")
    reviews = kept.where("type = 'review'").select("artifact", "new", "j", F.col("t").alias("review_t"), F.coalesce("result", F.lit("pass")).alias("result"))
    # Nulls as `new` never match: such changes stay unreviewed.
    return changes.join(reviews, ["artifact", "new", "j"], "left"), r.where("lost").select("artifact", "t", "new")


def reconcile(records: DataFrame, sla_hours: float = 24.0, tol: float = 60.0, end_t: float | None = None, changes: DataFrame | None = None) -> DataFrame:
    """Findings: (kind, artifact, t, state). changes: the first result of reviewed, where it is a table already."""
    s = tables.written(states(records, tol))  # read for its findings and its final states
    matched, unknown = reviewed(records)
    changes = tables.written(matched) if changes is None else changes
    own = s.where("finding IS NOT NULL").select(F.col("finding").alias("kind"), "artifact", "t", F.coalesce("new", "known").alias("state"))
    lost = unknown.select(F.lit("UNKNOWN_REVIEW").alias("kind"), "artifact", "t", F.col("new").alias("state"))
    final = s.groupBy("artifact").agg(F.max_by("known", F.struct(*_ORDER)).alias("final"))
    live = changes.where("result = 'fail'").join(final, "artifact").where(F.col("final") == F.col("new"))
    live = live.select(F.lit("FAILED_REVIEW_STILL_LIVE").alias("kind"), "artifact", F.col("review_t").alias("t"), F.col("new").alias("state"))
    horizon = records.agg(F.lit(end_t).cast("double").alias("h") if end_t is not None else F.max("t").alias("h"))
    late = changes.crossJoin(F.broadcast(horizon)).where(F.coalesce("review_t", "h") - F.col("t") > sla_hours * 3600)  # one row
    late = late.select(F.lit("UNREVIEWED_PAST_SLA").alias("kind"), "artifact", "t", F.col("new").alias("state"))
    return own.unionByName(lost).unionByName(live).unionByName(late)


def _backlog(changes: DataFrame, g: DataFrame) -> DataFrame:
    """(i, at, step, b): the backlog on a grid of at most 200 points, from one row with n, t0, t1 and h. Events are counted into the grid's steps, then summed up along it."""
    grid = g.select("n", "t0", F.greatest(F.greatest("h", "t1") - F.col("t0"), F.lit(1e-9)).alias("len"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    grid = grid.select("i", (F.col("t0") + F.col("len") * F.col("i") / (F.col("n") - 1)).alias("at"), (F.col("len") / (F.col("n") - 1) / 86400).alias("step"))
    d = changes.select(F.col("t").alias("at"), F.lit(1).alias("d")).unionByName(changes.where("review_t IS NOT NULL").select(F.col("review_t").alias("at"), F.lit(-1).alias("d")))
    cell = d.crossJoin(F.broadcast(g.select("t0", "n", F.greatest(F.greatest("h", "t1") - F.col("t0"), F.lit(1e-9)).alias("len"))))  # one row
    cell = cell.withColumn("i", F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("t0")) * (F.col("n") - 1) / F.col("len"))).cast("int")).groupBy("i").agg(F.sum("d").alias("d"))
    return grid.join(F.broadcast(cell), "i", "left").withColumn("b", F.sum(F.coalesce("d", F.lit(0))).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))


def pacing(records: DataFrame, sla_hours: float = 24.0, end_t: float | None = None, changes: DataFrame | None = None) -> DataFrame:
    """One row: rates a day, backlog now and at its peak on a grid, its slope a day, lags of reviews. Rates and the slope are null below two days of history. changes: as for reconcile."""
    changes = tables.written(reviewed(records)[0]) if changes is None else changes  # read for the rates and for the grid
    horizon = records.agg(F.lit(end_t).cast("double").alias("h") if end_t is not None else F.max("t").alias("h"))
    lag = F.col("review_t") - F.col("t")
    g = changes.agg(
        F.count("*").alias("changes"), F.count("review_t").alias("reviewed"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.percentile(lag, 0.5).alias("lag_p50"), F.percentile(lag, 0.95).alias("lag_p95"),
        F.avg(F.when(F.col("review_t").isNotNull(), (lag <= sla_hours * 3600).cast("double"))).alias("within"),
    ).crossJoin(horizon)
    g = g.withColumn("days", F.greatest((F.col("h") - F.col("t0")) / 86400, F.lit(1e-9))).withColumn("n", F.greatest(F.lit(20), F.least(F.lit(200), F.floor(F.col("days") * 2))).cast("int"))
    run = _backlog(changes, g)
    trend = run.agg(F.max("b").alias("peak_backlog"), (F.regr_slope("b", "i") / F.first("step")).alias("growth_per_day"))
    enough = F.col("days") >= 2
    out = g.crossJoin(trend)
    return out.select(
        "changes", "reviewed", (F.col("changes") - F.col("reviewed")).alias("unreviewed_now"), F.col("days").alias("span_days"), F.when(enough, F.col("changes") / F.col("days")).alias("changes_per_day"),
        F.when(enough, F.col("reviewed") / F.col("days")).alias("reviews_per_day"), F.when(enough, F.col("peak_backlog")).alias("peak_backlog"), F.when(enough, F.col("growth_per_day")).alias("growth_per_day"),
        (F.col("lag_p50") / 3600).alias("lag_median_h"), (F.col("lag_p95") / 3600).alias("lag_p95_h"), F.coalesce("within", F.lit(0.0)).alias("within_sla"),
    )


def assessed(records: DataFrame, sla_hours: float = 24.0, end_t: float | None = None, seed: int = 0, changes: DataFrame | None = None) -> dict:
    """The row of pacing, the 95 % interval of the backlog's growth a day (growth_low, growth_high), and falling_behind: whether all of it is above 0. Below two days of history nothing
    is known of a trend: the interval is null, and falling_behind as well. changes: as for reconcile."""
    changes = tables.written(reviewed(records)[0]) if changes is None else changes
    row = pacing(records, sla_hours, end_t, changes).first().asDict()
    if row["growth_per_day"] is None:
        return {**row, "growth_low": None, "growth_high": None, "falling_behind": None}
    horizon = records.agg(F.lit(end_t).cast("double").alias("h") if end_t is not None else F.max("t").alias("h"))
    g = changes.agg(F.min("t").alias("t0"), F.max("t").alias("t1")).crossJoin(horizon)  # one row each
    g = g.withColumn("n", F.greatest(F.lit(20), F.least(F.lit(200), F.floor((F.col("h") - F.col("t0")) / 43200))).cast("int"))
    points = _backlog(changes, g).orderBy("i").collect()  # at most 200
    low, high = (x / points[0]["step"] for x in slope_interval([float(r["b"]) for r in points], seed))
    return {**row, "growth_low": low, "growth_high": high, "falling_behind": low > 0}


def slope_interval(backlog: list[float], seed: int = 0, rounds: int = 300) -> tuple[float, float]:
    """95 % interval of a short series' slope per step, by a moving-block bootstrap; infinite below 8 points."""
    y = np.asarray(backlog, dtype=float)
    n = len(y)
    if n < 8:
        return -np.inf, np.inf
    rng, block = np.random.default_rng(seed), max(2, n // 8)
    starts = rng.integers(0, n - block + 1, (rounds, -(-n // block)))
    at = (starts[:, :, None] + np.arange(block)).reshape(rounds, -1)[:, :n]
    x, v = at - at.mean(axis=1, keepdims=True), y[at]
    slopes = (x * (v - v.mean(axis=1, keepdims=True))).sum(axis=1) / np.maximum((x * x).sum(axis=1), 1e-12)
    return float(np.percentile(slopes, 2.5)), float(np.percentile(slopes, 97.5))


def simulated(spark: SparkSession, days: float = 30.0, changes_per_day: float = 4.0, reviews_per_day: float = 6.0, artifacts: int = 5, seed: int = 0) -> DataFrame:
    """Change, snapshot and review records of a process with one reviewer: gaps and review times are exponential, and the j-th review ends at max over i <= j of the i-th change's time plus
    the work from i to j, which is a running maximum of prefix differences."""
    n = int(days * changes_per_day)
    gap = -F.log(F.greatest(scalars.uniform(F.col("id"), seed, "gap"), F.lit(1e-12))) * 86400 / changes_per_day
    work = -F.log(F.greatest(scalars.uniform(F.col("id"), seed, "work"), F.lit(1e-12))) * 86400 / reviews_per_day
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    c = spark.range(n).select("id", gap.alias("gap"), work.alias("work")).withColumn("t", F.sum("gap").over(w)).withColumn("done", F.sum("work").over(w))
    c = c.withColumn("review_t", F.col("done") + F.max(F.col("t") - F.col("done") + F.col("work")).over(w)).where(F.col("t") <= days * 86400)
    c = c.withColumn("artifact", F.concat(F.lit("artifact"), (F.col("id") % artifacts).cast("string"))).withColumn("new", F.concat(F.lit("h"), F.col("id").cast("string")))
    old = F.lag("new").over(Window.partitionBy("artifact").orderBy("id"))
    c = c.withColumn("old", old)
    none = F.lit(None).cast("string")
    change = c.select(F.lit("change").alias("type"), "t", "artifact", "old", "new", none.alias("hash"), none.alias("result"), F.lit(0).alias("ord"), F.col("id").alias("seq"))
    snap = c.select(F.lit("snapshot").alias("type"), (F.col("t") + 30).alias("t"), "artifact", none.alias("old"), none.alias("new"), F.col("new").alias("hash"), none.alias("result"), F.lit(2).alias("ord"), F.col("id").alias("seq"))
    review = c.where(F.col("review_t") <= days * 86400).select(F.lit("review").alias("type"), F.col("review_t").alias("t"), "artifact", none.alias("old"), "new", none.alias("hash"), F.lit("pass").alias("result"), F.lit(1).alias("ord"), F.col("id").alias("seq"))
    return change.unionByName(snap).unionByName(review)


# ---------------------------------------------------------------------- ledgers

ZERO = "0" * 64


def chained(records: DataFrame, order: list[str], text: str) -> DataFrame:
    """records with n (from 0) and hash: sha256 of the hash before and the text. A chain is sequential by nature: one task streams over the sorted records and holds one hash."""
    import hashlib

    columns = records.columns

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, n = ZERO, 0
        for pdf in batches:
            out = []
            for s in pdf[text]:
                before = hashlib.sha256((before + s).encode()).hexdigest()
                out.append(before)
            yield pdf[columns].assign(n=range(n, n + len(out)), hash=out)
            n += len(out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
    return records.repartitionByRange(1, *order).sortWithinPartitions(*order).mapInPandas(chain, f"{fields}, n long, hash string")


def broken_links(ledger: DataFrame, text: str, span: int = 100_000) -> DataFrame:
    """Rows (n, ...) whose hash is not that of the hash before and their text. Checked in parallel: spans of rows, each with the last row of the span before."""
    rows = ledger.select("n", "hash", F.col(text).alias("text"))
    both = rows.withColumn("part", F.floor(F.col("n") / span)).withColumn("own", F.lit(True)).unionByName(rows.where((F.col("n") + 1) % span == 0).withColumn("part", F.floor(F.col("n") / span) + 1).withColumn("own", F.lit(False)))
    w = Window.partitionBy("part").orderBy("n")
    before = F.coalesce(F.lag("hash").over(w), F.lit(ZERO))
    return both.withColumn("want", F.sha2(F.concat(before, F.col("text")), 256)).where("own AND want <> hash").select("n", "hash", "want")


def merkle_root(records: DataFrame, order: list[str], text: str) -> str:
    """Root of the hash tree over the texts in order; an odd node is paired with itself. Halves the rows each round; the last LEAVES hashes meet on the driver."""
    import hashlib

    ranked = chained_index(records, order).select("n", F.sha2(text, 256).alias("h"))
    total = ranked.count()
    if not total:
        return hashlib.sha256(b"").hexdigest()
    while total > 1024:
        g = ranked.groupBy(F.floor(F.col("n") / 2).alias("n")).agg(F.min_by("h", "n").alias("a"), F.max_by("h", "n").alias("b"))
        ranked, total = g.select("n", F.sha2(F.concat("a", "b"), 256).alias("h")), -(-total // 2)
    level = [r["h"] for r in ranked.orderBy("n").collect()]
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0]


def chained_index(records: DataFrame, order: list[str]) -> DataFrame:
    """records with n, their place in the order: ranks in range partitions, plus the sizes of those before (one number per partition comes together)."""
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = records.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    r = tables.written(r.withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))))  # one partitioning for both uses
    sizes = r.groupBy("_p").agg(F.count("*").alias("_c"))
    sizes = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return r.join(F.broadcast(sizes.select("_p", "_o")), "_p").withColumn("n", F.col("_o") + F.col("_i")).drop("_id", "_p", "_i", "_o")


def state_hash(files: DataFrame, by: list[str], name: str, blob: str) -> DataFrame:
    """(by, state): 16 hex digits of the hash over a group's sorted names and blobs; 'absent' for groups whose blobs are all null."""
    g = files.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col(blob).isNotNull(), F.struct(name, blob)))).alias("f"))
    joined = F.array_join(F.transform("f", lambda x: F.concat(x[name].cast("string"), F.lit(":"), x[blob].cast("string"))), ";")
    return g.select(*by, F.when(F.size("f") == 0, "absent").otherwise(F.substring(F.sha2(joined, 256), 1, 16)).alias("state"))

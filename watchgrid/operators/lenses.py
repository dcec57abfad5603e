"""Detectors: each maps trace events to a series (trace_id, ts, score), higher being odder. A trace without rows in a series scores 0."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchgrid import model
from watchgrid.model import Profile
from watchgrid.operators import rewrites
from watchgrid.sources import tables

LENSES: dict[str, Callable[[DataFrame, Profile], DataFrame]] = {}
ORDER = ["t", "seq"]


def lens(name: str):
    def add(f):
        LENSES[name] = f
        return f

    return add


def _reported(trace: DataFrame) -> DataFrame:
    return trace.where("chan = 0")


def _bin(width: float) -> Column:
    return F.floor(F.col("t") / width)


def _series(df: DataFrame, ts, score: Column) -> DataFrame:
    return df.select("trace_id", (ts if isinstance(ts, Column) else F.col(ts)).cast("double").alias("ts"), score.cast("double").alias("score"))


def _binned(df: DataFrame, width: float, value: Column | None = None) -> DataFrame:
    """Counts, or sums of a value, per bin; stamped with the bin's end."""
    g = df.groupBy("trace_id", _bin(width).alias("bin")).agg((F.count("*") if value is None else F.sum(value)).alias("x"))
    return _series(g, (F.col("bin") + 1) * width, F.col("x"))


@lens("burst")
def burst(trace: DataFrame, prof: Profile) -> DataFrame:
    """Events in 10 s."""
    return _binned(_reported(trace), 10.0)


@lens("sweep")
def sweep(trace: DataFrame, prof: Profile) -> DataFrame:
    """Distinct targets in a window of at least 10 events."""
    g = _reported(trace).groupBy("trace_id", _bin(prof.win).alias("bin")).agg(F.count("*").alias("n"), F.max("t").alias("ts"), F.count_distinct("target").alias("x"))
    return _series(g.where("n >= 10"), "ts", F.col("x"))


@lens("ctrl")
def ctrl(trace: DataFrame, prof: Profile) -> DataFrame:
    """Writes to control files in a window."""
    return _binned(_reported(trace).where((F.col("kind") == model.WRITE) & (F.col("target") < model.N_CONTROL)), prof.win)


@lens("netvol")
def netvol(trace: DataFrame, prof: Profile) -> DataFrame:
    """Bytes of network events in a window."""
    return _binned(_reported(trace).where(F.col("kind") == model.NET), prof.win, F.col("size"))


COUNTED = {"sweep": sweep, "ctrl": ctrl, "netvol": netvol}


def _counts(trace: DataFrame, prof: Profile, names) -> DataFrame:
    """(trace_id, lens, ts, score) of several detectors of COUNTED, by one reading: first by target, then by window."""
    return _counted(_per_window(_per_target(_reported(trace), prof, "trace_id"), "trace_id"), prof, names)


def _per_target(reported: DataFrame, prof: Profile, *keys: str) -> DataFrame:
    control, net = (F.col("kind") == model.WRITE) & (F.col("target") < model.N_CONTROL), F.col("kind") == model.NET
    first = [F.count("*").alias("n"), F.max("t").alias("ts"), F.count_if(control).alias("ctrl"), F.count_if(net).alias("nets"), F.sum(F.when(net, F.col("size"))).alias("netvol")]
    return reported.groupBy(*keys, _bin(prof.win).alias("bin"), "target").agg(*first)


def _per_window(g: DataFrame, *keys: str, target: str = "target") -> DataFrame:
    """Of rows per target, those per window: sweep is the number of targets in the column `target`."""
    return g.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.max("ts").alias("ts"), F.count(target).alias("sweep"), *[F.sum(c).alias(c) for c in ("ctrl", "nets", "netvol")])


def _counted(g: DataFrame, prof: Profile, names) -> DataFrame:
    """(trace_id, lens, ts, score) of rows per window."""
    end = (F.col("bin") + 1) * prof.win
    holds = {"sweep": (F.col("n") >= 10, F.col("ts")), "ctrl": (F.col("ctrl") > 0, end), "netvol": (F.col("nets") > 0, end)}
    each = [F.struct(F.lit(n).alias("lens"), holds[n][1].cast("double").alias("ts"), F.col(n).cast("double").alias("score"), holds[n][0].alias("holds")) for n in names]
    return g.select("trace_id", F.explode(F.array(*each)).alias("e")).where("e.holds").select("trace_id", "e.lens", "e.ts", "e.score")


def _within(trace: DataFrame, width: float) -> tuple[DataFrame, Window]:
    df = _reported(trace).withColumn("bin", _bin(width))
    return df, Window.partitionBy("trace_id", "bin").orderBy(*ORDER)


def _steps(trace: DataFrame, prof: Profile) -> DataFrame:
    """Of windows of at least 15 events, by one sort: the gaps' deviation and mean, and the mean surprise of what follows what."""
    df, w = _within(trace, prof.win)
    surprise = F.array(*[F.lit(-math.log(p)) for row in prof.trans for p in row])
    # Nulls are cut off before the look-up: in an aggregate, Spark 4.1 reads element_at of a literal array at a null index as a value.
    step = F.when(F.col("next").isNotNull(), F.element_at(surprise, F.coalesce(F.col("kind") * 6 + F.col("next"), F.lit(0)) + 1))
    df = df.withColumns({"gap": F.col("t") - F.lag("t").over(w), "next": F.lead("kind").over(w)}).withColumn("s", step)
    g = df.groupBy("trace_id", "bin").agg(F.count("*").alias("n"), F.max("t").alias("ts"), F.stddev_pop("gap").alias("sd"), F.avg("gap").alias("m"), F.avg("s").alias("x"))
    return g.where("n >= 15").withColumn("regular", 1.0 / (F.col("sd") / (F.col("m") + 1e-9) + 0.05))


@lens("rhythm")
def rhythm(trace: DataFrame, prof: Profile) -> DataFrame:
    """Regularity of the gaps in a window of at least 15 events."""
    return _series(_steps(trace, prof), "ts", F.col("regular"))


@lens("surprisal")
def surprisal(trace: DataFrame, prof: Profile) -> DataFrame:
    """Mean surprise of what follows what in a window of at least 15 events."""
    return _series(_steps(trace, prof), "ts", F.col("x"))


@lens("coupling")
def coupling(trace: DataFrame, prof: Profile) -> DataFrame:
    """Largest correlation, over lags of 0 to 2 bins of 5 s, of reads with network events after them in a window of at least 20 events.

    The correlation over all bins comes from sums over the bins that hold something; empty ones are never made.
    """
    df = _reported(trace).withColumn("bin", _bin(prof.win))
    edges = df.groupBy("trace_id", "bin").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("ts")).where("n >= 20")
    edges = edges.withColumn("edges", F.ceil((F.col("ts") + 5.0 - F.col("t0")) / 5.0))
    # Of the events, those that count; a slot is a bin of 5 s from the window's first event.
    x = df.where(F.col("kind").isin(model.READ, model.NET)).join(edges, ["trace_id", "bin"])
    slot = F.least(F.floor((F.col("t") - F.col("t0")) / 5.0), F.col("edges") - 2)
    slots = x.withColumn("slot", slot).groupBy("trace_id", "bin", "edges", "slot").agg(F.sum((F.col("kind") == model.READ).cast("double")).alias("a"), F.sum((F.col("kind") == model.NET).cast("double")).alias("b"))
    # For lag l, reads of slot p meet network events of slot p + l.
    lags = slots.withColumn("lag", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    reads = lags.where("slot < edges - 1 - lag").select("trace_id", "bin", "edges", "lag", F.col("slot").alias("p"), "a", F.lit(0.0).alias("b"))
    sends = lags.where("slot >= lag").select("trace_id", "bin", "edges", "lag", (F.col("slot") - F.col("lag")).alias("p"), F.lit(0.0).alias("a"), "b")
    met = reads.unionByName(sends).groupBy("trace_id", "bin", "edges", "lag", "p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    s = met.groupBy("trace_id", "bin", "edges", "lag").agg(*[F.sum(c).alias(n) for n, c in (("sa", F.col("a")), ("sb", F.col("b")), ("saa", F.col("a") ** 2), ("sbb", F.col("b") ** 2), ("sab", F.col("a") * F.col("b")))])
    m = F.col("edges") - 1 - F.col("lag")
    va, vb = m * F.col("saa") - F.col("sa") ** 2, m * F.col("sbb") - F.col("sb") ** 2
    s = s.withColumn("r", F.when((va > 0) & (vb > 0), F.abs(m * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb)))
    best = s.groupBy("trace_id", "bin").agg(F.max("r").alias("r"), F.max(F.when(F.col("lag") == 0, F.col("sb"))).alias("sends"))
    g = edges.join(best, ["trace_id", "bin"], "left")
    return _series(g, "ts", F.when((F.col("edges") >= 8) & (F.col("sends") >= 3), F.coalesce("r", F.lit(0.0))).otherwise(0.0))


@lens("clock")
def clock(trace: DataFrame, prof: Profile) -> DataFrame:
    """How well the last 64 actions compress, every 16 actions: repetition counted in actions, whatever their pace."""
    sym = (F.col("kind").cast("long") * 4099 + (F.col("target") % 251) * 17 + F.least(F.log2(F.abs("size") + 1), F.lit(30.0)).cast("long")) % 65521
    blocks = rewrites.hop_blocks(_reported(trace).withColumn("sym", sym), ["trace_id"], ORDER, 64, 16)
    g = blocks.groupBy("trace_id", "block").agg(F.max("t").alias("ts"), F.transform(F.array_sort(F.collect_list(F.struct("i", "sym"))), lambda x: x["sym"].cast("int")).alias("syms"))

    def ratio(s: pd.Series) -> pd.Series:
        return s.map(lambda x: 1.0 - len(zlib.compress(x.astype("<u2").tobytes(), 6)) / (2 * len(x) + 11.0))

    return _series(g, "ts", F.pandas_udf(ratio, "double")("syms"))


def digit_statistics(trace: DataFrame) -> DataFrame:
    """For blocks of 60 reported numbers, one every 30: ts, variance, and chi-squared of the last digit (of one decimal) in bases 10, 7 and 12."""
    values = _reported(trace).where("value IS NOT NULL AND NOT isnan(value)")
    rows = rewrites.hop_blocks(values, ["trace_id"], ORDER, 60, 30).withColumn("c", F.bround(F.col("value") * 10).cast("long"))
    basic = rows.groupBy("trace_id", "block").agg(F.max("t").alias("ts"), F.var_pop("value").alias("var"))
    digits = rows.withColumn("base", F.explode(F.array(F.lit(10), F.lit(7), F.lit(12)))).groupBy("trace_id", "block", "base", F.pmod("c", "base").alias("d")).agg(F.count("*").alias("n"))
    # Sum over digits of (n - e)^2 / e is sum(n^2) / e - 60 with e = 60 / base.
    chi = digits.groupBy("trace_id", "block").pivot("base", [10, 7, 12]).agg(F.sum(F.col("n") * F.col("n")).cast("double"))
    return basic.join(chi, ["trace_id", "block"]).select("trace_id", "block", "ts", "var", *[(F.col(str(b)) * b / 60.0 - 60.0).alias(f"chi{b}") for b in (10, 7, 12)])


def chi2_tail(x: float, df: int) -> float:
    """Survival function of the chi-squared distribution in closed form."""
    h = x / 2
    if df % 2 == 0:
        term = total = 1.0
        for i in range(1, df // 2):
            term *= h / i
            total += term
        return math.exp(-h) * total
    total, term = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for i in range(df // 2):
        total += term
        term *= h / (i + 1.5)
    return total


@lens("digits")
def digits(trace: DataFrame, prof: Profile) -> DataFrame:
    """Oddness of last digits in several bases, or of too little variance, of reported numbers."""

    def score(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        tails = [min(chi2_tail(x, 9), chi2_tail(y, 6), chi2_tail(z, 11)) for x, y, z in zip(a, b, c, strict=True)]
        return pd.Series([-math.log10(max(min(p, 1.0), 1e-300)) for p in tails])

    s = digit_statistics(trace)
    even = F.log10(F.lit(prof.value_sd**2) / (F.col("var") + 1e-6))
    return _series(s, "ts", F.greatest(F.pandas_udf(score, "double")("chi10", "chi7", "chi12"), even))


def unbalanced(trace: DataFrame, tol: float = 2.0) -> DataFrame:
    """Events of either channel without one of the same kind in the other within tol seconds; nothing for traces without an independent record."""
    odd = rewrites.unmatched(trace, ["trace_id", "kind"], "t", "chan", tol)
    # Counted beforehand: a join whose kind is settled while other stages run makes adaptive execution start those stages again.
    return odd.join(tables.small(trace.where("chan = 1").select("trace_id").distinct()), "trace_id", "left_semi")


@lens("books")
def books(trace: DataFrame, prof: Profile) -> DataFrame:
    """Events that only one of the two records has, in a window."""
    return _binned(unbalanced(trace), prof.win)


def _token() -> Column:
    """An event's code in the templates: its kind, and one for writes to control files."""
    return F.when((F.col("kind") == model.WRITE) & (F.col("target") < model.N_CONTROL), 6).otherwise(F.col("kind"))


def _drifts(trace: DataFrame, templates) -> DataFrame:
    """(trace_id, lens, ts, score) of several templates, by one sort."""
    ends = rewrites.chains(_reported(trace), ["trace_id"], ORDER, _token(), {n: [model.TOKENS[x] for x in model.TEMPLATES[n]] for n in templates}, "t")
    score = F.greatest(F.lit(0.0), F.log(3600.0 / (F.col("end") - F.col("t") + 1.0)))
    return ends.select("trace_id", F.col("name").alias("lens"), F.col("end").cast("double").alias("ts"), score.cast("double").alias("score"))


def drift(template: str) -> Callable[[DataFrame, Profile], DataFrame]:
    def f(trace: DataFrame, prof: Profile) -> DataFrame:
        """The steps of an attack in order, at any pace; faster ones score higher."""
        return _drifts(trace, [template]).drop("lens")

    return f


DRIFTS = {_name: drift(_name) for _name in model.TEMPLATES}
LENSES.update(DRIFTS)

DEFAULT = ("burst", "sweep", "ctrl", "netvol", "rhythm", "clock", "surprisal", "coupling", "digits", "books", *model.TEMPLATES)


def series(trace: DataFrame, prof: Profile, names=DEFAULT) -> DataFrame:
    """(trace_id, lens, ts, score) of several detectors."""
    out, names = None, list(names)
    if {"rhythm", "surprisal"} <= set(names) and (LENSES["rhythm"], LENSES["surprisal"]) == (rhythm, surprisal):  # both by one sort
        both = F.explode(F.array(*[F.struct(F.lit(n).alias("lens"), F.col(c).cast("double").alias("score")) for n, c in (("rhythm", "regular"), ("surprisal", "x"))]))
        out = _steps(trace, prof).select("trace_id", F.col("ts").cast("double").alias("ts"), both.alias("e")).select("trace_id", "e.lens", "ts", "e.score")
        names = [n for n in names if n not in ("rhythm", "surprisal")]
    if len(counted := [n for n in names if n in COUNTED and LENSES[n] is COUNTED[n]]) > 1:  # all by one reading
        own = _counts(trace, prof, counted)
        out, names = own if out is None else out.unionByName(own), [n for n in names if n not in counted]
    if len(chained := [n for n in names if n in DRIFTS and LENSES[n] is DRIFTS[n]]) > 1:  # all by one sort
        own = _drifts(trace, chained)
        out, names = own if out is None else out.unionByName(own), [n for n in names if n not in chained]
    for n in names:
        own = LENSES[n](trace, prof).select("trace_id", F.lit(n).alias("lens"), "ts", "score")
        out = own if out is None else out.unionByName(own)
    return out


# ---------------------------------------------------------------------- laid-over events

#: Detectors whose series changes only near the events that are laid over a trace.
LOCAL = {"burst": burst, **COUNTED, "books": books, **DRIFTS}
_STRETCH = 600.0  # seconds by which base events and attacks meet


def local(names) -> list[str]:
    return [n for n in names if n in LOCAL and LENSES[n] is LOCAL[n]]


def altered(bases: DataFrame, extra: DataFrame, prof: Profile, names, taus: dict[str, float]) -> DataFrame:
    """(trace_id, lens, ts, score) of detectors of LOCAL on base traces over which reported events are laid: extra has (item, base, t, kind, target, size), trace_id is the item.

    Base traces are not copied for each item. The rows are those of windows that hold an event of the item or that it changes; every other row above its threshold (taus) is one of the
    clean base trace as well.
    """
    names, out = list(names), []
    if "burst" in names:
        own = _reported(bases).groupBy(F.col("trace_id").alias("base"), _bin(10.0).alias("bin")).agg(F.count("*").alias("own"))
        new = extra.groupBy("item", "base", _bin(10.0).alias("bin")).agg(F.count("*").alias("n")).join(own, ["base", "bin"], "left")
        out.append(_laid(new, "burst", (F.col("bin") + 1) * 10.0, F.col("n") + F.coalesce("own", F.lit(0))))
    if counted := [n for n in names if n in COUNTED]:
        out.append(_altered_counts(bases, extra, prof, counted))
    if "books" in names:
        out.append(_altered_books(bases, extra, prof))
    if chained := [n for n in names if n in DRIFTS]:
        out.append(_altered_drifts(bases, extra, chained, taus))
    every = out[0]
    for own in out[1:]:
        every = every.unionByName(own)
    return every


def _laid(df: DataFrame, lens_: str, ts: Column, score: Column) -> DataFrame:
    return df.select(F.col("item").alias("trace_id"), F.lit(lens_).alias("lens"), ts.cast("double").alias("ts"), score.cast("double").alias("score"))


def _altered_counts(bases: DataFrame, extra: DataFrame, prof: Profile, names) -> DataFrame:
    by_target = tables.written(_per_target(_reported(bases), prof, "trace_id").withColumnRenamed("trace_id", "base"))
    own = _per_window(by_target, "base")
    new = _per_target(extra, prof, "item", "base").join(by_target.select("base", "bin", "target", F.lit(True).alias("known")), ["base", "bin", "target"], "left")
    new = _per_window(new.withColumn("fresh", F.when(F.col("known").isNull(), F.col("target"))), "item", "base", target="fresh")  # targets that the base's window lacks
    both = new.join(own.select("base", "bin", *[F.col(c).alias(f"_{c}") for c in ("n", "ts", "sweep", "ctrl", "nets", "netvol")]), ["base", "bin"], "left")
    sums = [F.coalesce(F.col(c) + F.col(f"_{c}"), c, f"_{c}").alias(c) for c in ("n", "sweep", "ctrl", "nets", "netvol")]
    return _counted(both.select(F.col("item").alias("trace_id"), "bin", F.greatest("ts", "_ts").alias("ts"), *sums), prof, names)


def _altered_books(bases: DataFrame, extra: DataFrame, prof: Profile, tol: float = 2.0) -> DataFrame:
    """A laid event without a twin in the base's independent record counts; recorded events that it is a twin of count no more. Buckets are as wide as tol, a power of two, so that one's own
    is surely near, and of the two beside it the nearest time tells."""
    seen = bases.where("chan = 1").select(F.col("trace_id").alias("base"), "kind", F.col("t").alias("_t"), F.floor(F.col("t") / tol).alias("_b"))
    alone = unbalanced(bases, tol).groupBy(F.col("trace_id").alias("base"), "kind", "chan", F.col("t").alias("_t")).agg(F.count("*").alias("m"))
    alone = tables.written(alone)
    new = extra.join(seen.select("base").distinct(), "base", "left_semi").groupBy("item", "base", "kind", "t").agg(F.count("*").alias("m"))
    new = new.withColumn("_d", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))).withColumn("_b", F.floor(F.col("t") / tol) + F.col("_d"))
    edges = seen.groupBy("base", "kind", "_b").agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"))
    met = F.when(F.col("_d") == 0, F.col("_low").isNotNull()).when(F.col("_d") < 0, F.col("t") - F.col("_high") <= tol).otherwise(F.col("_low") - F.col("t") <= tol)
    odd = new.join(edges, ["base", "kind", "_b"], "left").groupBy("item", "base", "kind", "t", "m").agg(F.max(F.coalesce(met, F.lit(False))).alias("met")).where("NOT met")
    twins = alone.where("chan = 1").select("base", "kind", "_t", F.floor(F.col("_t") / tol).alias("_b"), F.col("m").alias("_m"))
    gone = new.join(twins, ["base", "kind", "_b"]).where(F.abs(F.col("_t") - F.col("t")) <= tol).select("item", "base", "kind", "_t", "_m").distinct()
    change = odd.select("item", "base", _bin(prof.win).alias("bin"), "m").unionByName(gone.select("item", "base", F.floor(F.col("_t") / prof.win).alias("bin"), (-F.col("_m")).alias("m")))
    own = alone.groupBy("base", F.floor(F.col("_t") / prof.win).alias("bin")).agg(F.sum("m").alias("own"))
    g = change.groupBy("item", "base", "bin").agg(F.sum("m").alias("m")).join(own, ["base", "bin"], "left").withColumn("x", F.col("m") + F.coalesce("own", F.lit(0)))
    return _laid(g.where("x > 0"), "books", (F.col("bin") + 1) * prof.win, F.col("x"))


def _altered_drifts(bases: DataFrame, extra: DataFrame, templates, taus: dict[str, float]) -> DataFrame:
    """A chain above its threshold ends within a time that the threshold gives (the score is log(3600 / (end - t + 1))); if it has a laid event, all of its steps are no further from one.
    Of the base, each item gets the steps in that time around its events: a chain in a stretch of a trace is that of the trace, or ends after the stretch."""
    reach = max([3600.0 * math.exp(-max(taus[n], 0.0)) for n in templates if taus.get(n) is not None], default=0.0)
    steps = sorted({model.TOKENS[x] for n in templates for x in model.TEMPLATES[n]})
    place = lambda c: F.floor(c / _STRETCH)
    around = extra.groupBy("item", "base").agg((F.min("t") - reach).alias("_from"), (F.max("t") + reach).alias("_to"))
    around = around.withColumn("_b", F.explode(F.sequence(place(F.col("_from")), place(F.col("_to")))))
    own = _reported(bases).where(_token().isin(*steps)).select(F.col("trace_id").alias("base"), "seq", "t", "kind", "target", place(F.col("t")).alias("_b"))
    own = own.join(around, ["base", "_b"]).where((F.col("t") >= F.col("_from")) & (F.col("t") <= F.col("_to"))).select(F.col("item").alias("trace_id"), "seq", "t", "kind", "target")
    new = extra.select(F.col("item").alias("trace_id"), (F.lit(1 << 40) + F.monotonically_increasing_id()).alias("seq"), "t", "kind", "target")
    return _drifts(own.unionByName(new).withColumn("chan", F.lit(0)), templates)

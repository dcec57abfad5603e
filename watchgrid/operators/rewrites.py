"""Joins and windows that Spark has no operator for, as compositions of its own."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchgrid.sources import tables


def unmatched(df: DataFrame, keys: list[str], t: str, side: str, tol: float) -> DataFrame:
    """Rows without a row of the other side (0 or 1 in column `side`) of the same keys within `tol` of their time.

    By buckets of time, one row for both sides: they are at most half of tol wide, and of a power of two, so that the division is exact. A row is met if the other side is in its bucket;
    if not, the last time of the other side before the bucket and the first one after it are the nearest for all rows in it, and one sort of the buckets finds both. Buckets whose rows
    are surely met go; the rows of the others, few on dense traces, are compared with these two times.
    Rows of which a bucket says nothing (no time or side, huge times, a tolerance of 0) are compared among themselves; where there are none, nothing is read for them.
    """
    cols, width, kind = df.columns, 2.0 ** math.floor(math.log2(tol) - 1) if tol > 0 else 1.0, df.schema[side].dataType
    usual = F.col(side).isin(0, 1) & (F.abs(F.col(t)) < width * 2.0**60) if tol > 0 else F.lit(False)
    df = df.withColumn("_b", F.when(usual, F.floor(F.col(t) / width)))
    of = lambda s: F.when(F.col("_b").isNotNull() & (F.col(side) == s), F.col(t))
    w = Window.partitionBy(*keys).orderBy("_b")
    before = lambda s: F.last(f"_max{s}", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = lambda s: F.coalesce(*[F.lead(f"_min{s}", i).over(w) for i in range(1, math.floor(tol / width) + 2)])  # noqa: E731 (a bucket further on is too far)
    buckets = df.groupBy(*keys, "_b").agg(*[f(of(s)).alias(f"_{n}{s}") for s in (0, 1) for n, f in (("min", F.min), ("max", F.max))])
    buckets = buckets.withColumns({f"_{n}{s}": f(s) for s in (0, 1) for n, f in (("p", before), ("n", after))})
    sides = [F.struct(F.lit(s).cast(kind).alias(side), *[F.col(f"_{n}{x}").alias(f"_{n}") for n, x in (("min", s), ("max", s), ("p", 1 - s), ("n", 1 - s))], F.col(f"_min{1 - s}").isNull().alias("_alone")) for s in (0, 1)]
    apart = lambda a, b: F.coalesce(F.col(b) - F.col(a) > tol, F.lit(True))
    left = F.col("_alone") & F.col("_min").isNotNull() & apart("_p", "_max") & apart("_min", "_n")
    alone = buckets.select(*keys, "_b", F.explode(F.array(*sides)).alias("_x")).select(*keys, "_b", "_x.*").where(left | (F.col("_b").isNull() & (F.col(side) == 0)))
    alone = tables.small(alone.select(*keys, side, "_b", "_p", "_n"))
    there = alone.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, side, "_b"])], "_p", "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(k) == F.col(f"_k{i}") for i, k in enumerate([side, "_b"], len(keys))]
    rows, odd = alone.agg(F.count("*"), F.count_if(F.col("_b").isNull())).first()
    by = df.join(F.broadcast(alone.select("_b")), "_b", "left_semi") if rows <= tables.SMALL_ROWS else df  # most rows go by one number, before their keys are looked up
    out = by.join(there, reduce(lambda a, b: a & b, same)).where(apart("_p", t) & apart(t, "_n")).select(*cols)
    return out.unionByName(_unmatched(df.where("_b IS NULL").select(*cols), keys, t, side, tol)) if odd else out


def _unmatched(df: DataFrame, keys: list[str], t: str, side: str, tol: float) -> DataFrame:
    """unmatched by a nearest as-of anti-join without a join: both sides in one window, the last time of the other side forwards and backwards by RANGE frames, so that ties see each other.
    Both frames run: one to the end of the group would be evaluated anew for every row. `least` skips a missing neighbour."""
    nearest = lambda order: Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    other = lambda frame: F.coalesce(*[F.when(F.col(side) == s, F.last(F.when(F.col(side) == 1 - s, F.col(t)), True).over(frame)) for s in (0, 1)])
    cols = df.columns
    df = df.withColumn("_p", other(nearest(F.col(t)))).withColumn("_n", other(nearest(F.desc(t))))
    near = F.least(F.col(t) - F.col("_p"), F.col("_n") - F.col(t))
    return df.where(near.isNull() | (near > tol)).select(*cols)


def chain_ends(df: DataFrame, keys: list[str], order: list[str], token: Column, template: list[int], t: str) -> DataFrame:
    """For each row of the template's first token from which all its steps follow in order, each the next of its kind: (keys, t, end), end the time of the last step."""
    return chains(df, keys, order, token, {"": template}, t).drop("name")


def chains(df: DataFrame, keys: list[str], order: list[str], token: Column, templates: dict[str, list[int]], t: str) -> DataFrame:
    """chain_ends of several templates by one shuffle and sort: (keys, t, name, end).

    Backwards through the templates: a step's end is that of the nearest following row of the next step. Templates share the windows of the steps that they end with alike. Rows of other
    tokens go before the windows, and those of a step once the one before it has its ends.
    """
    after = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    whole = {name: tuple(steps) for name, steps in templates.items()}
    tails = lambda n: sorted({x[-n:] for x in whole.values() if len(x) >= n})
    ends = {x: F.when(F.col("_tok") == x[0], F.col(t)) for x in tails(1)}
    df = df.withColumn("_tok", token).where(F.col("_tok").isin(*{s for x in whole.values() for s in x}))
    names = lambda xs: {x: f"_e{len(x)}_{'_'.join(map(str, x))}" for x in xs}
    kept = list(dict.fromkeys([*keys, *order, t, "_tok"]))
    for n in range(1, max(map(len, whole.values()))):
        own, done = names(ends), [f"_end{i}" for i, x in enumerate(whole.values()) if len(x) < n]
        now = [f.alias(f"_end{i}") for i, x in enumerate(whole.values()) if len(x) == n for f in [ends[x]]]
        df = df.select(*kept, *done, *now, *[e.alias(own[x]) for x, e in ends.items()])
        following = tails(n + 1)
        df = df.withColumns({own[r]: F.last(own[r], True).over(after) for r in sorted({x[1:] for x in following})})
        left = {x[i] for x in whole.values() for i in range(len(x)) if len(x) - i > n} | {x[0] for x in whole.values()}
        df = df.where(F.col("_tok").isin(*left))
        ends = {x: F.when(F.col("_tok") == x[0], F.col(own[x[1:]])) for x in following}
    longest = max(map(len, whole.values()))
    out = [F.struct(F.lit(name).alias("name"), (ends[x] if len(x) == longest else F.col(f"_end{i}")).alias("end")) for i, (name, x) in enumerate(whole.items())]
    return df.select(*keys, t, F.explode(F.array(*out)).alias("_x")).where("_x.end IS NOT NULL").select(*keys, t, "_x.name", "_x.end")


def hop_blocks(df: DataFrame, keys: list[str], order: list[str], size: int, hop: int) -> DataFrame:
    """Rows with (i, block): the row's place in its trace and each block of `size` consecutive rows, one every `hop`, that holds it. Only whole blocks."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    first = F.greatest(F.lit(0), F.floor((F.col("i") - size) / hop) + 1)
    last = F.least(F.floor(F.col("i") / hop), F.floor((F.col("_n") - size) / hop))
    return df.where((F.col("_n") >= size) & (first <= last)).withColumn("block", F.explode(F.sequence(first, last))).drop("_n")


def followed(points: DataFrame, events: DataFrame, keys: list[str], t: str, width: Column | float, out: str = "hit") -> DataFrame:
    """points with a boolean: is there an event of the same keys in (t, t + width]? An interval-existence join by buckets of the width.

    A point looks into its own bucket and the next, for the first event after it: events of a bucket are reduced to arrays beforehand. Widths are a number or the points'
    column `width`, with which events are bucketed alike.
    """
    w = F.lit(float(width)) if not isinstance(width, Column) else width
    e = events.select(*keys, F.col(t).alias("_e"), F.floor(F.col(t) / w).alias("_b")).distinct()
    e = e.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list("_e")).alias("_es"))
    own = [*keys, t] + (["width"] if isinstance(width, Column) else [])  # points of one key, time and width have one answer
    q = points.select(*own).distinct().withColumn("_b", F.explode(F.array(F.floor(F.col(t) / w), F.floor(F.col(t) / w) + 1)))
    hits = q.join(e, [*keys, "_b"]).where(F.exists("_es", lambda x: (x > F.col(t)) & (x <= F.col(t) + w))).select(*own).distinct().withColumn(out, F.lit(True))
    return points.join(hits, own, "left").withColumn(out, F.coalesce(out, F.lit(False)))

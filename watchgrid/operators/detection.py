"""Algebra of detections: what monitors catch together, how independent they are, and what their loss would cost.

A detection table has rows (item, monitor, detected), detected null where a monitor could not be judged. Items are aggregated in Spark to counts of fired sets; with M monitors
these are at most 2^M rows, and for the small M of a monitor ensemble the combinatorics on them runs on the driver.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.functions import scalars


def evaluable(table: DataFrame) -> DataFrame:
    """(item, n, n_fired, fired) of items that every monitor could judge."""
    monitors = table.agg(F.count_distinct("monitor").alias("m"))
    g = table.groupBy("item").agg(F.count("detected").alias("n"), F.sum(F.coalesce("detected", F.lit(0))).alias("n_fired"), F.array_sort(F.collect_set(F.when(F.col("detected") == 1, F.col("monitor")))).alias("fired"))
    return g.crossJoin(F.broadcast(monitors)).where("n = m").drop("m")  # one row


def ensemble(table: DataFrame) -> DataFrame:
    """(item, caught): caught by any monitor, of items that all could judge."""
    return evaluable(table).select("item", (F.col("n_fired") > 0).cast("int").alias("caught"))


def obstruction_rate(table: DataFrame) -> DataFrame:
    """Of the items that some monitor caught, the share on which monitors disagree."""
    return evaluable(table).where("n_fired > 0").agg(F.avg((F.col("n_fired") < F.col("n")).cast("double")).alias("obstruction"))


def rates(table: DataFrame) -> DataFrame:
    """(monitor, k, n, rate, low, high): share of items detected, with its 95 % interval."""
    g = table.where("detected IS NOT NULL").groupBy("monitor").agg(F.sum("detected").cast("long").alias("k"), F.count("*").alias("n"))
    low, high = scalars.wilson(F.col("k"), F.col("n"))
    return g.select("monitor", "k", "n", (F.col("k") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def _pairs(table: DataFrame) -> DataFrame:
    a, b = (table.select("item", F.col("monitor").alias(f"{x}"), F.col("detected").cast("double").alias(f"d{x}")) for x in "ab")
    return a.join(b, "item").where("a < b")


def correlations(table: DataFrame) -> DataFrame:
    """(a, b, same, corr) of the detections of each two monitors on the items both could judge."""
    return _pairs(table.where("detected IS NOT NULL")).groupBy("a", "b").agg(F.min((F.col("da") == F.col("db")).cast("int")).alias("same"), scalars.correlation(F.col("da"), F.col("db")).alias("corr"))


def failure_correlation(table: DataFrame, least_items: int = 5) -> DataFrame:
    """Mean correlation of misses over the caught items, of pairs whose misses both vary; null below least_items."""
    caught = evaluable(table).where("n_fired > 0").select("item")
    n = caught.agg(F.count("*").alias("items"))
    own = table.join(caught, "item", "left_semi").withColumn("detected", 1 - F.col("detected"))
    vary = own.groupBy("monitor").agg(F.stddev_pop("detected").alias("sd")).where("sd > 0").select("monitor")
    c = _pairs(own.join(F.broadcast(vary), "monitor", "left_semi")).groupBy("a", "b").agg(scalars.correlation(F.col("da"), F.col("db")).alias("c")).agg(F.avg("c").alias("c"))
    return c.crossJoin(n).select(F.when(F.col("items") >= least_items, F.col("c")).alias("failure_correlation"))


def gram(matrix: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """(a, b, g): inner products of the columns of a long matrix."""
    x, y = (matrix.select(F.col(row).alias("r"), F.col(col).alias(c), F.col(value).alias(f"v{c}")) for c in "ab")
    return x.join(y, "r").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("g"))


def effective_rank(matrix: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Participation ratio of the singular values of the column-normalised matrix: with the normalised Gram matrix G, trace(G)^2 / sum(G^2), without any decomposition."""
    g = gram(matrix, row, col, value)
    d = g.where("a = b").select(F.col("a").alias("m"), F.sqrt("g").alias("s"))
    n = g.join(F.broadcast(d.withColumnsRenamed({"m": "a", "s": "sa"})), "a").join(F.broadcast(d.withColumnsRenamed({"m": "b", "s": "sb"})), "b")  # a row per monitor
    n = n.withColumn("x", F.when((F.col("sa") > 0) & (F.col("sb") > 0), F.col("g") / (F.col("sa") * F.col("sb"))).otherwise(0.0))
    return n.agg((F.pow(F.sum(F.when(F.col("a") == F.col("b"), F.col("x"))), 2) / F.sum(F.col("x") * F.col("x"))).alias("effective_rank"))


# -------------------------------------------------------------- on fired sets


class Fired:
    """Counts of fired sets, as bit masks over the monitors."""

    def __init__(self, counts: dict[frozenset, int], names: list[str]):
        self.names, bit = list(names), {n: 1 << i for i, n in enumerate(names)}
        self.counts: dict[int, int] = {}
        for fired, n in counts.items():
            mask = sum(bit[f] for f in fired if f in bit)
            if mask:
                self.counts[mask] = self.counts.get(mask, 0) + n
        self.total = sum(self.counts.values())

    @classmethod
    def of(cls, table: DataFrame, names: list[str] | None = None) -> Fired:
        rows = evaluable(table).groupBy("fired").agg(F.count("*").alias("n")).collect()  # at most 2^M rows
        names = names or sorted({m for r in rows for m in r["fired"]})
        return cls({frozenset(r["fired"]): r["n"] for r in rows}, names)

    def covered(self, chosen: int) -> int:
        return sum(n for mask, n in self.counts.items() if mask & chosen)

    def _best(self, left: list[int], chosen: int) -> tuple[int, int]:
        gains = [self.covered(chosen | 1 << i) - self.covered(chosen) for i in left]
        k = max(range(len(left)), key=lambda i: gains[i])
        return left[k], gains[k]

    def order(self) -> list[tuple[str, int]]:
        """Monitors by what each adds to those before it, largest first."""
        left, chosen, out = list(range(len(self.names))), 0, []
        while left:
            i, gain = self._best(left, chosen)
            out.append((self.names[i], gain))
            left.remove(i)
            chosen |= 1 << i
        return out

    def groups(self, delta: float = 0.1) -> list[list[str]]:
        """Disjoint groups that each catch 1 - delta of what all catch, found greedily; a lower bound of their number."""
        out, left = [], list(range(len(self.names)))
        while left and self.total:
            group, chosen, rest = [], 0, list(left)
            while rest and self.covered(chosen) < (1 - delta) * self.total:
                i, gain = self._best(rest, chosen)
                if not gain:
                    break
                group.append(i)
                rest.remove(i)
                chosen |= 1 << i
            if not group or self.covered(chosen) < (1 - delta) * self.total:
                break
            out.append([self.names[i] for i in group])
            left = [i for i in left if i not in group]
        return out

    def plateau(self) -> list[tuple[int, float]]:
        """For each m, the expected share that m monitors drawn at random catch: exact, from how many sets of m miss a fired set."""
        m_all = len(self.names)
        return [(m, sum(n * (1 - comb(m_all - mask.bit_count(), m) / comb(m_all, m)) for mask, n in self.counts.items()) / self.total) for m in range(1, m_all + 1)] if self.total else []

    def without_one(self) -> dict[str, float]:
        """Coverage of the caught items that is left when a monitor is lost."""
        every = (1 << len(self.names)) - 1
        return {n: self.covered(every & ~(1 << i)) / self.total if self.total else 0.0 for i, n in enumerate(self.names)}


def merge_copies(names: list[str], pairs: list[tuple[str, str, bool, float | None]], least: float = 0.95) -> tuple[dict[str, str], list[list[str]]]:
    """(monitor -> representative, merged clusters): monitors that detect alike, or correlate by at least `least`, count as one."""
    root = {n: n for n in names}

    def find(n: str) -> str:
        while root[n] != n:
            n = root[n]
        return n

    for a, b, same, corr in pairs:
        if a in root and b in root and (same or (corr is not None and corr >= least)):
            x, y = sorted((find(a), find(b)), key=names.index)
            root[y] = x
    clusters: dict[str, list[str]] = {}
    for n in names:
        clusters.setdefault(find(n), []).append(n)
    return {n: find(n) for n in names}, [c for c in clusters.values() if len(c) > 1]


def independent(table: DataFrame, least: float = 0.95) -> tuple[dict[str, str], list[list[str]]]:
    """merge_copies of the monitors that ever fire."""
    live = sorted(r["monitor"] for r in table.where("detected = 1").select("monitor").distinct().collect())  # names of monitors
    pairs = [(r["a"], r["b"], bool(r["same"]), r["corr"]) for r in correlations(table).collect()]  # M^2 / 2 rows
    return merge_copies(live, pairs, least)


def represented(table: DataFrame, rep: dict[str, str]) -> DataFrame:
    """The detection table with near-copies merged under their representative; monitors that never fire are left out."""
    names = F.create_map(*[F.lit(x) for kv in rep.items() for x in kv])
    t = table.withColumn("monitor", F.try_element_at(names, F.col("monitor"))).where("monitor IS NOT NULL")
    return t.groupBy("item", "monitor").agg(F.max("detected").alias("detected"))


def smallest_caught(items: DataFrame, caught: DataFrame, least: float = 0.8) -> DataFrame:
    """(family, k80): the smallest strength from which items (item, family, k) are caught in `least` of the runs; null if none."""
    r = items.join(caught, "item").groupBy("family", "k").agg(F.avg("caught").alias("rate"))
    return r.groupBy("family").agg(F.min(F.when(F.col("rate") >= least, F.col("k"))).alias("k80"))


def fisher_greater(a: int, n_a: int, b: int, n_b: int) -> float:
    """One-sided exact test that a of n_a is a larger share than b of n_b."""
    k, n = a + b, n_a + n_b
    return float(min(1.0, sum(comb(n_a, i) * comb(n_b, k - i) for i in range(a, min(k, n_a) + 1) if k - i <= n_b) / comb(n, k)))


def spearman(x, y) -> float | None:
    """Correlation of ranks, ties averaged; null below six pairs."""
    if len(x) < 6:
        return None

    def ranks(v):
        v = np.asarray(v, dtype=float)
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    a, b = ranks(x), ranks(y)
    return float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else 0.0

"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks of their source by a keyed hash; a keyed permutation of the blocks says which of them a source's target reaches, epoch by epoch. What each source
contributes is thus an exact quota of block draws. A binary tree over the output shards splits the vector of quotas: the left half of the shards receives a multivariate
hypergeometric sample of the parent's draws, the right half the rest, down to single shards, so that every shard holds a random, exactly balanced share and no draw twice.
A shard's draws of a source are the next ones of the source's permuted sequence, hence disjoint; inside a shard the documents are shuffled by a keyed hash,
which is ranked over the whole shard in ranges of the hash.

Only the statistics of a source (one row each) come to the driver; blocks and documents stay distributed. Sources are the entries of a mixture's configuration; a mixture
over more than MAX_SOURCES sources is refused with an error rather than cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchgrid.llm import common

#: Blocks of a source: one for each so many words, within these limits. A block is the unit that goes to a shard; the last one that a target reaches is cut between documents.
BLOCK_WORDS, MIN_BLOCKS, MAX_BLOCKS = 20_000, 16, 4096
SHARDS = 16
#: A shard's shuffle is ranked in 2^RANGE_BITS ranges of the hash.
RANGE_BITS = 12
MAX_SOURCES = 100_000
SEED = 20


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and \\x09 to \\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most times its size; what is above goes to the others by weight, again and again until nothing is above."""
    targets, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) of draws: the leaves of the splitting tree. Column sums are the quotas."""
    out, todo = np.zeros((shards, len(quotas)), dtype=np.int64), [(0, shards, quotas.astype(np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid, total = (lo + hi) // 2, int(have.sum())
        take = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if total else have
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def _unit(*keys) -> Column:
    return F.xxhash64(*[F.col(k) if isinstance(k, str) else F.lit(k) for k in keys])


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per draw: row (which input row), doc_id, source, size, source_size, target, copy (1, 2, ...; null where the mix takes nothing), shard, place (its rank in the shard by the keyed shuffle).

    Sources in code-point order, null last as a source of its own, weigh `weights` in turn and share `share` times all words; no target is above `most` times its source's
    size. Documents of size 0, also null and empty texts, are never drawn. Repeated rows are drawn each for itself. An empty table gives no rows. The same rows give the same mix
    whatever their order and partitioning (among repeated rows that a cut falls between, any of them).
    """
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    plan = plan_mix(sized, weights, share, most, shards, seed)
    draws = common.written(plan.draws.withColumn("h", _unit("doc_id", seed, "copy")).withColumn("range", F.shiftright("h", 64 - RANGE_BITS)))
    taken, alone = draws.where("copy IS NOT NULL"), draws.where("copy IS NULL").withColumn("place", F.lit(None).cast("long"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = taken.groupBy("shard", "range").agg(F.count("*").alias("n")).select("shard", "range", before.alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "range").orderBy("h", "doc_id", "source", "size", "copy", "row"))
    taken = taken.withColumn("nth", nth).join(starts, ["shard", "range"]).withColumn("place", F.col("start") + F.col("nth"))
    drawn = taken.unionByName(alone, allowMissingColumns=True)
    return drawn.select("row", "doc_id", "source", "size", "source_size", "target", "copy", "shard", "block", "place")


class plan_mix:  # noqa: N801
    """The decisions of a mix over rows (doc_id, source, size): .sources (one row each), .draws (a row per document and copy)."""

    def __init__(self, sized: DataFrame, weights, share: float, most: float, shards: int, seed: int):
        spark = sized.sparkSession
        self.sized = sized = common.written(sized.withColumn("row", F.monotonically_increasing_id()))  # numbers only: texts are read and counted once
        found = sized.groupBy("source").agg(F.sum("size").alias("source_size")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"a mixture has at most {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))  # UTF-8 order is code-point order
        sizes = [int(r["source_size"] or 0) for r in found]
        targets = water_fill(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], share * sum(sizes), most)
        rows = []
        for i, (r, size, target) in enumerate(zip(found, sizes, targets, strict=True)):
            full = min(int(target // size), int(most)) if size else 0
            rows.append((i, r["source"], size, target, full, int(round(target)) - full * size, int(np.clip(size // BLOCK_WORDS, MIN_BLOCKS, MAX_BLOCKS))))
        self.sources = sources = spark.createDataFrame(rows, "s int, source string, source_size long, target double, epochs int, rest long, blocks int")
        known = F.broadcast(sources)  # at most MAX_SOURCES rows
        at = sized.join(known, sized["source"].eqNullSafe(sources["source"])).select("row", "doc_id", sized["source"], "size", "s", "source_size", "target", "epochs", "rest", F.pmod(_unit("doc_id", seed), "blocks").cast("int").alias("block"))
        # Blocks in permuted order: those before the rest's end go whole, the one that holds its end is cut between documents. At most MAX_BLOCKS rows a source.
        blocks = at.groupBy("s", "block", "epochs", "rest").agg(F.sum("size").alias("words")).where("words > 0")
        order = Window.partitionBy("s").orderBy(_unit("s", "block", seed + 1), "block")
        blocks = blocks.withColumn("through", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(order))
        blocks = blocks.select("s", "block", "nth", F.expr("CASE WHEN through <= rest THEN words ELSE greatest(0, rest - through + words) END").alias("part"), "words")
        self.blocks = blocks = common.written(blocks)
        cut = at.join(blocks.drop("words", "nth"), ["s", "block"], "left")
        partial = blocks.where("part > 0 AND part < words").select("s", "block")
        within = Window.partitionBy("s", "block").orderBy(_unit("doc_id", seed + 2), "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
        # In the cut block a document is taken while its middle lies before the end, so that the sum is as near as whole documents allow.
        ends = at.join(F.broadcast(partial), ["s", "block"], "left_semi").withColumn("through", F.sum("size").over(within))  # one block of each source at most
        ends = ends.join(F.broadcast(blocks.where("part > 0 AND part < words").select("s", "block", "part")), ["s", "block"])
        inside = ends.where("2 * through - size <= 2 * part").select("row", "s", "block", F.lit(1).alias("extra"))
        cut = cut.join(common.small(blocks.where("part = words").select("s", "block", F.lit(1).alias("whole"))), ["s", "block"], "left")
        cut = cut.join(inside, ["row", "s", "block"], "left")
        self.taken = cut.withColumn("copies", F.expr("CASE WHEN size = 0 THEN 0 ELSE epochs + coalesce(whole, extra, 0) END"))
        self.shards, self.seed = shards, seed

    @property
    def draws(self) -> DataFrame:
        """A row per document and copy with the shard that the splitting tree gives it; documents that are not taken keep one row without copy."""
        spark, blocks = self.sized.sparkSession, self.blocks
        used = blocks.join(F.broadcast(self.sources.select("s", "epochs")), "s").withColumn("copy", F.explode(F.expr("CASE WHEN epochs + int(part > 0) > 0 THEN sequence(1, epochs + int(part > 0)) END")))
        quota = {r["s"]: r["n"] for r in used.groupBy("s").agg(F.count("*").alias("n")).collect()}
        ids = sorted(quota)
        leaves = split(np.array([quota[i] for i in ids]), self.shards, self.seed)
        starts = np.cumsum(leaves, axis=0) - leaves
        rows = [(int(i), int(n), int(starts[n, j]), int(starts[n, j] + leaves[n, j])) for j, i in enumerate(ids) for n in range(self.shards) if leaves[n, j]]
        tree = spark.createDataFrame(rows, "s int, shard int, lo long, hi long")
        turn = F.row_number().over(Window.partitionBy("s").orderBy("copy", "nth")) - 1
        placed = used.withColumn("turn", turn)
        ranges = tree.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("hi", "shard"))).alias("leaves"))  # self.shards entries a source
        placed = placed.join(ranges, "s").select("s", "block", "copy", F.expr("filter(leaves, l -> l.hi > turn)[0].shard").alias("shard"))
        rows = self.taken.withColumn("copy", F.explode_outer(F.expr("CASE WHEN copies > 0 THEN sequence(1, copies) END")))
        return rows.join(placed, ["s", "block", "copy"], "left")


def digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document row, repeated ones each: doc_id, size, source, source_size, target, taken (words of all its draws), n_draws, shards (of its draws), places (in these shards)."""
    drawn = mix(docs, **options)
    return drawn.groupBy("row", "doc_id", "size", "source", "source_size", "target").agg(
        F.sum(F.expr("CASE WHEN copy IS NULL THEN 0 ELSE size END")).cast("long").alias("taken"), F.count("copy").alias("n_draws"), F.concat_ws(",", F.array_sort(F.collect_list("shard"))).alias("shards"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("copy").isNotNull(), F.struct("shard", "place")))), lambda x: x["place"].cast("string"))).alias("places"),
    ).drop("row")


def drawn_rows(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, with their columns, each as often as the mix draws it, in the order of shards and of places in them. Rows that repeat a key with one size are drawn alike."""
    many = mix(docs, key=key, **options).where("copy IS NOT NULL").groupBy("doc_id", "size", "source", "copy").agg(F.min(F.struct("shard", "place")).alias("at_"))
    text, source = options.get("text", "text"), options.get("source", "source")
    many = many.select(F.col("doc_id").alias("k_"), F.col("size").alias("s_"), F.col("source").alias("o_"), "at_")
    sized = docs.withColumn("w_", word_count(F.col(text)))
    same = sized[key].eqNullSafe(many["k_"]) & (sized["w_"] == many["s_"]) & sized[source].eqNullSafe(many["o_"])
    return sized.join(many, same).orderBy("at_").select(*[sized[c] for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.read(spark, sf_dir, "documents")).drop("source")

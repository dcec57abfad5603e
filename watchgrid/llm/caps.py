"""Near-duplicate embeddings by spherical-cap filters.

After a random rotation a vector is cut in two halves, each with its own random code of BLOCK directions; a filter is a pair of directions, its cap the vectors whose summed
inner products exceed a threshold. The product structure lets a vector be list-decoded to all its caps without looking at all pairs: only first directions that can reach the
threshold with the best second one are opened. Vectors that share a cap, and a label, are compared exactly. A vector that exceeds no cap of a rotation gets its nearest one.

The code grows with the largest label's class, and its caps get sparser, so the rotations grow with it: a random rotation makes any pair of a cosine a random one, hence a pair
is missed in all of R rotations with the R-th power of the probability for one, which is measured on random pairs at exactly the least cosine. R is the first number that takes
it to MISS; pairs above the least cosine are missed less often.

A vector goes once to each (label, rotation, first direction) in which it has caps, rather than once to each cap. A pair may meet in several such groups; it is counted in that
of its smallest common cap alone, so degrees are exact without emitting pairs, and a group gives only a spanning forest of its links. Equal vectors are one class from the
start. Groups above CHUNK members are dealt over blocks of members that meet pairwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm import common, vectors

LEAST = 0.93
ROTATIONS, CAPS, SEED = 4, 10, 9
#: Probability that a pair at exactly the least cosine shares no cap. It is measured with so many codes and pairs; where one rotation misses more than SPARSE, caps get denser.
MISS, CODES, PAIRS, SPARSE = 0.001, 16, 250, 0.8
#: Directions of a half's code at least, and members of a cap that its size aims at.
BLOCK, MEMBERS = 64, 32
CHUNK = 3000


class Filters:
    def __init__(self, dim: int, block: int, rotations: int = ROTATIONS, caps: float = CAPS, seed: int = SEED):
        rng, self.block, self.half = np.random.default_rng([seed, dim, block]), block, (dim + 1) // 2
        self.rotations = [np.linalg.qr(rng.normal(size=(2 * self.half, 2 * self.half)))[0][:dim] for _ in range(rotations)]
        self.codes = []
        for _ in range(rotations):
            c = rng.normal(size=(2, block, self.half))
            self.codes.append(c / np.linalg.norm(c, axis=2, keepdims=True))
        self.threshold = NormalDist().inv_cdf(max(0.5, 1 - caps / block**2)) / math.sqrt(self.half)  # caps a vector exceeds in one rotation, on average

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted ids of the caps of each row of unit vectors."""
        out: list[list[np.ndarray]] = [[] for _ in x]
        for r, (turn, code) in enumerate(zip(self.rotations, self.codes, strict=True)):
            y = x @ turn
            a, b = y[:, : self.half] @ code[0].T, y[:, self.half :] @ code[1].T
            top = b.max(axis=1)
            for k in range(len(x)):
                first = np.flatnonzero(a[k] + top[k] >= self.threshold)
                if len(first):
                    i, j = np.nonzero(a[k][first][:, None] + b[k] >= self.threshold)
                    ids = first[i] * self.block + j
                else:
                    ids = np.array([int(a[k].argmax()) * self.block + int(b[k].argmax())])
                out[k].append(r * self.block**2 + ids)
        return [np.concatenate(ids).astype(np.int64) for ids in out]


def missed(dim: int, block: int, caps: float, least: float, seed: int = SEED) -> float:
    """Probability that a pair at a cosine of `least` shares no cap of one rotation: the measured share and two of its standard errors."""
    rng, filters = np.random.default_rng([seed, dim, block, 1]), Filters(dim, block, CODES, caps, seed + 1)
    x, z = vectors.unit(rng.normal(size=(PAIRS, dim))), rng.normal(size=(PAIRS, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = x if dim == 1 else least * x + math.sqrt(max(0.0, 1 - least**2)) * vectors.unit(z)
    n, met = CODES * PAIRS, 0
    for a, b in zip(filters.decode(x), filters.decode(y), strict=True):
        met += len(np.unique(np.intersect1d(a, b) // block**2))
    q = 1 - met / n
    return q + 2 * math.sqrt(max(q, 1 / n) * max(1 - q, 1 / n) / n)


def scheme(dim: int, largest: int, least: float) -> tuple[int, int, int]:
    """(block, caps, rotations) for classes of up to `largest` vectors, with which a pair at `least` is missed with a probability of MISS at most."""
    caps = CAPS
    while True:
        block = max(BLOCK, math.ceil(math.sqrt(largest * caps / MEMBERS)))
        q = missed(dim, block, caps, least)
        if q <= SPARSE:
            return block, caps, max(1, math.ceil(math.log(MISS) / math.log(q)))
        if 2 * caps > block**2:
            raise ValueError(f"caps cannot find pairs at a cosine of {least}")
        caps *= 2


def link(table: DataFrame, least: float = LEAST, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) per row: other rows linked to it, the smallest key that links reach, and whether that is its own (null for a null key).

    Rows that repeat a key with different labels or vectors are vectors of their own, each with its own links. Rows link when their labels are equal and not null and the cosine of their vectors, in double precision, is at least `least`. Null labels, and vectors that are null, zero
    or hold null or non-finite components, link with nothing. Usable vectors must have one length. Repeated rows link with each other.
    """
    spark = table.sparkSession
    common.small_batches(spark)
    rows = vectors.as_double(table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).alias("label")), "v")
    rows = rows.withColumn("ok", vectors.usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    classes = rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = common.written(classes.withColumn("rep", F.monotonically_increasing_id()))  # a number for each class: ids may repeat
    one = classes.select(F.size("v").alias("dim")).first()
    alone = rows.where("NOT ok").select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), (F.col("id") == F.col("id")).alias("kept"))
    if one is None:
        return alone
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    block, caps, rotations = scheme(one["dim"], largest, least)
    filters = Filters(one["dim"], block, rotations, caps)
    model = spark.sparkContext.broadcast(filters)
    kind = rows.schema["label"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = model.value
        for pdf in batches:
            for k in range(0, len(pdf), 1000):
                part = pdf.iloc[k : k + 1000]
                x, out = vectors.matrix(part["v"]), []
                for rep, copies, own, v, ids in zip(part["rep"], part["copies"], part["label"], x, filters.decode(vectors.unit(x)), strict=True):
                    raw, caps = v.tobytes(), ids.tobytes()
                    out += [(own, int(g), rep, copies, raw, caps) for g in np.unique(ids // filters.block)]
                yield pd.DataFrame(out, columns=["label", "code", "rep", "copies", "v", "caps"])

    placed = classes.select("label", "v", "rep", "copies").mapInPandas(place, f"label {kind}, code long, rep long, copies long, v binary, caps binary")
    sizes = classes_per_code(placed)
    hot = sizes.where(F.col("n") > CHUNK).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")).drop("n")
    placed = placed.join(hot, ["label", "code"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), "chunks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    placed = placed.selectExpr("label", "code", "least(own, other) x", "greatest(own, other) y", "own", "rep", "copies", "v", "caps")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        block, code, across = model.value.block, int(pdf["code"].iloc[0]), pdf["x"].iloc[0] != pdf["y"].iloc[0]
        x = np.stack([np.frombuffer(v) for v in pdf["v"]])
        u, rep, copies, side = vectors.unit(x), pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["own"].to_numpy()
        caps = [np.frombuffer(c, dtype=np.int64) for c in pdf["caps"]]
        inside = np.zeros((len(x), block), dtype=np.float32)
        for k, c in enumerate(caps):
            inside[k, c[c // block == code] % block] = 1
        left, right = [], []
        for k in range(0, len(x), 1024):
            i, j = np.nonzero((u[k : k + 1024] @ u.T >= least - 1e-9) & (inside[k : k + 1024] @ inside.T > 0))
            i += k
            ok = (i < j) & (~across | (side[i] != side[j]))
            left.append(i[ok])
            right.append(j[ok])
        i, j = np.concatenate(left), np.concatenate(right)
        ok = np.concatenate([vectors.cosines(x[i[k : k + 20_000]], x[j[k : k + 20_000]]) >= least for k in range(0, len(i), 20_000)]) if len(i) else np.empty(0, dtype=bool)
        i, j = i[ok], j[ok]
        width = max(len(c) for c in caps)
        lists = np.full((len(x), width), np.iinfo(np.int64).max)
        for k, c in enumerate(caps):
            lists[k, : len(c)] = np.sort(c)
        mine = np.empty(len(i), dtype=bool)
        step = max(1, 8_000_000 // width**2)
        for k in range(0, len(i), step):
            a, b = lists[i[k : k + step]], lists[j[k : k + step]]
            common_ = (a[:, :, None] == b[:, None, :]).any(axis=2) & (a < np.iinfo(np.int64).max)
            mine[k : k + step] = a[np.arange(len(a)), common_.argmax(axis=1)] // block == code
        links = np.bincount(i[mine], weights=copies[j[mine]], minlength=len(x)) + np.bincount(j[mine], weights=copies[i[mine]], minlength=len(x))
        some, root = np.flatnonzero(links), common.roots(len(x), i, j)
        tied = np.flatnonzero(root != np.arange(len(x)))
        out = pd.DataFrame({"a": rep[some], "b": rep[some], "links": links[some].astype(np.int64)})
        return pd.concat([out, pd.DataFrame({"a": rep[tied], "b": rep[root[tied]], "links": 0})])

    met = common.written(placed.groupBy("label", "code", "x", "y").applyInPandas(meet, "a long, b long, links long"))
    degree = met.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    groups = common.components(met.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    groups = common.written(groups)
    least = common.written(groups.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("component_id")))
    joined = classes.join(degree, "rep", "left").join(groups.join(least, "component").select("rep", "component_id"), "rep", "left")
    joined = joined.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = rows.where("ok").join(joined, ["label", "v"]).select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)


def classes_per_code(placed: DataFrame) -> DataFrame:
    return placed.groupBy("label", "code").agg(F.count("*").alias("n"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.read(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
),
u AS (
  SELECT vec_id, label, x FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len([c for c in x if c IS NULL OR NOT isfinite(c)]) = 0 AND len([c for c in x if c <> 0]) > 0
),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
k AS (SELECT a, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, k.component_id, v.vec_id = k.component_id AS kept
FROM v LEFT JOIN k ON k.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

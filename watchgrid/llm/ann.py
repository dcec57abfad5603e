"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are fitted on a bounded sample (SAMPLE vectors with the smallest keyed hashes; all, if there are fewer): a node cuts its part of the sample at the median of the
widest of a few random projections. They are a fixed number of arrays and go to every task; every vector is then indexed by its leaf in each tree. A query searches all trees
through one priority queue, which holds the branches not taken by their distance to the cut, until it has visited its share of the leaves. That share is the least with which
PROBES vectors of the sample reach RECALL among the sample (see `needed`), so that it follows the structure of the vectors. Leaves are dealt over shards by hash; a shard gets its vectors, and each query once with the leaves that it visits there, and ranks the union of these leaves exactly. Large leaves spread over chunks.

Copies of a vector beyond the TOP + 1 smallest ids can't be among a query's TOP nearest, as ties go to smaller ids, and are left out of the index; equal queries are searched
once. Neither changes a result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchgrid.llm import common, vectors

TOP, TREES, SAMPLE, TRIED, SEED = 5, 16, 20_000, 3, 2
#: Members of the sample in a leaf; the recall that the visits are to reach, and the vectors of the sample that it is measured with.
LEAF, RECALL, PROBES = 40, 0.96, 150
#: Vectors of a leaf that one shard takes; larger leaves are split over several.
CHUNK = 20_000


class Forest:
    """Complete trees of one depth, as arrays by level order: node k has the children 2k+1 and 2k+2."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        self.dim, self.depth = sample.shape[1], max(0, math.ceil(math.log2(max(1, len(sample) / leaf))))
        self.trees, self.leaves, inner = trees, 1 << self.depth, (1 << self.depth) - 1
        self.normals, self.cuts = np.zeros((trees, inner, self.dim)), np.zeros((trees, inner))
        x = vectors.unit(sample) if len(sample) else sample
        for t in range(trees):
            rng, parts = np.random.default_rng([seed, t]), [np.arange(len(x))]
            for k in range(inner):
                own, best = parts[k], (-1.0, None, None)
                for _ in range(TRIED):
                    a, b = rng.integers(0, len(own), 2)
                    v = x[own[a]] - x[own[b]]
                    if not v.any():
                        v = rng.normal(size=self.dim)
                    v /= np.linalg.norm(v)
                    p = x[own] @ v
                    if p.std() > best[0]:
                        best = (p.std(), v, p)
                _, v, p = best
                self.normals[t, k], self.cuts[t, k] = v, np.median(p)
                order = np.argsort(p, kind="stable")
                parts += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows): each row's leaf."""
        x, out = vectors.unit(x), np.zeros((self.trees, len(x)), dtype=np.int64)
        for t in range(self.trees):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + ((x * self.normals[t, at]).sum(axis=1) > self.cuts[t, at])
            out[t] = at - (self.leaves - 1)
        return out

    def search(self, q: np.ndarray, visits: int) -> np.ndarray:
        """Codes tree * leaves + leaf of the leaves that a query visits, nearest branches first, from one queue over all trees."""
        inner = self.leaves - 1
        if not inner:
            return np.arange(self.trees)[:visits]
        margins = ((self.normals.reshape(-1, self.dim) @ q).reshape(self.trees, inner) - self.cuts).tolist()
        queue, out = [(-math.inf, t, 0) for t in range(self.trees)], []
        while queue and len(out) < visits:
            miss, t, k = heapq.heappop(queue)
            row = margins[t]
            while k < inner:
                m = row[k]
                heapq.heappush(queue, (max(miss, abs(m)), t, 2 * k + 1 + (m <= 0)))
                k = 2 * k + 1 + (m > 0)
            out.append(t * self.leaves + k - inner)
        return np.array(out)


def needed(forest: Forest, sample: np.ndarray, top: int = TOP, recall: float = RECALL, probes: int = PROBES) -> int:
    """The least number of visits with which evenly spaced probes find `recall` of their `top` nearest others in the sample; in a denser table neighbours are nearer, and easier to find."""
    x, own = vectors.unit(sample), np.unique(np.linspace(0, len(sample) - 1, min(probes, len(sample))).astype(int))
    leaves = forest.leaf_of(sample) + np.arange(forest.trees)[:, None] * forest.leaves
    best = []
    for q in own:
        near = x @ x[q]
        near[q] = -2
        top_ = np.argpartition(-near, min(top, len(x) - 1))[:top]
        best.append(top_[near[top_] > -2])
    total = forest.trees * forest.leaves
    for visits in (total // 8, total):  # few probes need more than the first
        first = []
        for q, found in zip(own, best, strict=True):
            place, order = np.full(total, total), forest.search(x[q], visits)
            place[order] = np.arange(len(order))
            first += place[leaves[:, found]].min(axis=0).tolist()  # the visit that meets a neighbour first
        most = int(np.quantile(first, recall, method="higher")) if first else 0
        if most < visits:
            break
    return 1 + most


def _prepared(table: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.as_double(table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(vectors.usable(F.col("v")) & F.col("id").isNotNull()), "v")


def nearest(table: DataFrame, is_query: Column, top: int = TOP, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query (on column `id`) selects, its `top` nearest other rows found, by cosine in double precision, ties to smaller ids.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no part; the others must have one length. Rows that repeat an id are one
    candidate each time their vectors differ. Fewer candidates than `top` give fewer rows; an empty table none.
    """
    spark = table.sparkSession
    common.small_batches(spark)
    rows = _prepared(table, key, vector)
    same = Window.partitionBy("v").orderBy("id")
    index = common.written(rows.distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= top + 1).select("id", "v"))
    total = index.count()
    picked = index.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample).collect()  # at most `sample` vectors
    if not picked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = vectors.matrix([r["v"] for r in picked])
    forest = Forest(fitted, trees)
    model = spark.sparkContext.broadcast(forest)  # bounded by the sample
    visits = max(trees, needed(forest, fitted, top, recall))
    shards, chunks = common.partitions(spark), max(1, math.ceil(total / (forest.leaves * CHUNK)))
    queries = rows.where(is_query)
    distinct = queries.groupBy("v").agg(F.min("id").alias("q"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A vector once per shard, with its leaves there."""
        forest = model.value
        for pdf in batches:
            if len(pdf):
                x = vectors.matrix(pdf["v"])
                codes = forest.leaf_of(x) + np.arange(forest.trees)[:, None] * forest.leaves
                at = (codes * chunks + common.mix(pdf["id"].to_numpy().astype(np.uint64)).astype(np.int64) % chunks) % shards
                raw = [v.tobytes() for v in x]
                for s in np.unique(at):
                    hit = at == s
                    own = np.flatnonzero(hit.any(axis=0))
                    yield pd.DataFrame({"shard": int(s), "id": pdf["id"].to_numpy()[own], "v": [raw[i] for i in own], "leaves": [codes[hit[:, i], i].tobytes() for i in own]})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = model.value
        for pdf in batches:
            out = []
            for q, v in zip(pdf["q"], vectors.matrix(pdf["v"]), strict=True):
                codes = forest.search(vectors.unit(v[None])[0], visits)
                at = ((codes[:, None] * chunks + np.arange(chunks)) % shards).ravel()
                codes = np.repeat(codes, chunks)
                for s in np.unique(at):
                    out.append((int(s), q, v.tobytes(), np.unique(codes[at == s]).tobytes()))
            yield pd.DataFrame(out, columns=["shard", "q", "v", "leaves"])

    def rank(have: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(asked):
            return pd.DataFrame({"q": [], "vec_id": [], "score": []})
        x = np.stack([np.frombuffer(v) for v in have["v"]])
        near, ids = vectors.unit(x), have["id"].to_numpy()
        lists = [np.frombuffer(c, dtype=np.int64) for c in have["leaves"]]
        leaf, member = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(c) for c in lists])
        order = np.argsort(leaf, kind="stable")
        leaf, member = leaf[order], member[order]
        out = []
        for q, v, codes in zip(asked["q"], asked["v"], asked["leaves"], strict=True):
            codes, v = np.frombuffer(codes, dtype=np.int64), np.frombuffer(v)
            lo, hi = np.searchsorted(leaf, codes), np.searchsorted(leaf, codes, side="right")
            own = np.unique(np.concatenate([member[a:b] for a, b in zip(lo, hi, strict=True)]))
            if not len(own):
                continue
            rough = near[own] @ vectors.unit(v[None])[0]
            if len(own) > 4 * top + 8:  # then exactly, among those that rounding could put first
                own = own[rough >= np.partition(rough, -(top + 1))[-(top + 1)] - 1e-9]
            score = vectors.cosines(x[own], np.broadcast_to(v, x[own].shape))
            first = np.lexsort((ids[own], -score))[: top + 1]
            out.append(pd.DataFrame({"q": q, "vec_id": ids[own][first], "score": score[first]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "vec_id": [], "score": []})

    placed = index.mapInPandas(place, "shard int, id long, v binary, leaves binary")
    visited = distinct.repartition(common.partitions(spark), "q").mapInPandas(visit, "shard int, q long, v binary, leaves binary")
    found = placed.groupBy("shard").cogroup(visited.groupBy("shard")).applyInPandas(rank, "q long, vec_id long, score double").distinct()
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1).drop("n")
    mine = queries.select("id", "v").distinct().join(distinct, "v").select(F.col("id").alias("query_id"), "q")
    out = mine.join(found, "q").where("vec_id <> query_id")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)

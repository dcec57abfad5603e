"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and \x09 to \x0D, which are also those that bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the folder that driver and executors share (spark.checkpoint.dir); where that is unset, a local one for a local master, and an error for a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='watchgrid-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/watchgrid-{uuid.uuid4().hex}"


def deleted_on_exit(spark: SparkSession, path: str) -> None:
    """Marks an existing folder to be deleted when the driver ends; results may read it until then."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing will read again."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of an Arrow batch between the JVM and a Python worker; either side holds a few of them for each task.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets the session's Python operators run over batches of BATCH_BYTES at most (one row at least), however long the rows are; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, safe against the loss of any executor. With a path of shared_dir() it can be discarded early."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    deleted_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives freed memory back to the system, where the C library can: an idle Python worker would else hold a task's peak while other stages run."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8. Lone surrogates, which Spark never yields, are replaced."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Rows of two ids (16 bytes) that one task or a broadcast takes; larger tables are shuffled.
SMALL_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, a written table of a few ids a row, with a hint to broadcast it if it has no more than SMALL_ROWS rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each component of n nodes with links i to j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of the undirected edges between longs the smallest node that it reaches. Edges with a null end or equal ends are ignored.

    Up to SMALL_ROWS edges are joined in one task. More of them go through alternating large and small stars: every round moves each edge towards the smallest known neighbour, so
    that a round needs two aggregations and joins over at most as many edges as it got; the number of rounds is logarithmic in the longest shortest path. Rounds are cut by
    written tables.
    """
    edges = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct())
    if edges.count() <= SMALL_ROWS:

        def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pdf = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype=np.int64), *batches])
            nodes, at = np.unique(pdf[["u", "v"]].to_numpy().ravel(), return_inverse=True)
            root = roots(len(nodes), at[0::2], at[1::2])
            yield pd.DataFrame({"node": nodes, "component": nodes[root]})

        return edges.coalesce(1).mapInPandas(joined, "node long, component long")
    before = None
    while True:
        both = edges.unionByName(edges.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.where("v > u").join(least, "u").selectExpr("v u", "m v").where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u").selectExpr("explode(array(struct(v as u, m as v), struct(u as u, m as v))) e").selectExpr("e.u", "e.v").where("u <> v").distinct()
        edges = written(near)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now

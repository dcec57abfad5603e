"""Tables that cut a job's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that a broadcast takes; larger tables are shuffled.
SMALL_ROWS = 1_000_000


def deleted_on_exit(spark: SparkSession, path: str) -> None:
    """Marks an existing folder to be deleted when the driver ends; results may read it until then."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the folder that driver and executors share (spark.checkpoint.dir); where that is unset, a local one for a local master, and an error for a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='watchgrid-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/watchgrid-{uuid.uuid4().hex}"


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as literals of the plan: createDataFrame would start a Python worker for every partition of them."""
    types = [x.strip().split(" ") for x in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    cells = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(r, types, strict=True)]) for r in rows])
    return spark.range(1).select(F.inline(cells))


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, whatever is lost later."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    deleted_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df, of a few numbers a row, as a written table, with a hint to broadcast it if it has no more than SMALL_ROWS rows."""
    df = written(df)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df

"""The engine's relations over the driver's tables: the same logs as the readers give, from order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchgrid import model

#: Length of a chunk, and of the window of slow detectors, on these tables.
CHUNK, WINDOW, LEAST_EVENTS = 43_200.0, 21_600.0, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels as one trace on absolute time; seq is the event's id."""
    t = F.col("ts").cast("timestamp").cast("double")
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind = F.expr("CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 5 ELSE CASE WHEN event_id % 2 = 0 THEN 2 ELSE 4 END END")
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), t.alias("t"), (F.col("user_id") % 4).cast("int").alias("agent"), kind.alias("kind"), number.alias("k"), F.col("value").alias("v"))
    target = F.when((F.col("kind") == model.WRITE) & (F.col("k") < 10), F.col("k") % 7).otherwise(7 + F.col("k"))
    value = F.when(F.col("kind") == model.TEST, F.bround("v", 1))
    ev = ev.select("seq", "t", "agent", "kind", target.alias("target"), (F.col("v") * 100).alias("size"), value.alias("value"))
    twin = ev.where("seq % 50 <> 0").withColumn("t", F.col("t") + 0.25)
    unlogged = ev.where("seq % 97 = 0").withColumn("t", F.col("t") + 5.0)
    both = ev.withColumn("chan", F.lit(0)).unionByName(twin.unionByName(unlogged).withColumn("chan", F.lit(1)))
    return both.select(F.lit(0).cast("long").alias("trace_id"), "seq", "t", "agent", "kind", "target", "size", "value", "chan")


def chunks(spark: SparkSession, sf_dir: str, least: int = LEAST_EVENTS) -> DataFrame:
    """The trace cut into chunks of CHUNK seconds with at least `least` reported events."""
    from watchgrid.operators import profile

    return profile.chunked(raw_trace(spark, sf_dir), CHUNK, least)


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes of customers, with snapshots and reviews; some are wrong on purpose."""
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")).cast("double")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", seconds("o_orderdate").alias("t"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("t", "o_orderkey"))
    o = o.withColumn("before", before)
    new = F.col("o_orderkey").cast("string")
    nothing = F.lit(None).cast("string")
    old = F.when(F.col("o_orderkey") % 17 == 0, F.concat(F.lit("x"), F.col("before").cast("string"))).otherwise(F.col("before").cast("string"))
    artifact = F.col("o_custkey").cast("string")
    change = o.select(F.lit("change").alias("type"), "t", artifact.alias("artifact"), old.alias("old"), new.alias("new"), nothing.alias("hash"), nothing.alias("result"), F.lit(0).alias("ord"), F.col("o_orderkey").alias("seq"))
    seen = F.when(F.col("o_orderkey") % 23 == 0, F.concat(F.lit("-"), new)).when(F.col("o_orderkey") % 29 == 0, F.col("before").cast("string")).otherwise(new)
    snap = o.select(F.lit("snapshot").alias("type"), (F.col("t") + 30).alias("t"), artifact.alias("artifact"), nothing.alias("old"), nothing.alias("new"), seen.alias("hash"), nothing.alias("result"), F.lit(2).alias("ord"), F.col("o_orderkey").alias("seq"))
    snap = snap.where("hash IS NOT NULL")
    ship = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(seconds("l_shipdate")).alias("r"))
    reviewed = o.join(ship, o["o_orderkey"] == ship["l_orderkey"])
    what = F.when(F.col("o_orderkey") % 31 == 0, F.concat(F.lit("?"), new)).otherwise(new)
    verdict = F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass")
    review = reviewed.select(F.lit("review").alias("type"), F.greatest("r", F.col("t") + 60).alias("t"), artifact.alias("artifact"), nothing.alias("old"), what.alias("new"), nothing.alias("hash"), verdict.alias("result"), F.lit(1).alias("ord"), F.col("o_orderkey").alias("seq"))
    return change.unionByName(snap).unionByName(review)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as messages to the next speaker, on the time of the events."""
    start = table(spark, sf_dir, "events").agg(F.min(F.col("ts").cast("timestamp").cast("double")).alias("t0"))
    to = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").withColumn("receiver", to).crossJoin(F.broadcast(start))  # one row
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), (F.col("t0") + F.col("conv_id") * 600 + F.col("turn") * 30).alias("t"), F.col("role").alias("sender"), "receiver", "text")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").cast("double").alias("t"), (F.col("user_id") % 4).cast("string").alias("agent"), F.col("event_type").alias("label"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: toxic ones are what a monitor should catch."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return d.join(lab, "doc_id").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("toxic").cast("int").alias("label"))

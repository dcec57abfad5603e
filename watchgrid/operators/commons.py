"""Aggregates that parties can share: linear sketches, commitments, and a code that survives damage."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchgrid import model
from watchgrid.functions import scalars

P61 = (1 << 61) - 1


def coefficients(depth: int = 5, seed: int = 7) -> list[tuple[int, int]]:
    """Hash coefficients of a sketch's rows. Sketches add up only if these agree."""
    number = lambda *k: int.from_bytes(hashlib.md5(":".join(map(str, k)).encode()).digest()[:8], "big")
    return [(number(seed, r, "a") % (P61 - 1) + 1, number(seed, r, "b") % P61) for r in range(depth)]


def columns_of(key: Column, width: int, depth: int, seed: int) -> Column:
    """Array of (row, col) cells of an integer key: ((a * key + b) mod 2^61 - 1) mod width, in decimals of 38 digits."""
    cell = lambda a, b: F.pmod(F.pmod(F.lit(a).cast("decimal(19,0)") * key.cast("decimal(18,0)") + F.lit(b).cast("decimal(19,0)"), F.lit(P61).cast("decimal(19,0)")), F.lit(width).cast("decimal(10,0)")).cast("int")
    return F.array(*[F.struct(F.lit(r).alias("row"), cell(a, b).alias("col")) for r, (a, b) in enumerate(coefficients(depth, seed))])


def sketch(df: DataFrame, key: Column, weight: Column | None = None, width: int = 2048, depth: int = 5, seed: int = 7) -> DataFrame:
    """Count-min sketch as a table (row, col, v): at most width * depth rows. Sketches of parts add up to that of the whole."""
    cells = df.select(F.explode(columns_of(key, width, depth, seed)).alias("c"), (F.lit(1.0) if weight is None else weight).alias("w"))
    return cells.groupBy("c.row", "c.col").agg(F.sum("w").alias("v"))


def merged(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "col").agg(F.sum("v").alias("v"))


def private(sk: DataFrame, eps: float, width: int = 2048, depth: int = 5, seed: int = 1) -> DataFrame:
    """With Laplace noise of scale depth / eps in every cell, also the empty ones. Noise is a function of the cell and the seed; keep that secret."""
    spark = sk.sparkSession
    grid = spark.range(width * depth).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    u = scalars.uniform(F.col("row"), F.col("col"), seed) - 0.5
    noise = -(depth / eps) * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-12)))
    return grid.join(F.broadcast(sk), ["row", "col"], "left").select("row", "col", (F.coalesce("v", F.lit(0.0)) + noise).alias("v"))  # width * depth rows


def estimates(sk: DataFrame, keys: DataFrame, key: str, width: int = 2048, depth: int = 5, seed: int = 7) -> DataFrame:
    """(key, estimate): the least of a key's cells."""
    cells = keys.select(key, F.explode(columns_of(F.col(key), width, depth, seed)).alias("c")).select(key, "c.row", "c.col")
    got = cells.join(F.broadcast(sk), ["row", "col"], "left")  # width * depth rows
    return got.groupBy(key).agg(F.min(F.coalesce("v", F.lit(0.0))).alias("estimate"))


BIN_KEYS = 10_000_000


def control_writes(trace: DataFrame, width: float = 60.0) -> tuple[DataFrame, Column]:
    """Writes to control files, and the sketch key of their class and time bin."""
    rows = trace.where((F.col("chan") == 0) & (F.col("kind") == model.WRITE) & (F.col("target") < model.N_CONTROL))
    return rows, F.col("target").cast("long") * BIN_KEYS + F.floor(F.col("t") / width)


def spikes(sk: DataFrame, start: float, end: float, width: float = 60.0, z: float = 5.0, **shape) -> DataFrame:
    """(class, bin_start, estimate) of cells far above the median of the whole grid of classes and bins, empty ones included."""
    spark = sk.sparkSession
    b0, b1 = int(start // width), int(end // width) + 1
    grid = spark.range(model.N_CONTROL * (b1 - b0)).select(((F.col("id") / (b1 - b0)).cast("long") * BIN_KEYS + F.col("id") % (b1 - b0) + b0).alias("key"))
    est = estimates(sk, grid, "key", **shape)
    med = est.agg(F.percentile("estimate", 0.5).alias("med"))
    mad = est.crossJoin(F.broadcast(med)).agg(F.first("med").alias("med"), F.percentile(F.abs(F.col("estimate") - F.col("med")), 0.5).alias("mad"))  # one row
    out = est.crossJoin(F.broadcast(mad)).where(F.col("estimate") - F.col("med") > z * F.greatest(1.4826 * F.col("mad"), F.lit(1.0)))
    return out.select((F.col("key") / BIN_KEYS).cast("int").alias("class"), ((F.col("key") % BIN_KEYS) * width).cast("double").alias("bin_start"), "estimate")


def commit(secret: bytes, salt: bytes | None = None) -> tuple[str, str]:
    """Digest to publish now, and the salt to reveal later with the secret."""
    salt = os.urandom(16) if salt is None else salt
    return hashlib.sha256(salt + secret).hexdigest(), salt.hex()


def reveals(secret: bytes, salt: str, digest: str) -> bool:
    return hashlib.sha256(bytes.fromhex(salt) + secret).hexdigest() == digest


# ----------------------------------------------------------------------- Hadamard


def codeword(spark, bits: list[int]) -> DataFrame:
    """(i, bit) for all i below 2^n: the parity of the data bits that i selects."""
    mask = sum(b << k for k, b in enumerate(bits))
    return spark.range(1 << len(bits)).select(F.col("id").alias("i"), F.bit_count(F.col("id").bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(1).alias("bit"))


def corrupted(code: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Bits flipped where a hash of their place falls below the share."""
    return code.withColumn("bit", F.when(scalars.uniform(F.col("i"), seed) < share, 1 - F.col("bit")).otherwise(F.col("bit")))


def _pick(name: str, n: int, *keys) -> Column:
    return F.floor(scalars.uniform(*keys, name) * n).cast("long")


def linearity_rejections(code: DataFrame, n_bits: int, trials: int, seed: int = 0) -> DataFrame:
    """Share of random pairs x, y whose bits do not add up to that of x xor y."""
    spark, n = code.sparkSession, 1 << n_bits
    t = spark.range(trials).select(F.col("id"), _pick("x", n, F.col("id"), seed).alias("x"), _pick("y", n, F.col("id"), seed).alias("y")).withColumn("z", F.col("x").bitwiseXOR(F.col("y")))
    for c in "xyz":
        t = t.join(code.select(F.col("i").alias(c), F.col("bit").alias(f"b{c}")), c)
    return t.agg(F.avg((F.col("bx").bitwiseXOR(F.col("by")) != F.col("bz")).cast("double")).alias("rejected"))


def decoded_bits(code: DataFrame, n_bits: int, votes: int = 31, seed: int = 0) -> DataFrame:
    """(k, decoded): each data bit by a vote of pairs of places that differ in it."""
    spark, n = code.sparkSession, 1 << n_bits
    v = spark.range(n_bits * votes).select((F.col("id") / votes).cast("int").alias("k"), _pick("r", n, F.col("id"), seed).alias("r"))
    v = v.withColumn("q", F.col("r").bitwiseXOR(F.expr("shiftleft(1L, k)")))
    a, b = code.select(F.col("i").alias("r"), F.col("bit").alias("br")), code.select(F.col("i").alias("q"), F.col("bit").alias("bq"))
    v = v.join(a, "r").join(b, "q")
    return v.groupBy("k").agg((F.avg(F.col("br").bitwiseXOR(F.col("bq")).cast("double")) > 0.5).cast("int").alias("decoded"))

"""Keyed lineage signatures of parameter vectors.

A vector is a table of chunks (chunk, v array<double>) of CHUNK numbers. Each bit has a random direction, per chunk from a generator seeded by key, chunk and bit; the bit is the
sign of the vector's projection on it. Projections are sums over chunks, so recovery is one pass. Embedding solves for all bits at once: with the directions' Gram matrix (a small
matrix, summed over chunks), one correction brings every projection to its target.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20


def directions(key: bytes, chunk: int, n_bits: int, size: int) -> np.ndarray:
    """(bits, size) rows of unit length."""
    seed = lambda b: int.from_bytes(hashlib.sha256(key + struct.pack(">QQ", chunk, b)).digest()[:8], "big")
    rows = np.stack([np.random.default_rng(seed(b)).standard_normal(size) for b in range(n_bits)])
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-12)


def signs(signature: bytes) -> np.ndarray:
    """+1 or -1 for each bit, the highest of a byte first."""
    return np.unpackbits(np.frombuffer(signature, dtype=np.uint8)).astype(np.int64) * 2 - 1


def signature(n_bytes: int = 16, seed: int | None = None) -> bytes:
    return np.random.default_rng(seed).integers(0, 256, n_bytes, dtype=np.uint8).tobytes()


def projections(vector: DataFrame, key: bytes, n_bits: int) -> DataFrame:
    """(bit, p): the vector's projection on each bit's direction."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, v in zip(pdf["chunk"], pdf["v"], strict=True):
                yield pd.DataFrame({"bit": range(n_bits), "p": directions(key, int(chunk), n_bits, len(v)) @ np.asarray(v, dtype=np.float64)})

    return vector.select("chunk", "v").mapInPandas(project, "bit int, p double").groupBy("bit").agg(F.sum("p").alias("p"))


def embed(vector: DataFrame, key: bytes, sig: bytes, budget: float = 1e-3) -> DataFrame:
    """The vector moved so that every projection has the signature's sign, by about `budget` of its length."""
    want, n_bits = signs(sig), len(sig) * 8

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, v in zip(pdf["chunk"], pdf["v"], strict=True):
                d, x = directions(key, int(chunk), n_bits, len(v)), np.asarray(v, dtype=np.float64)
                yield pd.DataFrame({"p": [(d @ x).tolist()], "g": [(d @ d.T).ravel().tolist()], "s": [float(x @ x)]})

    p, gram, total = np.zeros(n_bits), np.zeros((n_bits, n_bits)), 0.0
    sums = vector.select("chunk", "v").mapInPandas(measure, "p array<double>, g array<double>, s double")
    exploded = sums.select(F.posexplode(F.concat("p", "g", F.array("s"))).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    for r in exploded.collect():  # n_bits * (n_bits + 1) + 1 numbers
        if r["i"] < n_bits:
            p[r["i"]] = r["x"]
        elif r["i"] < n_bits * (n_bits + 1):
            gram.ravel()[r["i"] - n_bits] = r["x"]
        else:
            total = r["x"]
    step = np.linalg.solve(gram + 1e-9 * np.eye(n_bits), want * budget * np.sqrt(total) / n_bits - p)

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, v in zip(pdf["chunk"], pdf["v"], strict=True):
                yield pd.DataFrame({"chunk": [chunk], "v": [(np.asarray(v, dtype=np.float64) + step @ directions(key, int(chunk), n_bits, len(v))).tolist()]})

    return vector.select("chunk", "v").mapInPandas(move, "chunk long, v array<double>")


def verify(vector: DataFrame, key: bytes, sig: bytes, alpha: float = 1e-9) -> dict:
    """How many bits agree, how likely that is by chance (one-sided binomial), and the verdict."""
    want = signs(sig)
    got = {r["bit"]: r["p"] for r in projections(vector, key, len(want)).collect()}  # a number per bit
    agree, n = sum(bool(np.sign(got.get(b, 0.0)) == w) for b, w in enumerate(want)), len(want)
    p = sum(comb(n, k) for k in range(agree, n + 1)) / 2.0**n
    verdict = "confirmed" if p < alpha else "no evidence" if agree <= 0.55 * n else "weak or degraded"
    return {"agree": agree, "n_bits": n, "fraction": agree / n, "p": p, "lineage": verdict}


def read_vector(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """A vector from .npy, .npz (its arrays joined) or raw little-endian float32, read by Spark."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                if name.endswith((".npy", ".npz")):
                    z = np.load(io.BytesIO(raw))
                    x = np.concatenate([np.ravel(z[k]) for k in z.files]) if name.endswith(".npz") else np.ravel(z)
                else:
                    x = np.frombuffer(raw, dtype="<f4")
                for k in range(0, len(x), chunk):
                    yield pd.DataFrame({"chunk": [k // chunk], "v": [x[k : k + chunk].astype(np.float64).tolist()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "chunk long, v array<double>")

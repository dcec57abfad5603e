"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of n-grams up to an order of 2 or 3, unigrams and the uniform distribution are mixed; the weight of each order depends on the frequency bucket of its
context. The weights are learned by expectation-maximisation on counts that were deleted from the model: one training document in HELD is kept out of the counts while the weights
are learned, and put back for scoring. Without a held-out document they stay at UNLEARNED.

Texts are read block by block (the partitions of the scan, cut finer by document where these are large). A block sends its distinct n-gram hashes with their counts, packed per
shard of the hash space; a shard adds up what all blocks have of a hash and answers each block, in the order of its own hashes. Every n-gram thus travels once per block that
holds it, however frequent it is, and a shard gets an even range of all hashes. The answers are written to the shared folder; weights and scores are computed where an answer
meets its block's texts again. Nothing that grows with the corpus comes to the driver: it sees two totals and a weight per bucket.

Hashes have 63 bits: among N distinct n-grams about N^2 / 2^64 pairs share one and count together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm import common
from watchgrid.llm.common import mix

#: One of so many training documents is held out while the weights are learned.
HELD = 10
ROUNDS = 25
BUCKETS = 40
ORDER = 2
#: Weights of the unigrams against the uniform distribution, and of higher orders in any bucket, where nothing was held out.
UNLEARNED = (0.9, 0.5)
#: Bytes of a scan partition that make one block.
BLOCK_BYTES = 5 << 20

_U = np.uint64
_ONE = _U(1)
_END, _START = _U(0x9AE16A3B2F90404E), _U(0xC949D7C7509E6556)


def is_held_out(key: Column) -> Column:
    """Documents that the model never learns from; false for null keys."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 1, F.lit(False))


def _unigram(h: np.ndarray) -> np.ndarray:
    return mix(h) & ~_ONE


def _bigram(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(before) * _U(0x9E3779B97F4A7C15) + h) | _ONE


def _trigram(first: np.ndarray, before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(mix(first) * _U(0xD6E8FEB86659FD93) + before) * _U(0x9E3779B97F4A7C15) + h) | _ONE


_CONTEXT = _unigram(np.array([_START]))[0]


class _Block:
    """The tokens of a block's documents (words, then one end each), and its distinct n-gram keys in ascending order, which is that of the shards."""

    def __init__(self, texts, shards: int, order: int = ORDER):
        import xxhash

        known: dict[bytes, int] = {}  # ids from 2; 0 is the end, 1 the start
        parts = []
        for t in texts:
            tokens = common.words(t)
            for w in set(tokens).difference(known):
                known[w] = len(known) + 2
            ids = np.zeros(len(tokens) + 1, dtype=np.int32)
            ids[:-1] = np.fromiter(map(known.__getitem__, tokens), dtype=np.int32, count=len(tokens))
            parts.append(ids)
        self.sizes = np.array([len(x) for x in parts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        token = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
        before = np.concatenate([[1], token[:-1]]).astype(np.int32)
        before[self.starts[: len(parts)]] = 1
        h = np.empty(len(known) + 2, dtype=_U)
        h[:2] = _END, _START
        h[2:] = np.fromiter(map(xxhash.xxh3_64_intdigest, known), dtype=_U, count=len(known))
        del known, parts
        pair, pairs = pd.factorize(before.astype(np.int64) * len(h) + token)
        keys = [_unigram(h), _bigram(h[pairs // len(h)], h[pairs % len(h)])]
        if order > 2:
            inner = np.ones(len(token), dtype=bool)  # a document's first token has no trigram
            inner[self.starts[: len(self.sizes)]] = False
            first = np.concatenate([[1], before[:-1]]).astype(np.int64)
            three, threes = pd.factorize(first[inner] * len(pairs) + pair[inner])
            behind = pairs[threes % len(pairs)]
            keys.append(_trigram(h[threes // len(pairs)], h[behind // len(h)], h[behind % len(h)]))
        keys = np.concatenate(keys)
        by_key = np.argsort(keys)
        rank = np.empty(len(keys), dtype=np.int32)
        rank[by_key] = np.arange(len(keys), dtype=np.int32)
        self.keys, self.start = keys[by_key], rank[1]
        self.uni, self.bi, self.context = rank[token], rank[len(h) + pair], rank[before]
        self.grams = [(self.bi, self.context)]  # of each order from 2: an n-gram and its context; -1 where there is none
        if order > 2:
            tri, context = np.full((2, len(token)), -1, dtype=np.int64)
            tri[inner], context[inner] = rank[len(h) + len(pairs) + three], self.bi[np.flatnonzero(inner) - 1]
            self.grams.append((tri, context))
        edges = np.array([(i << 64) // shards for i in range(1, shards)], dtype=_U)
        self.cuts = np.concatenate([[0], np.searchsorted(self.keys, edges), [len(keys)]]).astype(np.int64)

    def counts(self, documents: np.ndarray) -> np.ndarray:
        """Of every key in the documents of a mask; the start once a document."""
        mask = np.repeat(documents, self.sizes)
        n = np.bincount(self.uni[mask], minlength=len(self.keys))
        for gram, _ in self.grams:
            own = gram[mask]
            n += np.bincount(own[own >= 0], minlength=len(self.keys))
        n[self.start] += int(documents.sum())
        return n.astype(np.uint32)

    def pieces(self, block: int, *counts: np.ndarray) -> pd.DataFrame:
        """A row for each shard that has keys of the block; counts, if any, are what the block adds to the kept and the held-out part."""
        rows = []
        for k, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            if lo < hi:
                rows.append((k, block, self.keys[lo:hi].tobytes(), *(n[lo:hi].tobytes() for n in counts), *[None] * (2 - len(counts))))
        return pd.DataFrame(rows, columns=["shard", "block", "keys", "kept", "held"])

    def answer(self, pieces: pd.DataFrame) -> np.ndarray:
        """The count of every key, from the rows that the shards sent."""
        n, sent = np.zeros(len(self.keys) + 1), 0  # the last is that of no n-gram
        for shard, raw in zip(pieces["shard"], pieces["n"], strict=True):
            lo, hi = self.cuts[shard], self.cuts[shard + 1]
            n[lo:hi] = np.frombuffer(raw, dtype=np.uint32)
            sent += hi - lo
        if sent != len(self.keys):
            raise ValueError("the input's partitions changed between two reads; write it to a table first")
        return n


def bucket(n: np.ndarray) -> np.ndarray:
    """Frequency bucket of a context: 0 for unseen, else 1 + floor(log2)."""
    return np.minimum(np.where(n > 0, 1 + np.floor(np.log2(np.maximum(n, 1))), 0), BUCKETS - 1).astype(np.int64)


class Model:
    """Deleted interpolation over the documents of `train`, a boolean column of docs. weights has those of each order from 2, by bucket."""

    def __init__(self, docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, order: int = ORDER):
        if order not in (2, 3):
            raise ValueError("the order is 2 or 3")
        self.order = order
        spark = docs.sparkSession
        common.small_batches(spark)
        self.shards = shards = 2 * common.partitions(spark)
        fine = max(1, _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) // BLOCK_BYTES)
        part = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(HELD)) == 0
        rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
        rows = rows.withColumn("held", F.col("train") & F.coalesce(part, F.lit(False)))
        finer = F.coalesce(F.pmod(F.xxhash64("key"), F.lit(fine)), F.lit(0))
        self.rows = rows.withColumn("block", 2 * (F.spark_partition_id().cast("long") * fine + finer))
        answers = common.written(self._count())
        self.totals = {r["block"]: (int(r["n"]), int(r["v"])) for r in answers.where("block < 0").groupBy("block").agg(F.sum("sum").alias("n"), F.sum("kinds").alias("v")).collect()}
        self.answers = answers.where("block >= 0").select("block", "shard", "n")
        self.tokens, self.vocabulary = self.totals.get(-1, (0, 0))
        self.unigram_weight, self.weights = self._learn(rounds)

    def _count(self) -> DataFrame:
        """(block, shard, n) with the counts of the block's keys in a shard: of all training documents for even blocks, whose documents are to be scored; of the kept part for odd
        ones, which are the held-out documents of the even block before. Totals, of both kinds, have the blocks -1 and -2."""
        shards, order = self.shards, self.order

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            texts: dict[int, list] = {}
            for pdf in batches:
                for b, own in pdf.groupby("block"):
                    texts.setdefault(b, []).append(own)
            for b in sorted(texts):
                own = pd.concat(texts.pop(b))
                block = _Block(own["text"], shards, order)
                train, held = own["train"].to_numpy(dtype=bool), own["held"].to_numpy(dtype=bool)
                yield block.pieces(b, block.counts(train & ~held), block.counts(held))
                del block
                if held.any():
                    yield _Block(own["text"][held], shards, order).pieces(b + 1)
            common.release()

        def add(pieces: pd.DataFrame) -> pd.DataFrame:
            at, keys = pd.factorize(np.concatenate([np.frombuffer(x, dtype=_U) for x in pieces["keys"]]))
            ends = np.cumsum([len(x) // 8 for x in pieces["keys"]])
            own = [at[e - len(x) // 8 : e] for e, x in zip(ends, pieces["keys"], strict=True)]
            total = {c: np.zeros(len(keys), dtype=np.int64) for c in ("kept", "held")}
            for c, n in total.items():
                for a, raw in zip(own, pieces[c], strict=True):
                    if raw is not None:
                        n[a] += np.frombuffer(raw, dtype=np.uint32)  # a block has a key once
            n = [total["kept"] + total["held"], total["kept"]]
            small = [np.minimum(x, 0xFFFFFFFF).astype(np.uint32) for x in n]
            rows = [(b, s, small[b % 2][a].tobytes(), 0, 0) for b, s, a in zip(pieces["block"], pieces["shard"], own, strict=True)]
            words = (keys & _ONE == 0) & (keys != _CONTEXT)
            rows += [(-1 - k, int(pieces["shard"].iloc[0]), b"", int(x[words].sum()), int((x[words] > 0).sum())) for k, x in enumerate(n)]
            del at, own, keys, total, n, small, words
            common.release()
            return pd.DataFrame(rows, columns=["block", "shard", "n", "sum", "kinds"])

        sent = self.rows.select("block", "text", "train", "held").mapInPandas(send, "shard int, block long, keys binary, kept binary, held binary")
        return sent.groupBy("shard").applyInPandas(add, "block long, shard int, n binary, sum long, kinds long")

    def _learn(self, rounds: int) -> tuple[float, list[list[float]]]:
        """The unigram's weight against the uniform distribution, and those of higher orders by bucket, from the held-out part's counts under a model of the kept part."""
        shards, order, (total, kinds) = self.shards, self.order, self.totals.get(-2, (0, 0))
        columns = [c for k in range(2, order + 1) for c in (f"c{k}", f"x{k}")]  # counts of the n-gram and of its context

        def outcomes(_, texts: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
            if not len(texts):
                return pd.DataFrame({c: [] for c in (*columns, "word", "n")})
            block = _Block(texts["text"], shards, order)
            kept = block.answer(pieces)
            rows = np.stack([kept[x] for both in block.grams for x in both] + [kept[block.uni]], axis=1).astype(np.int64)
            rows, n = np.unique(rows, axis=0, return_counts=True)
            return pd.DataFrame(rows, columns=[*columns, "word"]).assign(n=n)

        blocks = self.rows.where("held").select((F.col("block") + 1).alias("block"), "text").groupBy("block").cogroup(self.answers.where("block % 2 = 1").groupBy("block"))
        seen = blocks.applyInPandas(outcomes, ", ".join(f"{c} long" for c in (*columns, "word", "n")))
        seen = common.written(seen.groupBy(*columns, "word").agg(F.sum("n").alias("n")))
        f1, uniform = F.col("word") / F.lit(float(max(total, 1))), 1.0 / (kinds + 1)
        words = common.written(seen.groupBy("word").agg(F.sum("n").alias("n")))
        mu = UNLEARNED[0]
        for _ in range(rounds):
            share = F.lit(mu) * f1 / (F.lit(mu) * f1 + F.lit((1 - mu) * uniform))
            got, n = words.agg(F.sum(F.col("n") * share), F.sum("n")).first()
            new = min(max((got or 0) / n, 1e-6), 1 - 1e-6) if n else mu
            done, mu = abs(new - mu) < 1e-5, new
            if done:
                break
        p, weights = F.lit(mu) * f1 + F.lit((1 - mu) * uniform), []
        for k in range(2, order + 1):
            context = F.col(f"x{k}")
            b = F.when(context > 0, F.least(F.floor(F.log2(context)) + 1, F.lit(BUCKETS - 1))).otherwise(0).cast("int")
            own = common.written(seen.select(b.alias("b"), "n", F.when(F.col(f"c{k}") > 0, F.col(f"c{k}") / context / p).alias("r")).where("b > 0"))
            weights.append(_interpolated(own, rounds))
            lam = F.element_at(F.array(*[F.lit(x) for x in weights[-1]]), b + 1)
            p = lam * F.col(f"c{k}") / F.greatest(context, F.lit(1)) + (1 - lam) * p
        return (mu if self.tokens else 0.0), weights  # nothing seen at all: the uniform distribution

    def score(self, extra: Column | None = None) -> DataFrame:
        """One row per document row: key, extra, n_tokens, n_known, train_tokens, base_score, score (log10)."""
        shards, order, total, kinds, mu, weights = self.shards, self.order, self.tokens, self.vocabulary, self.unigram_weight, np.array(self.weights)

        def scores(_, texts: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
            if not len(texts):
                return pd.DataFrame({c: [] for c in ("key", "extra", "n_tokens", "n_known", "train_tokens", "base_score", "score")})
            block = _Block(texts["text"], shards, order)
            n = block.answer(pieces)
            word = n[block.uni]
            base = np.log10((word + 0.5) / (total + 0.5 * (kinds + 1)))
            p = mu * word / max(total, 1) + (1 - mu) / (kinds + 1)
            for (gram, context), w in zip(block.grams, weights, strict=True):
                lam = w[bucket(n[context])]
                p = lam * n[gram] / np.maximum(n[context], 1) + (1 - lam) * p
            add = lambda x: np.add.reduceat(x, block.starts)  # noqa: E731  every document has its end
            out = {"n_tokens": block.sizes, "n_known": add((word > 0).astype(np.int64)), "train_tokens": total, "base_score": add(base), "score": add(np.log10(p))}
            del block, n, word, base, p, lam
            common.release()
            return texts[["key", "extra"]].reset_index(drop=True).assign(**out)

        rows = self.rows.withColumn("extra", F.lit(None).cast("boolean") if extra is None else extra).select("block", "key", "text", "extra")
        kind = rows.schema["key"].dataType.simpleString()
        return rows.groupBy("block").cogroup(self.answers.where("block % 2 = 0").groupBy("block")).applyInPandas(scores, f"key {kind}, extra boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _interpolated(seen: DataFrame, rounds: int) -> list[float]:
    """Weights by bucket from rows (b, n, r): n tokens in a bucket, r how many times likelier the n-gram finds them than the lower orders; null for never. Only n-grams that the kept
    part has seen can be the higher order's work. Buckets without evidence take their neighbour's weight."""
    ratio = common.written(seen.where("r IS NOT NULL"))
    of = {r["b"]: r["n"] for r in seen.groupBy("b").agg(F.sum("n").alias("n")).collect()}  # a row per bucket
    weights = [0.0] + [UNLEARNED[1]] * (BUCKETS - 1)
    for _ in range(rounds):
        lam = F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("b") + 1)
        got = {r["b"]: r["s"] for r in ratio.groupBy("b").agg(F.sum(F.col("n") * lam * F.col("r") / (lam * F.col("r") + 1 - lam)).alias("s")).collect()}
        new = [0.0] + [min(max(got.get(i, 0.0) / of[i], 1e-6), 1 - 1e-6) if i in of else None for i in range(1, BUCKETS)]
        for i in range(1, BUCKETS):
            new[i] = new[i] if new[i] is not None else (new[i - 1] if i > 1 else UNLEARNED[1])
        done, weights = max(abs(x - y) for x, y in zip(weights, new, strict=True)) < 1e-4, new
        if done:
            break
    return weights


def _bytes(text: str) -> int:
    digits = text.rstrip("bBkKmMgGtT")
    unit = text[len(digits) :].lower().rstrip("b")
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document row.

    Null and empty texts have one token, the end. A null key is never held out. Repeated rows count and are scored each. Without training documents all scores are those of
    the uniform distribution over one token. docs must read alike twice, as a table does. Other columns are ignored.
    """
    held = is_held_out(F.col(key))
    model = Model(docs, ~held, key, text, order=order)
    out = model.score(is_held_out(F.col("key")))
    return out.select(F.col("key").alias(key), F.col("extra").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents"))

"""Exact n-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document is its set of distinct word shingles, as 64-bit hashes. Sets that can be similar differ in at most H elements, H depending on the size band of the larger one. The
universe of hashes is cut into m equal ranges, the segments; a pair within H then agrees on many segments, or differs by one element in some:

* an exact segment, whose subset is indexed as one signature, accounts for one difference;
* a one-deletion segment, indexed by its subset and by its subset without each element, accounts for two.

Per size band the numbers of both are chosen to the least estimated cost, signatures written plus the expected collisions of small subsets (`allocate`). Exact bands get some
segments more than the pigeonhole needs; each set then leaves out as many of its smallest, hence most colliding, subsets. Both sides of a pair rank an equal subset alike (by
its size and segment), so the last equal one in that order is never left out by either: no pair is lost.

Signatures travel as packed arrays, one row per input block and shard, and meet in shards. Equal sets are one class from the start, so copies cost nothing. Classes that share
a signature form a bucket; pairs of a bucket are tested first by a parity bitmap, whose Hamming distance never exceeds the sets' difference, then by a wider one, then exactly.
Only connectivity is asked for, so large buckets are joined by stars around a central set and verified in rounds, in each of which one pair of every set goes first and then those
that still lie in two components; a round takes up the buckets that hold several components, with ever more pairs, until no untested pair of two components remains. The result
is that of testing all pairs.

Node ids are 64-bit hashes of whole sets: two different sets among N have the same id with probability N^2 / 2^65.
"""

from __future__ import annotations

import functools
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm import common
from watchgrid.llm.common import mix

WORDS = 5
#: Similarity of 0.8 as a fraction: two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: Cost of one expected collision of a small subset against one written signature.
COLLISION_COST = 50.0
BITMAP = 1024
#: Signatures that a task holds before it packs them.
PIECE_SIGNATURES = 1_000_000
SMALL_BUCKET = 3
#: Members of a larger bucket that may become its centre; a centre needs this share of the best one's reach.
TRIED, REACH = 24, 0.9

_U = np.uint64


# ---------------------------------------------------------------- shingle sets


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes; words are hashed once and kept up to a bounded number."""

    def __init__(self, n: int = WORDS, keep: int = 150_000):
        import xxhash

        self.n, self.keep, self.hash, self.known = n, keep, xxhash.xxh3_64_intdigest, {}
        self.factors = mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)  # without small linear relations, as words repeat

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = common.words(text)
        if not tokens:
            return np.empty(0, dtype=_U)
        known, h = self.known, self.hash
        if len(known) > self.keep:
            known.clear()
        for t in set(tokens):
            if t not in known:
                known[t] = h(t)
        w = np.fromiter((known[t] for t in tokens), dtype=_U, count=len(tokens))
        k = min(self.n, len(w))
        total = np.zeros(len(w) - k + 1, dtype=_U)
        for i in range(k):
            total += mix(w[i : len(w) - k + 1 + i]) * self.factors[i]
        return np.unique(mix(total + _U(k)))  # short texts: one shingle of their own length


def node_id(shingles: np.ndarray) -> int:
    """Of a set; 0 only for the empty one."""
    if not len(shingles):
        return 0
    with np.errstate(over="ignore"):
        total = mix(shingles ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) * _U(3) + _U(len(shingles))
        return int(mix(np.array([total]))[0] | _U(1)) - (1 << 63)


def differ(size):
    """Most elements in which two similar sets differ when their sizes sum to `size` (numbers or arrays): intersection >= NUM * size / (NUM + DEN). It does not grow steadily."""
    return size - 2 * -(-NUM * size // (NUM + DEN))


# ------------------------------------------------------- bands and allocation


@functools.cache
def bands() -> tuple[int, ...]:
    """Lower ends of the size bands; sizes in one band differ by a factor of at most DEN / NUM."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * DEN // NUM + 1))
    return tuple(out)


def band_of(n: int) -> int:
    return bisect_right(bands(), n) - 1


@functools.cache
def allocate(band: int) -> tuple[int, int, int, int]:
    """(H, one-deletion segments, exact segments, of these left out) of the least cost for sets whose larger one is in the band."""
    lo, hi = bands()[band], bands()[band + 1] - 1
    most = max(differ(s) for s in (2 * hi, 2 * hi - 1))
    options = []
    for ones in {0, (most + 1) // 4, (most + 1) // 2, -(-(most + 1) // 2)}:
        exact = max(0, most + 1 - 2 * ones)
        for spare in {round(exact * k / 20) for k in range(0, 13)}:
            m = ones + exact + spare
            a = lo / m
            small = (1 + a) * math.exp(-a)  # share of subsets with at most one element
            rows = ones * (1 + a) + exact
            hot = ones * (1 + a) * (1 + a + a * a / 2) * math.exp(-a) + max(0.0, small * (exact + spare) - spare)
            options.append((rows + COLLISION_COST * hot, m, ones, exact + spare, spare))
    _, _, ones, exact, spare = min(options)
    return most, ones, exact, spare


@functools.cache
def _edges(m: int) -> np.ndarray:
    return np.array([(i << 64) // m for i in range(1, m)], dtype=_U)


def signatures(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a sorted set for all bands in which it can be a member of a similar, different pair; and whether each is of a whole subset."""
    n, out, whole = len(s), [], []
    if not n:
        return np.empty(0, dtype=_U), np.empty(0, dtype=bool)
    e = mix(s + _U(0x632BE59BD9B4E019))
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(e, out=sums[1:])
    for band in range(band_of(n), band_of(n * DEN // NUM) + 1):
        most, ones, exact, spare = allocate(band)
        if not most:
            continue  # only equal sets are similar
        m = ones + exact
        ends = np.concatenate([[0], np.searchsorted(s, _edges(m)), [n]]) if m > 1 else np.array([0, n])
        tag = mix(np.arange(m, dtype=_U) + _U(band << 32))
        subset = sums[ends[1:]] - sums[ends[:-1]]
        keep = np.arange(ones, m)
        if spare:
            sizes = np.diff(ends)[ones:]
            keep = keep[np.argsort(sizes, kind="stable")[spare:]]
        out.append(mix((subset + tag)[keep]))
        whole.append(np.ones(len(keep), dtype=bool))
        if ones:
            out.append(mix((subset + tag)[:ones]))
            whole.append(np.ones(ones, dtype=bool))
            k = int(ends[ones])
            of = np.repeat(np.arange(ones), np.diff(ends[: ones + 1]))
            out.append(mix((subset + tag)[of] - e[:k]))
            whole.append(np.zeros(k, dtype=bool))
    return (np.concatenate(out), np.concatenate(whole)) if out else (np.empty(0, dtype=_U), np.empty(0, dtype=bool))


def bitmap(s: np.ndarray) -> bytes:
    return np.packbits((np.bincount((mix(s) & _U(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1).astype(np.uint8)).tobytes()


def wide(s: np.ndarray) -> bytes:
    """A bitmap that grows with the set, to four bits an element or more."""
    bits = 1 << max(6, (4 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((mix(s) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


# ------------------------------------------------------------------- operator


def indexed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One pass over the texts, written: a row per document batch with packed (key, n, node, bitmap), and a row per bucket with its id and packed nodes.

    A bucket has the nodes that share a signature, for signatures that several nodes have, at least one of them with a whole subset. Equal lists of nodes may come up in several
    shards; they have one id.
    """
    common.small_batches(docs.sparkSession)
    shards = common.partitions(docs.sparkSession)
    columns = ["shard", "ids", "sigs", "at", "keys", "maps"]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler()
        nodes, sigs, owner, seen, held = [], [], [], set(), 0

        def packed() -> pd.DataFrame:
            sig, at = np.concatenate(sigs), np.concatenate(owner)
            order = np.argsort(sig)
            sig, at = sig[order], at[order]
            cuts = np.concatenate([[0], np.searchsorted(sig, _edges(shards)), [len(sig)]]) if shards > 1 else np.array([0, len(sig)])
            ids, rank, out = np.array(nodes, dtype=np.int64), np.zeros(len(nodes), dtype=np.uint32), []
            for k in range(shards):
                if cuts[k] < cuts[k + 1]:
                    part = at[cuts[k] : cuts[k + 1]]
                    used = np.unique(part >> np.uint32(1))
                    rank[used] = np.arange(len(used), dtype=np.uint32)
                    local = (rank[part >> np.uint32(1)] << np.uint32(1)) | (part & np.uint32(1))
                    out.append((k, ids[used].tobytes(), sig[cuts[k] : cuts[k + 1]].tobytes(), local.tobytes(), None, None))
            return pd.DataFrame(out, columns=columns)

        for pdf in batches:
            if not len(pdf):
                continue
            own, sizes, maps = [], [], []
            for t in pdf["text"]:
                s = shingle(t)
                node = node_id(s)
                own.append(node)
                sizes.append(len(s))
                maps.append(bitmap(s))
                if node not in seen and len((got := signatures(s))[0]):
                    seen.add(node)
                    owner.append(np.full(len(got[0]), len(nodes) << 1, dtype=np.uint32) | got[1])
                    nodes.append(node)
                    sigs.append(got[0])
                    held += len(got[0])
            keys = np.stack([pdf["key"].to_numpy(dtype=np.int64), pdf["has"].to_numpy(dtype=np.int64)])
            yield pd.DataFrame([(own[0] % shards, np.array(own, dtype=np.int64).tobytes(), None, np.array(sizes, dtype=np.int64).tobytes(), keys.tobytes(), b"".join(maps))], columns=columns)
            if held >= PIECE_SIGNATURES:
                yield packed()
                nodes, sigs, owner, seen, held = [], [], [], set(), 0
        if held:
            yield packed()
        del nodes, sigs, owner, seen, shingle
        common.release()

    def meet(pieces: pd.DataFrame) -> pd.DataFrame:
        told = pieces[pieces["sigs"].isna()][["ids", "at", "keys", "maps"]]
        pieces = pieces[~pieces["sigs"].isna()]
        if not len(pieces):
            return told.assign(bucket=None)
        sig = np.concatenate([np.frombuffer(x, dtype=_U) for x in pieces["sigs"]])
        at, node = [], []
        for ids, x in zip(pieces["ids"], pieces["at"], strict=True):
            local = np.frombuffer(x, dtype=np.uint32)
            at.append((local & np.uint32(1)).astype(bool))
            node.append(np.frombuffer(ids, dtype=np.int64)[local >> np.uint32(1)])
        whole, node = np.concatenate(at), np.concatenate(node)
        order = np.argsort(sig)
        sig = sig[order]
        same = np.concatenate([sig[1:] == sig[:-1], [False]])
        some = same | np.concatenate([[False], same[:-1]])
        sig, order = sig[some], order[some]
        node, whole = node[order], whole[order]
        order = np.lexsort((node, sig))
        sig, node, whole = sig[order], node[order], whole[order]
        lists = set()
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, dtype=np.int64)
        for a, b in zip(starts, [*starts[1:], len(sig)], strict=False):  # no shared signature: no starts
            own = node[a:b]
            if own[0] != own[-1] and whole[a:b].any():
                lists.add(own[np.concatenate([[True], own[1:] != own[:-1]])].tobytes())
        found = [(x, hash_of(x)) for x in lists]
        del sig, node, whole, order, at, pieces
        common.release()
        return pd.concat([told.assign(bucket=None), pd.DataFrame({"ids": [x for x, _ in found], "at": None, "keys": None, "maps": None, "bucket": [h for _, h in found]})])

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"), F.col(key).isNotNull().alias("has"), F.col(text).alias("text"))
    pieces = rows.mapInPandas(index, "shard int, ids binary, sigs binary, at binary, keys binary, maps binary")
    return common.written(pieces.groupBy("shard").applyInPandas(meet, "ids binary, at binary, keys binary, maps binary, bucket long"))


def hash_of(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _documents(index: DataFrame) -> DataFrame:
    """(key, n_shingles, node, bitmap) per document of an index."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, at, keys, maps in zip(pdf["ids"], pdf["at"], pdf["keys"], pdf["maps"], strict=True):
                key, has = np.frombuffer(keys, dtype=np.int64).reshape(2, -1)
                n = np.frombuffer(at, dtype=np.int64)
                step = BITMAP // 8
                yield pd.DataFrame({"key": pd.arrays.IntegerArray(key.copy(), has == 0), "n_shingles": n, "node": np.frombuffer(ids, dtype=np.int64), "bitmap": [maps[step * i : step * i + step] for i in range(len(n))]})

    return index.where("keys IS NOT NULL").select("ids", "at", "keys", "maps").mapInPandas(rows, "key long, n_shingles long, node long, bitmap binary")


def _members(index: DataFrame) -> DataFrame:
    """(bucket, node) of an index."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [np.frombuffer(x, dtype=np.int64) for x in pdf["ids"]]
            if own:
                yield pd.DataFrame({"bucket": np.repeat(pdf["bucket"].to_numpy(), [len(x) for x in own]), "node": np.concatenate(own)})

    return index.where("keys IS NULL").select("bucket", "ids").dropDuplicates(["bucket"]).mapInPandas(rows, "bucket long, node long")


def _whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups of a stream sorted by key."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut or (rest and rest[0][key].iloc[-1] != k[-1]):
            yield pd.concat([*rest, pdf.iloc[:cut]], ignore_index=True)
            rest = []
        rest.append(pdf.iloc[cut:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def pairs_of(members: DataFrame, most: int) -> DataFrame:
    """(a, b) with a < b: pairs of a bucket in different components whose sizes and bitmaps allow similarity; and (bucket, null) for buckets that may have more of them.

    A bucket of up to SMALL_BUCKET members gives all such pairs. A larger one gives a star around a central member, one of the first few, when `most` is 0, else for each member outside
    its largest component up to `most` such members of other components, the nearest first.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches, "bucket"):
            bucket, node, label, n = (pdf[c].to_numpy() for c in ("bucket", "node", "label", "n"))
            maps = np.frombuffer(b"".join(pdf["bitmap"]), dtype=np.uint64).reshape(len(pdf), -1)
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.concatenate([starts[1:], [len(bucket)]])
            two = starts[ends - starts == 2]
            left, right, more = [two], [two + 1], []
            for a, b in zip(starts, ends, strict=True):
                g, own = b - a, np.arange(a, b)
                if g < 3 or (label[a:b] == label[a]).all():
                    continue
                if g <= SMALL_BUCKET:
                    i, j = np.triu_indices(g, 1)
                    left.append(a + i)
                    right.append(a + j)
                elif not most:
                    more.append(bucket[a])
                    # Members are in the order of their ids, so that buckets of one group try the same few and mostly take the same: the first that reaches nearly as many as any.
                    reach = [int((_distance(maps[own], maps[t]) <= differ(2 * int(n[t]))).sum()) for t in own[:TRIED]]
                    left.append(np.full(g, a + next(i for i, x in enumerate(reach) if x >= REACH * max(reach))))
                    right.append(own)
                else:  # a pair of two components has a member outside the largest one
                    names, counts = np.unique(label[a:b], return_counts=True)
                    for x in own[label[a:b] != names[int(np.argmax(counts))]]:
                        others = own[label[a:b] != label[x]]
                        d = _distance(maps[others], maps[x])
                        near = d <= differ(n[others] + n[x])
                        others, d = others[near], d[near]
                        if len(others) > most:
                            more.append(bucket[a])
                            others = others[np.argsort(d, kind="stable")[:most]]
                        left.append(np.full(len(others), x))
                        right.append(others)
            i, j = np.concatenate(left), np.concatenate(right)
            limit = differ(n[i] + n[j])
            ok = (label[i] != label[j]) & (np.abs(n[i] - n[j]) <= limit)
            i, j, limit = i[ok], j[ok], limit[ok]
            ok = np.concatenate([_distance(maps[i[k : k + 50_000]], maps[j[k : k + 50_000]]) <= limit[k : k + 50_000] for k in range(0, len(i), 50_000)]) if len(i) else np.empty(0, dtype=bool)
            i, j = i[ok], j[ok]
            a = np.concatenate([np.minimum(node[i], node[j]), np.array(more, dtype=np.int64)])
            b = pd.arrays.IntegerArray(np.concatenate([np.maximum(node[i], node[j]), np.zeros(len(more), dtype=np.int64)]), np.arange(len(a)) >= len(i))
            yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    n = common.partitions(members.sparkSession)
    return members.repartition(n, "bucket").sortWithinPartitions("bucket", "node").mapInPandas(pairs, "a long, b long").distinct()


def first_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs: for each node that with its smallest partner. They join most of what all pairs join, and meet around the same partners."""
    both = pairs.unionByName(pairs.selectExpr("b AS a", "a AS b"))
    return both.groupBy("a").agg(F.min("b").alias("b")).selectExpr("least(a, b) a", "greatest(a, b) b").distinct()


def apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Those of pairs whose ends have different labels (node, component)."""
    if labels is None:
        return pairs
    labels = common.small(labels)
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left")
    return pairs.where("a_in IS NULL OR b_in IS NULL OR a_in <> b_in").select("a", "b")


def _met(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """(a, b, x, y, p, q): pairs with a column of their sets and the sets' sizes. What b has goes to a, whose own travels once. A small number of pairs meets b without a shuffle."""
    pairs = common.small(pairs)
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col(column).alias("y"), F.col("n").alias("q")), "b")
    other = sets.join(pairs.select(F.col("a").alias("node")), "node", "left_semi").select(F.col("node").alias("a"), F.col(column).alias("x"), F.col("n").alias("p"))
    return one.join(other, "a").select("a", "b", "x", "y", "p", "q")


def close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs whose wide bitmaps allow similarity: nearly only similar ones, for a sixteenth of the bytes of whole sets."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y, p, q in zip(pdf["x"], pdf["y"], pdf["p"], pdf["q"], strict=True):
                x, y = (np.frombuffer(v, dtype=np.uint64) for v in (x, y))
                while len(x) != len(y):  # the larger is folded: halves of a parity bitmap add up to that of half the size
                    x, y = sorted((x, y), key=len)
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                ok.append(int(np.bitwise_count(x ^ y).sum()) <= differ(p + q))
            yield pdf.loc[ok, ["a", "b"]]

    return _met(pairs, sets, "wide").mapInPandas(test, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs that are similar, by exact intersection of the sets."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            linked = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                s, t = np.frombuffer(x, dtype=_U), np.frombuffer(y, dtype=_U)
                both = len(np.intersect1d(s, t, assume_unique=True))
                linked.append(DEN * both >= NUM * (len(s) + len(t) - both))
            yield pdf.loc[linked, ["a", "b"]]

    return _met(pairs, sets, "shingles").mapInPandas(test, "a long, b long")


def shingle_sets(docs: DataFrame, nodes: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(node, n, shingles, wide bitmap) for rows (node, key) of documents that have these sets, written to the path. Sets may come up more than once."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler()
        for pdf in batches:
            sets = [shingle(t) for t in pdf["text"]]
            out = pd.DataFrame({"node": pdf["node"], "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets], "wide": [wide(s) for s in sets]})
            yield out[[node_id(s) == node for s, node in zip(sets, pdf["node"], strict=True)]]  # rows with equal keys may differ in their texts

    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    found = texts.join(common.small(nodes), "key").select("node", "text").mapInPandas(scan, "node long, n long, shingles binary, wide binary")
    return common.written(found, path)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) per document row: the size of its set and the smallest key that its links reach.

    Null and empty texts, and those without words, have an empty set, link with nothing and are components of their own. Repeated rows and rows with equal sets are linked.
    Keys must be integers and should be unique; a row with a null key has links only if a row with the same set has a key, and a null component otherwise. Other columns are
    ignored; texts are used whole.
    """
    spark = docs.sparkSession
    index = indexed(docs, key, text)
    documents = _documents(index)
    found = common.written(documents.drop("bitmap"))
    known = common.written(documents.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bitmap").alias("bitmap"), F.min("key").alias("key")))  # a row per distinct set
    members = _members(index)
    links = labels = tested = None
    open_ = members.withColumn("label", F.col("node"))
    for most in (0, 64, 1 << 60):
        new = common.written(pairs_of(open_.join(known.drop("key"), "node"), most))
        pairs = new.where("b IS NOT NULL")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = common.written(pairs)
        ends = common.written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        nodes = common.written(known.where("key IS NOT NULL").select("node", "key").join(common.small(ends), "node", "left_semi"))
        if not nodes.isEmpty():
            sets = shingle_sets(docs, nodes, key, text, path := common.shared_dir(spark))
            near = common.written(close(pairs, sets))
            for some in (first_pairs, lambda rest: apart(rest, labels)):  # then what these leave in different components
                some = common.written(some(near))
                if some.isEmpty():
                    continue
                linked = common.written(verified(some, sets))
                if not linked.isEmpty():
                    links = linked if links is None else links.unionByName(linked)
                    labels = common.written(common.components(links))
            common.discard(spark, path)
            tested = pairs if tested is None else tested.unionByName(pairs)
        more = new.where("b IS NULL").select(F.col("a").alias("bucket"))
        if more.isEmpty():
            break
        open_ = members.join(more, "bucket", "left_semi")
        open_ = open_.withColumn("label", F.col("node")) if labels is None else open_.join(common.small(labels), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
        open_ = common.written(open_)
        mixed = open_.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
        open_ = open_.join(mixed, "bucket", "left_semi")
    # The smallest key of each node's component is written, so that joins of many copies, or of a large component, are plain shuffles that Spark splits where they are skewed.
    least = known.select("node", "key")
    if labels is not None:
        few = common.small(labels)
        keys = common.written(least.join(few, "node").groupBy("component").agg(F.min("key").alias("least")))
        reached = common.written(labels.join(common.small(keys), "component").select("node", "least"))
        least = least.join(common.small(reached), "node", "left").select("node", F.coalesce("least", "key").alias("key"))
    least = common.written(least.select("node", F.col("key").alias("least")))
    out = found.join(least, "node", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.read(spark, sf_dir, "documents"))


#: Words are runs of characters other than space and \x09 to \x0D, so that joined shingles are equal only if their words are.
SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM t
),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
k AS (SELECT a, min(c) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, k.component_id FROM s JOIN k ON k.a = s.doc_id
"""

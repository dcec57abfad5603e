"""SentencePiece encoding and decoding by suffix-array matching.

The distinct chunks of a batch (no piece reaches over the border of two chunks) are concatenated into one text, which is indexed by a suffix array: suffixes sorted by as many
characters as the longest piece has. Every piece is binary-searched for the range of its occurrences; the ranges give the edges (position, length, piece), sorted by position.
Relaxation then runs over all chunks at once. For unigram models it is the shortest path: positions in turn take their best incoming edge. For BPE models an edge from i to j
stands for the merge of two neighbouring symbols that cover i to j; each round applies the best-scored merge of every chunk, leftmost first among equals, until no neighbours
have an edge over both. Both give the ids of the model's own library. Characters that no piece covers fall back to bytes.

A model is read on the driver, whose path is a parameter, and goes to the tasks by value (half a megabyte).
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of distinct chunks that are matched at a time, occurrences of pieces that are placed at a time, chunks that a task remembers, and the longest chunk that is relaxed
#: along with all others. A single chunk is never cut: it takes some 250 bytes a character.
BATCH_CHARS, EDGES, REMEMBERED, LONG = 200_000, 200_000, 200_000, 48

_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Model:
    """Pieces of a SentencePiece model (BPE or unigram) that splits at white space and doesn't normalise."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(raw)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that normalise their input are not supported")
        self.bpe, self.prefix = proto.trainer_spec.model_type == 2, spec.add_dummy_prefix
        kinds = proto.SentencePiece
        self.text = [p.piece for p in proto.pieces]
        self.scores = np.array([p.score for p in proto.pieces])
        normal = [i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN), 0)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        if any(SPACE in self.text[i].lstrip(SPACE) for i in normal):
            raise ValueError("pieces that reach over a space are not supported")
        self.longest = max((len(self.text[i]) for i in normal), default=1)
        self.id_of = {self.text[i]: i for i in normal}
        # Characters of pieces, by ascending code point, as 1, 2, ...; all others are 0.
        self.alphabet = np.array(sorted({ord(c) for i in normal for c in self.text[i]}), dtype=np.uint32)
        self.normal = np.array(normal, dtype=np.int32)
        self.lengths = np.array([len(self.text[i]) for i in normal], dtype=np.int64)
        flat = self._codes("".join(self.text[i] for i in normal))
        starts = np.cumsum(self.lengths) - self.lengths
        self.rows = np.zeros((len(normal), self.longest), dtype=np.int64)
        for k in range(self.longest):
            has = self.lengths > k
            self.rows[has, k] = flat[starts[has] + k]
        self.worst = float(self.scores[normal].min()) - 10.0 if normal else -10.0

    def _codes(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        if not len(self.alphabet):
            return np.zeros(len(c), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, c), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == c, at + 1, 0).astype(np.int64)

    # ---------------------------------------------------------------- matching

    def edges(self, text: str, starts: np.ndarray) -> np.ndarray:
        """(positions, longest) table: id of the piece of length k + 1 that starts at a position, or -1. No edge leaves the chunk (starting at `starts`) that it begins in."""
        codes = self._codes(text)
        # Only characters of this text matter, and pieces made of them: they are renumbered in order, so that more of them fit into a word.
        present = np.zeros(len(self.alphabet) + 1, dtype=bool)
        present[codes] = True
        present[0] = True
        number = np.cumsum(present) - 1
        used = np.flatnonzero(present[self.rows].all(axis=1))
        codes, rows, lengths, normal = number[codes], number[self.rows[used]], self.lengths[used], self.normal[used]
        n, base = len(codes), int(number[-1]) + 1
        # The suffixes' first characters, several to a word; the end of a chunk reads as 0, like an uncovered character.
        end_of = np.repeat(np.concatenate([starts[1:], [n]]), np.diff(np.concatenate([starts, [n]])))
        per = int(62 // np.log2(max(base, 2)))
        words = -(-self.longest // per)
        room = end_of - np.arange(n)

        def packed(column) -> list[np.ndarray]:
            out = []
            for w in range(words):
                value = np.zeros_like(column(0))
                for k in range(w * per, (w + 1) * per):
                    value = value * base + (column(k) if k < self.longest else 0)
                out.append(value)
            return out

        ahead = np.concatenate([codes, np.zeros(self.longest, dtype=np.int64)])
        keys = packed(lambda k: np.where(room > k, ahead[k : k + n], 0))
        order = np.lexsort(keys[::-1])  # the suffix array, to the depth that pieces need
        keys = [k[order] for k in keys]
        # Suffixes with a piece as prefix are those from the piece followed by zeros up to the piece followed by the largest characters.
        cols, none = rows.T, np.zeros(len(used), dtype=np.int64)
        low = packed(lambda k: cols[k] if k < self.longest else none)
        high = packed(lambda k: np.where(lengths > k, cols[k], base - 1) if k < self.longest else none)
        lo, hi = _search(keys, low, "left"), _search(keys, high, "right")
        table, order = np.full((n, self.longest), -1, dtype=np.int32), order.astype(np.int32)  # edges by position and length
        del keys, low, high, ahead, codes, room, end_of
        counts = hi - lo
        ends = np.cumsum(counts)
        first = 0
        while first < len(used):  # some pieces at a time: their occurrences are many times the text
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + EDGES, side="right")))
            own = counts[first:last]
            piece = np.repeat(np.arange(first, last, dtype=np.int32), own)
            within = np.arange(len(piece)) - np.repeat(np.cumsum(own) - own, own)
            table[order[lo[piece] + within], lengths[piece] - 1] = normal[piece]
            first = last
        return table

    # --------------------------------------------------------------- relaxation

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and how many each has."""
        text, sizes = "".join(chunks), np.array([len(c) for c in chunks], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        table = self.edges(text, starts)
        first, length, owner = (self._merge if self.bpe else self._paths)(table, starts, sizes)
        ids = table[first, length - 1]
        lost = np.flatnonzero(ids < 0)
        if len(lost):  # uncovered characters, one symbol each (unigram models join neighbouring ones first)
            return self._with_bytes(text, first, length, owner, ids, len(chunks))
        return ids, np.bincount(owner, minlength=len(chunks))

    def _with_bytes(self, text, first, length, owner, ids, n) -> tuple[np.ndarray, np.ndarray]:
        covered = ids >= 0
        if not self.bytes:  # one unknown piece, in unigram models for a whole run of characters
            after = np.concatenate([[False], ~covered[:-1] & (owner[1:] == owner[:-1])])
            ids = np.where(covered, ids, self.unknown)
            keep = covered | self.bpe | ~after
            return ids[keep], np.bincount(owner[keep], minlength=n)
        lost = np.flatnonzero(~covered)
        spelled = [[self.bytes[b] for b in text[a : a + k].encode("utf-8", "replace")] for a, k in zip(first[lost].tolist(), length[lost].tolist(), strict=True)]
        count = np.ones(len(ids), dtype=np.int64)
        count[lost] = [len(x) for x in spelled]
        out = np.repeat(ids, count)
        out[out < 0] = np.concatenate([np.array(x, dtype=np.int32) for x in spelled])
        return out, np.bincount(np.repeat(owner, count), minlength=n)

    def _merge(self, table, starts, sizes):
        """Symbols (first, length, chunk) after all merges."""
        n = len(table)
        done, long_ = [], np.flatnonzero(sizes > LONG)
        for c in long_:
            a, k = self._merge_one(table, int(starts[c]), int(sizes[c]))
            done.append((a, k, np.full(len(a), c)))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        first = np.arange(n)
        if len(long_):
            ok = (sizes <= LONG)[owner]
            first, owner = first[ok], owner[ok]
        length = np.ones(len(first), dtype=np.int64)
        while len(first):
            joined = length[:-1] + length[1:]
            may = (owner[:-1] == owner[1:]) & (joined <= self.longest)
            at = np.flatnonzero(may)
            ids = table[first[at], joined[at] - 1]
            at, ids = at[ids >= 0], ids[ids >= 0]
            chunk = owner[at]
            live = np.zeros(len(sizes), dtype=bool)
            live[chunk] = True
            rest = ~live[owner]
            if rest.any():  # chunks without a merge left
                done.append((first[rest], length[rest], owner[rest]))
            if not len(at):
                break
            best = np.full(len(sizes), -np.inf)
            score = self.scores[ids]
            np.maximum.at(best, chunk, score)
            at = at[score == best[chunk]]
            at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]  # leftmost of each chunk
            length[at] += length[at + 1]
            keep = ~rest
            keep[at + 1] = False
            first, length, owner = first[keep], length[keep], owner[keep]
        first, length, owner = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (first, length, owner)
        order = np.argsort(first, kind="stable")
        return first[order], length[order], owner[order]

    def _merge_one(self, table, start: int, size: int):
        """The same for one long chunk, with a queue of merges and linked symbols."""
        length, left, right = [1] * size, list(range(-1, size - 1)), list(range(1, size + 1))
        queue: list[tuple[float, int, int, int]] = []
        scores, longest = self.scores, self.longest

        def offer(i: int) -> None:
            j = right[i]
            if j < size and (k := length[i] + length[j]) <= longest and (p := table[start + i, k - 1]) >= 0:
                heapq.heappush(queue, (-scores[p], i, j, k))

        for i in range(size - 1):
            offer(i)
        while queue:
            _, i, j, k = heapq.heappop(queue)
            if not length[i] or right[i] != j or not length[j] or length[i] + length[j] != k:
                continue
            length[i], length[j] = k, 0
            right[i] = right[j]
            if right[j] < size:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        first = np.array([i for i in range(size) if length[i]], dtype=np.int64)
        return start + first, np.array([length[i] for i in first], dtype=np.int64)

    def _paths(self, table, starts, sizes):
        """Symbols (first, length, chunk) of each chunk's best path; an uncovered character costs more than any piece."""
        n = len(table)
        best, back = np.full(n + 1, -np.inf), np.ones(n + 1, dtype=np.int64)
        value = np.where(table >= 0, self.scores[table], -np.inf)
        value[:, 0] = np.where(table[:, 0] >= 0, value[:, 0], self.worst)
        # best[p] is that of the path to p within its chunk; the chunk's start is 0, so a chunk's end is kept apart.
        final, final_back = np.full(len(sizes), -np.inf), np.ones(len(sizes), dtype=np.int64)
        best[starts] = 0.0
        for offset in range(int(sizes.max(initial=0))):
            own = np.flatnonzero(sizes > offset)
            p = starts[own] + offset
            for k in range(1, self.longest + 1):
                ok = sizes[own] >= offset + k
                if not ok.any():
                    break
                q, c = p[ok], own[ok]
                got = best[q] + value[q, k - 1]
                ends = sizes[c] == offset + k
                e, g = c[ends], got[ends]
                up = g > final[e]
                final[e[up]], final_back[e[up]] = g[up], k
                t, g = q[~ends] + k, got[~ends]
                up = g > best[t]
                best[t[up]], back[t[up]] = g[up], k
        first, length, owner = [], [], []
        at, step, own = starts + sizes, final_back.copy(), np.arange(len(sizes))
        while len(own):
            at = at - step
            first.append(at)
            length.append(step)
            owner.append(own)
            more = at > starts[own]
            at, own = at[more], own[more]
            step = back[at]
        first, length, owner = np.concatenate(first), np.concatenate(length), np.concatenate(owner)
        order = np.argsort(first, kind="stable")
        return first[order], length[order], owner[order]

    # ----------------------------------------------------------------- decoding

    def decode(self, ids) -> str:
        """Text of ids: bytes are joined to characters (broken ones become U+FFFD), control pieces vanish, the dummy prefix goes."""
        out, held, byte_of = [], bytearray(), self._byte_of
        for i in ids:
            if i in byte_of:
                held.append(byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i not in self.control:
                out.append(" ⁇ " if i == self.unknown else self.text[i].replace(SPACE, " "))
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if self.prefix and text[:1] == " " else text

    @functools.cached_property
    def _byte_of(self) -> dict[int, int]:
        return {i: b for b, i in self.bytes.items()}


def _search(keys: list[np.ndarray], wanted: list[np.ndarray], side: str) -> np.ndarray:
    """Positions of rows of `wanted` in the rows of `keys`, both compared column by column; keys are sorted. All binary searches run at once."""
    n = len(wanted[0])
    lo, hi = np.zeros(n, dtype=np.int64), np.full(n, len(keys[0]), dtype=np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        probe = np.minimum(mid, len(keys[0]) - 1)
        less, equal = np.zeros(n, dtype=bool), np.ones(n, dtype=bool)
        for k, w in zip(keys, wanted, strict=True):
            v = k[probe]
            less |= equal & (v < w)
            equal &= v == w
        go = less | (equal if side == "right" else False)
        lo, hi = np.where(open_ & go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
    return lo


class Encoder:
    """Texts to ids; remembers the ids of a bounded number of chunks."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.counts = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " " and self.model.prefix:
            return [SPACE + w for w in text.split(" ")]
        return _CHUNK.findall((SPACE if self.model.prefix else "") + text.replace(" ", SPACE))

    def __call__(self, texts) -> Iterator[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        known, parts, flats, counts = self.known, [], [self.flat], [self.counts]
        new: list[str] = []
        size = 0

        def match() -> None:
            ids, n = self.model.encode_chunks(new)
            flats.append(ids)
            counts.append(n)

        for t in texts:
            own = self.chunks(t or "")
            for c in set(own).difference(known):
                known[c] = len(known)
                new.append(c)
                size += len(c)
            parts.append(np.fromiter(map(known.__getitem__, own), dtype=np.int32, count=len(own)))
            if size >= BATCH_CHARS:
                match()
                new, size = [], 0
        if new:
            match()
        self.flat, self.counts = np.concatenate(flats).astype(np.int32, copy=False), np.concatenate(counts)
        starts = np.cumsum(self.counts) - self.counts
        for own in parts:
            count = self.counts[own]
            yield self.flat[np.repeat(starts[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())]


@functools.lru_cache(maxsize=2)
def _model(raw: bytes) -> Model:
    return Model(raw)


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _sliced(batches: Iterator[pd.Series], rows: int = 500) -> Iterator[pd.Series]:
    for s in batches:
        for k in range(0, max(len(s), 1), rows):
            yield s.iloc[k : k + rows]


def encode(text: Column, path: str = MODEL) -> Column:
    """Array of ids of a text column; empty for null and empty texts."""
    common.small_batches(SparkSession.active())
    raw = load(path)

    def ids(batches):
        encoder = Encoder(_model(raw))
        for s in _sliced(batches):
            yield pd.Series(list(encoder(s)), index=s.index, dtype=object)
        del encoder
        common.release()

    ids.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}  # types, not their names, decide the kind of a pandas UDF
    return F.pandas_udf(ids, "array<int>")(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str = MODEL) -> Column:
    """Text of a column of id arrays; null for null."""
    common.small_batches(SparkSession.active())
    raw = load(path)

    def texts(s):
        model = _model(raw)
        return s.map(lambda x: None if x is None else model.decode(x.tolist()))

    texts.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(texts, "string")(ids)


def tokenize(docs: DataFrame, path: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_ids, ids, restored) per document row: the ids of the whole text and whether decoding them gives the text back.

    Null and empty texts have no ids. Repeated rows give repeated results; other columns are ignored. Texts that hold U+2581 come back with spaces in its place, as the model
    cannot tell the two apart.
    """
    common.small_batches(docs.sparkSession)
    raw = load(path)

    def both(batches):
        model = _model(raw)
        encoder = Encoder(model)
        for s in _sliced(batches):
            ids = list(encoder(s))
            yield pd.DataFrame({"ids": ids, "restored": [model.decode(x.tolist()) == t for x, t in zip(ids, s, strict=True)]}, index=s.index)
        del encoder
        common.release()

    both.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    out = docs.select(F.col(key), F.pandas_udf(both, "ids array<int>, restored boolean")(F.coalesce(F.col(text), F.lit(""))).alias("p"))
    return out.select(key, F.size("p.ids").cast("long").alias("n_ids"), "p.ids", "p.restored")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(common.read(spark, sf_dir, "documents"))

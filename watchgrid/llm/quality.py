"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of vote patterns (a table whose size is bounded by the number of
labellers) estimates each labeller's outcomes given the true class and the share of good texts; its posteriors label the texts. A linear scorer on hashed features, byte-shape
bigrams and binned statistics of a text, is trained on the posteriors of a bounded sample (SAMPLE texts of either class, by smallest keyed hash) and scores all texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm import common

SAMPLE, DIMENSIONS, SEED = 3000, 2048, 7
#: Texts are kept when the scorer's probability of good is at least this.
KEEP = 0.5

_PUNCTUATION = b" \n\t\r.,;:!?'\"-()"
_SHAPE = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else 32 if c in b"\t\r\x0b\x0c" else c for c in range(256))
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _PUNCTUATION)
_STATISTICS = ("words", "upper", "symbols", "digits", "length", "repeats", "variety", "lines", "ends", "marks")


def statistics(text: str | None) -> tuple[np.ndarray, bytes]:
    """Statistics of a text in the order of _STATISTICS, and its bytes by shape."""
    raw = (text or "").encode("utf-8", "replace")
    shape = raw.translate(_SHAPE)
    words, n = raw.split(), max(1, len(raw))
    letters = max(1, len(raw) - len(raw.translate(None, bytes(c for c in range(256) if c >= 128 or chr(c).isalpha()))))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w = max(1, len(words))
    return np.array([
        len(words), shape.count(b"A") / letters, (len(raw) - len(raw.translate(None, _SYMBOLS))) / n, shape.count(b"0") / n, sum(map(len, words)) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w, len(set(words)) / w, 1 - len(set(lines)) / max(1, len(lines)), sum(x.rstrip()[-1:] in b".!?\"')" for x in lines) / max(1, len(lines)), (raw.count(b"!") + raw.count(b"?")) / w,
    ]), shape


def _bad(i: int, bound: float, above: bool = True, least_words: int = 5) -> Callable[[np.ndarray], str]:
    """Votes bad beyond a bound, else nothing: that one thing is right says little about a text."""
    return lambda s: "0" if s[0] >= least_words and (s[i] >= bound if above else s[i] <= bound) else "-"


def _prose(s: np.ndarray) -> str:
    """Votes good on words of usual length in lines that end like sentences."""
    return "1" if 3.5 <= s[4] <= 7.5 and s[8] >= 0.7 and s[2] < 0.02 else "-"


def _length(s: np.ndarray) -> str:
    return "0" if s[0] and (s[4] < 2 or s[4] > 12) else "-"


#: Capitals, symbols, digits, word length, repeated neighbours, little variety of words, repeated lines, line ends, shouting, prose.
LABELLERS = (_bad(1, 0.4), _bad(2, 0.03), _bad(3, 0.25), _length, _bad(5, 0.2), _bad(6, 0.12, above=False, least_words=40), _bad(7, 0.4), _bad(8, 0.25, above=False, least_words=20), _bad(9, 0.3), _prose)


def votes(s: np.ndarray) -> str:
    """The labellers' votes on a text's statistics."""
    return "".join(f(s) for f in LABELLERS)


class WeakLabels:
    """Class shares and outcome rates of the labellers, by expectation-maximisation over pattern counts."""

    def __init__(self, patterns: dict[str, int], rounds: int = 100):
        k = len(LABELLERS)
        self.share, self.rates = 0.5, np.zeros((2, k, 3))  # class, labeller, outcome (bad, good, none)
        code = {"0": 0, "1": 1, "-": 2}
        votes_ = np.array([[code[c] for c in p] for p in patterns], dtype=np.int64).reshape(-1, k)
        n = np.array(list(patterns.values()), dtype=float)
        total = max(n.sum(), 1.0)
        # Labellers are believed to be better than chance: pseudo-counts of a fiftieth of the texts say how bad and good texts are voted on (bad, good, none).
        prior = np.array([[0.3, 0.1, 0.6], [0.005, 0.3, 0.695]])
        q = np.where((votes_ == 0).any(axis=1), 0.1, 0.9) if len(n) else n
        for _ in range(rounds):
            for c, weight in ((0, n * (1 - q)), (1, n * q)):
                for j in range(k):
                    cast = np.array([weight[votes_[:, j] == o].sum() for o in range(3)])
                    self.rates[c, j] = (cast + 0.02 * total * prior[c]) / (cast.sum() + 0.02 * total)
            self.share = float(np.clip((n * q).sum() / total, 0.01, 0.99))
            new = self._posterior(votes_)
            if len(new) == 0 or np.abs(new - q).max() < 1e-7:
                break
            q = new
        self.posteriors = dict(zip(patterns, q.tolist(), strict=True))

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        logs = [np.log(self.rates[c][np.arange(v.shape[1]), v]).sum(axis=1) + np.log([1 - self.share, self.share][c]) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def accuracy(self) -> list[float]:
        """Of each labeller, the share of its votes that are right."""
        right = (1 - self.share) * self.rates[0, :, 0] + self.share * self.rates[1, :, 1]
        return (right / (right + (1 - self.share) * self.rates[0, :, 1] + self.share * self.rates[1, :, 0])).tolist()


def _hash(x: np.ndarray) -> np.ndarray:
    return (common.mix(x.astype(np.uint64) + np.uint64(SEED)) % np.uint64(DIMENSIONS)).astype(np.int64)


_PAIRS = _hash(np.arange(65536))
_BINS = np.array([0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9])


def features(s: np.ndarray, shape: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashed indices, values) of a text's statistics and shape: shares of the neighbouring byte shapes, by their square roots, and a unit for the bin of each statistic."""
    b = np.frombuffer(shape, dtype=np.uint8).astype(np.uint16)
    n = np.bincount((b[:-1] << np.uint16(8)) | b[1:], minlength=1) if len(b) > 1 else np.zeros(1)
    pairs = np.flatnonzero(n)
    share = np.sqrt(n[pairs] / max(1, n.sum()))
    bins = [np.searchsorted(_BINS, v, side="right") for v in s[[1, 2, 3, 5, 7, 8, 9]]] + [min(15, int(s[4])), min(20, int(10 * s[6])) if s[0] >= 40 else 31]
    extra = _hash(np.array([70_000 + 64 * i + int(v) for i, v in enumerate(bins)]))
    return np.concatenate([_PAIRS[pairs], extra]), np.concatenate([share, np.full(len(extra), 0.5)])


class Scorer:
    """Logistic regression over hashed features, by accelerated gradient steps on soft labels with balanced classes."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 300, ridge: float = 1e-4):
        x = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
        for k, (i, v) in enumerate(rows):
            np.add.at(x[k], i, v)
        y, w = labels, np.ones(len(labels))
        if 0 < y.sum() < len(y):
            w = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
        w = (w / max(w.sum(), 1e-9)).astype(np.float32)
        self.weights, self.bias = np.zeros(DIMENSIONS, dtype=np.float32), 0.0
        ahead, ahead_b, t = self.weights.copy(), 0.0, 1.0
        rate = 4.0 / (float((x * x).sum(axis=1).max(initial=1.0)) + 1)
        for _ in range(steps if len(rows) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ ahead + ahead_b, -60, 60)))
            r = (w * (p - y)).astype(np.float32)
            new, new_b = ahead - rate * (x.T @ r + ridge * ahead), ahead_b - rate * float(r.sum())
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, ahead_b = new + np.float32((t - 1) / t2) * (new - self.weights), new_b + (t - 1) / t2 * (new_b - self.bias)
            self.weights, self.bias, t = new, new_b, t2

    def probability(self, s: np.ndarray, shape: bytes) -> float:
        i, v = features(s, shape)
        return float(1 / (1 + np.exp(-np.clip(self.weights[i] @ v + self.bias, -60, 60))))


class Classifier:
    """Fitted to all texts of docs. With no sign of one of the classes everything belongs to the other."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE):
        common.small_batches(docs.sparkSession)
        vote = F.pandas_udf(lambda s: s.map(lambda t: votes(statistics(t)[0])), "string")
        cast = common.written(docs.select(F.col(key).alias("key"), vote(F.coalesce(F.col(text), F.lit(""))).alias("pattern")))
        counts = {r["pattern"]: r["n"] for r in cast.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # at most 3^10 patterns
        self.labels = WeakLabels(counts)
        good = [p for p, q in self.labels.posteriors.items() if q >= 0.5]
        side = F.col("pattern").isin(good) if good else F.lit(False)
        order = (F.xxhash64("key", F.lit(SEED)), "key")
        picked = [r for c in (side, ~side) for r in cast.where(c & F.col("key").isNotNull()).select("key", "pattern").distinct().orderBy(*order).limit(sample).collect()]
        self.scorer = None
        if picked and good and len(good) < len(counts):
            spark = docs.sparkSession
            chosen = spark.createDataFrame([(r["key"], self.labels.posteriors[r["pattern"]]) for r in picked], f"key {cast.schema['key'].dataType.simpleString()}, label double")

            def hashed(s: pd.Series) -> pd.DataFrame:
                found = [features(*statistics(t)) for t in s]
                return pd.DataFrame({"i": [i.tolist() for i, _ in found], "v": [v.tolist() for _, v in found]})

            texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")  # 2 * sample rows
            texts = texts.groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one row of a repeated key
            rows = texts.select("key", "label", F.pandas_udf(hashed, "i array<int>, v array<double>")(F.coalesce("text", F.lit(""))).alias("f")).orderBy("key", "label").collect()
            self.scorer = Scorer([(np.array(r["f"]["i"]), np.array(r["f"]["v"])) for r in rows], np.array([r["label"] for r in rows]))
        self.default = 1.0 if good or not counts else 0.0

    def _udf(self):
        scorer, default, posteriors = self.scorer, self.default, self.labels.posteriors

        def judge(s: pd.Series) -> pd.DataFrame:
            rows = []
            for t in s:
                found = statistics(t)
                rows.append((scorer.probability(*found) if scorer else default, posteriors.get(votes(found[0]), float("nan"))))
            return pd.DataFrame(rows, columns=["score", "posterior"], dtype="float64")

        return F.pandas_udf(judge, "score double, posterior double")

    def score(self, text: Column) -> Column:
        """Struct of the scorer's probability of good and the weak labels' posterior."""
        return self._udf()(F.coalesce(text, F.lit("")))

    def probability(self, text: Column) -> Column:
        scorer, default = self.scorer, self.default
        return F.pandas_udf(lambda s: s.map(lambda t: scorer.probability(*statistics(t)) if scorer else default).astype("float64"), "double")(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, posterior, kept) per document row.

    Null and empty texts get no vote and are scored by their features like others. Repeated rows score alike; other columns are ignored; texts are used whole.
    """
    model = Classifier(docs, key, text)
    out = docs.select(F.col(key), model.score(F.col(text)).alias("s"))
    return out.select(key, "s.score", "s.posterior", (F.col("s.score") >= KEEP).alias("kept"))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that the classifier does not reject."""
    return docs.where(Classifier(docs, key, text).probability(F.col(text)) >= KEEP)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.read(spark, sf_dir, "documents"))

"""Decoding message channels by their consequences.

Every message is paired with the actions of its receiver in the window after it, and with the same message moved sideways; the difference is what the message itself explains.
All of it is relational: interval-existence joins for presence, aggregates over (token, label) for grounding, and sign flips that are functions of message and round for the null.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchgrid.functions import scalars
from watchgrid.operators import rewrites
from watchgrid.sources import tables

OFFSETS = (3.0, 4.0, 5.0, 6.0)
ANYONE = ("all", "*", "broadcast")


def resolved(messages: DataFrame, actions: DataFrame) -> DataFrame:
    """messages with `agent`: the receiver among the acting agents, null (anyone) for broadcasts and unknown names."""
    agents = actions.select(F.col("agent").alias("_a")).distinct()
    named = F.when(~F.col("receiver").isin(*ANYONE), F.col("receiver"))
    return messages.join(agents, named == F.col("_a"), "left").withColumnRenamed("_a", "agent")


def tokens_of(messages: DataFrame) -> DataFrame:
    """(msg_id, token), each token of a message once."""
    return messages.select("msg_id", F.explode(F.array_distinct(scalars.tokens(F.col("text")))).alias("token"))


def vocabulary(tokens: DataFrame, n_messages: int, most: int = 500, least: int = 8) -> DataFrame:
    """(token, n): the most frequent tokens of at least `least` messages, ties by token, without classes that are in nearly all."""
    g = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    g = g.where(~((F.col("token").startswith("<")) & F.col("token").endswith(">") & (F.col("n") > 0.9 * n_messages)))
    return g.orderBy(F.desc("n"), "token").limit(most)


def outcomes(messages: DataFrame, actions: DataFrame, window: float) -> DataFrame:
    """(msg_id, label, hit, base, d): did the label follow the message within the window, how often does it follow the moved copies, and the difference centred by label."""
    ends = actions.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    m = resolved(messages, actions).crossJoin(F.broadcast(ends))  # one row
    shifts = F.array(F.lit(0.0), *[F.lit(s * o * window) for o in OFFSETS for s in (-1.0, 1.0)])
    moved = m.select("msg_id", "agent", F.explode(shifts).alias("shift"), "t", "t0", "t1")
    moved = moved.withColumn("t", F.when(F.col("shift") == 0, F.col("t")).otherwise(F.greatest(F.col("t0") - 1, F.least(F.col("t1") + 1, F.col("t") + F.col("shift")))))
    labels = F.broadcast(actions.select("label").distinct())  # kinds of actions
    points = moved.select("msg_id", "agent", "shift", "t").crossJoin(labels)
    told = rewrites.followed(points.where("agent IS NOT NULL"), actions.select("agent", "label", "t"), ["agent", "label"], "t", window)
    open_ = rewrites.followed(points.where("agent IS NULL"), actions.select("label", "t"), ["label"], "t", window)
    cols = ["msg_id", "label", "shift", "hit"]
    g = told.select(*cols).unionByName(open_.select(*cols)).groupBy("msg_id", "label").agg(F.max(F.when(F.col("shift") == 0, F.col("hit").cast("double"))).alias("hit"), F.avg(F.when(F.col("shift") != 0, F.col("hit").cast("double"))).alias("base"))
    g = g.withColumn("d", F.col("hit") - F.col("base"))
    mean = g.groupBy("label").agg(F.avg("d").alias("mean"))
    return g.join(F.broadcast(mean), "label").select("msg_id", "label", "hit", "base", (F.col("d") - F.col("mean")).alias("d"))


def grounding(tokens: DataFrame, vocab: DataFrame, outs: DataFrame) -> DataFrame:
    """(token, label, n, hits, base, s, z): paired differences summed over the messages with a token."""
    x = tokens.join(F.broadcast(vocab.select("token")), "token").join(outs, "msg_id")  # a bounded vocabulary
    g = x.groupBy("token", "label").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum("base").alias("base"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("v"))
    return g.select("token", "label", "n", "hits", "base", "s", (F.col("s") / F.sqrt(F.col("v") + 1)).alias("z"))


def sign(*keys) -> Column:
    return F.when(scalars.uniform(*keys) < 0.5, -1.0).otherwise(1.0)


def null_bar(tokens: DataFrame, vocab: DataFrame, outs: DataFrame, rounds: int = 100, alpha: float = 0.05, seed: int = 0) -> float:
    """The quantile of the largest z over all tokens and labels when each message's outcome has a random sign. Rounds fan out over rows and add up by hash aggregation."""
    x = tokens.join(F.broadcast(vocab.select("token")), "token").join(outs.select("msg_id", "label", "d"), "msg_id")
    signs = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: sign(F.col("msg_id"), r, seed))
    sums = [F.sum(F.col("d") * F.element_at("g", r + 1)).alias(f"s{r}") for r in range(rounds)]
    flips = tokens.select("msg_id").distinct().withColumn("g", signs)
    g = x.join(flips, "msg_id").groupBy("token", "label").agg(F.sqrt(F.sum(F.col("d") * F.col("d")) + 1).alias("den"), *sums)
    top = g.agg(*[F.max(F.col(f"s{r}") / F.col("den")).alias(f"m{r}") for r in range(rounds)]).first()
    return float(np.quantile([v for v in top if v is not None] or [0.0], 1 - alpha))


def ground(messages: DataFrame, actions: DataFrame, windows=(30.0, 300.0, 1800.0), rounds: int = 100, alpha: float = 0.05, most: int = 500, least: int = 8, seed: int = 0) -> DataFrame:
    """(token, label, window, z, lift, n): the best pair of each token whose z is above the null's bar in any window; hits at least 3."""
    tokens = tables.written(tokens_of(messages))
    vocab = tables.written(vocabulary(tokens, messages.count(), most, least))
    out, bar = None, -math.inf
    for w in windows:
        outs = tables.written(outcomes(messages, actions, w))
        bar = max(bar, null_bar(tokens, vocab, outs, rounds, alpha, seed))
        own = grounding(tokens, vocab, outs).withColumn("window", F.lit(w))
        out = own if out is None else out.unionByName(own)
    found = out.where((F.col("z") > bar) & (F.col("hits") >= 3))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("z"), "label", "window"))).where("r = 1")
    return best.select("token", "label", "window", "z", ((F.col("hits") + 0.5) / (F.col("base") + 0.5)).alias("lift"), "n")


def informativeness(messages: DataFrame, actions: DataFrame, window: float = 300.0, rounds: int = 50, folds: int = 5, most: int = 300, least: int = 5, ridge: float = 30.0, seed: int = 0) -> list[dict]:
    """Does the whole message foretell what follows? Cross-validated ridge regression of each label's outcome on token presence.

    Gram matrices and right-hand sides per fold are aggregates in Spark (at most most^2 rows a fold); the driver solves them. Predictions are scored against outcomes in Spark,
    and against outcomes with random signs for the null.
    """
    spark = messages.sparkSession
    tokens = tables.written(tokens_of(messages))
    vocab = [r["token"] for r in vocabulary(tokens, messages.count(), most, least).collect()]
    if not vocab:
        return []
    index = spark.createDataFrame([(t, i) for i, t in enumerate(vocab)], "token string, i int")
    x = tokens.join(F.broadcast(index), "token").select("msg_id", "i").withColumn("fold", F.floor(scalars.uniform(F.col("msg_id"), seed, "fold") * folds).cast("int"))
    pairs = x.alias("a").join(x.alias("b"), "msg_id").groupBy(F.col("a.fold"), F.col("a.i"), F.col("b.i").alias("j")).agg(F.count("*").alias("n")).collect()
    gram = np.zeros((folds, len(vocab), len(vocab)))
    for f, i, j, n in pairs:
        gram[f, i, j] = n
    outs = tables.written(outcomes(messages, actions, window))
    labels = [r["label"] for r in outs.groupBy("label").agg(F.sum("hit").alias("p"), F.count("*").alias("n")).where("p >= 25 AND n - p >= 25").orderBy("label").collect()]
    inverse = [np.linalg.inv(gram.sum(axis=0) - gram[f] + ridge * np.eye(len(vocab))) for f in range(folds)]
    out = []
    for label in labels:
        y = outs.where(F.col("label") == label).select("msg_id", "d")
        flips = F.array(F.lit(1.0), *[sign(F.col("msg_id"), r, seed, label) for r in range(1, rounds + 1)])
        rhs = x.join(y, "msg_id").withColumn("g", flips).groupBy("fold", "i").agg(*[F.sum(F.col("d") * F.element_at("g", r + 1)).alias(f"r{r}") for r in range(rounds + 1)]).collect()
        b = np.zeros((folds, len(vocab), rounds + 1))
        for r in rhs:
            b[r["fold"], r["i"]] = list(r)[2:]
        w = [inverse[f] @ (b.sum(axis=0) - b[f]) for f in range(folds)]
        weights = spark.createDataFrame([(f, i, w[f][i].tolist()) for f in range(folds) for i in range(len(vocab))], "fold int, i int, w array<double>")
        pred = x.join(F.broadcast(weights), ["fold", "i"]).groupBy("msg_id").agg(*[F.sum(F.element_at("w", r + 1)).alias(f"p{r}") for r in range(rounds + 1)])
        both = y.join(pred, "msg_id", "left").withColumn("g", flips)
        got = both.agg(*[scalars.correlation(F.coalesce(F.col(f"p{r}"), F.lit(0.0)), F.col("d") * F.element_at("g", r + 1)).alias(f"c{r}") for r in range(rounds + 1)]).first()
        score, null = got[0] or 0.0, np.array([v or 0.0 for v in got[1:]])
        p = 0.5 * math.erfc((score - null.mean()) / max(null.std(), 1e-9) / math.sqrt(2))
        out.append({"label": label, "score": score, "null": float(null.mean()), "p": p, "informative": bool(p * len(labels) < 0.05 and score > null.max())})
    return sorted(out, key=lambda r: -r["score"])


# -------------------------------------------------------------------- coordination


def presence(actions: DataFrame, width: float = 30.0, most_labels: int = 8) -> DataFrame:
    """(agent, label, w): the windows in which an agent does one of the most frequent things; windows count from the first action."""
    start = actions.agg(F.min("t").alias("t0"))
    top = actions.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most_labels).select("label")
    a = actions.join(F.broadcast(top), "label").crossJoin(F.broadcast(start))  # one row
    return a.select("agent", "label", F.floor((F.col("t") - F.col("t0")) / width).alias("w")).distinct()


def n_windows(actions: DataFrame, width: float) -> int:
    r = actions.agg(F.floor((F.max("t") - F.min("t")) / width).alias("n")).first()
    return int(r["n"] or 0) + 1


def _information(n11: Column, n1: Column, n2: Column, n: int) -> Column:
    """Mutual information in bits of two binary rows, from the counts of ones in both, either and all; 0 where one is constant."""
    cells = ((n11, n1, n2), (n1 - n11, n1, n - n2), (n2 - n11, n - n1, n2), (n - n1 - n2 + n11, n - n1, n - n2))
    total = sum((F.when(c > 0, c / n * F.log2(c * n / (F.nullif(a, F.lit(0)) * F.nullif(b, F.lit(0))))).otherwise(0.0) for c, a, b in cells), F.lit(0.0))
    return F.when((n1 > 0) & (n1 < n) & (n2 > 0) & (n2 < n), total).otherwise(0.0)


def mutual_information(seen: DataFrame, windows: int, least: int = 20) -> DataFrame:
    """(a, b, mi, labels): information that two agents' windows share, over labels, for agents with `least` marks; labels counts those that neither shows in all windows. Where there
    are none, nothing can be shared or not: mi is 0."""
    busy = seen.groupBy("agent").agg(F.count("*").alias("m")).where(F.col("m") >= least).select("agent")
    s = seen.join(busy, "agent")
    ones = s.groupBy("agent", "label").agg(F.count("*").alias("n"))
    both = s.alias("x").join(s.alias("y"), ["label", "w"]).where("x.agent < y.agent").groupBy(F.col("x.agent").alias("a"), F.col("y.agent").alias("b"), "label").agg(F.count("*").alias("n11"))
    pairs = ones.select(F.col("agent").alias("a"), "label", F.col("n").alias("n1")).join(ones.select(F.col("agent").alias("b"), "label", F.col("n").alias("n2")), "label").where("a < b")
    g = pairs.join(both, ["a", "b", "label"], "left").withColumn("n11", F.coalesce("n11", F.lit(0)))
    vary = (F.col("n1") < windows) & (F.col("n2") < windows)
    return g.groupBy("a", "b").agg(F.sum(_information(F.col("n11"), F.col("n1"), F.col("n2"), windows)).alias("mi"), F.sum(vary.cast("long")).alias("labels"))


def levels(actions: DataFrame, width: float, around: int = 10) -> DataFrame:
    """(agent, w, level): tercile of an agent's activity in the windows around one, itself left out; zero-filled grid."""
    n = n_windows(actions, width)
    spark = actions.sparkSession
    start = actions.agg(F.min("t").alias("t0"))
    c = actions.crossJoin(F.broadcast(start)).groupBy("agent", F.floor((F.col("t") - F.col("t0")) / width).alias("w")).agg(F.count("*").alias("c"))
    grid = spark.range(n).select(F.col("id").alias("w")).crossJoin(F.broadcast(actions.select("agent").distinct()))
    g = grid.join(c, ["agent", "w"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    w = Window.partitionBy("agent").orderBy("w").rowsBetween(-around, around)
    g = g.withColumn("slow", (F.sum("c").over(w) - F.col("c")) / F.greatest(F.count("*").over(w) - 1, F.lit(1)))
    cuts = g.groupBy("agent").agg(F.percentile("slow", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    g = g.join(cuts, "agent")
    return g.select("agent", "w", ((F.col("slow") >= F.col("q")[0]).cast("int") + (F.col("slow") >= F.col("q")[1]).cast("int")).alias("level"))


def coordination(actions: DataFrame, width: float = 30.0, rounds: int = 100, alpha: float = 0.01, least_windows: int = 60, most_pairs: int = 150, seed: int = 0) -> DataFrame:
    """(a, b, mi, expected, excess, p, flagged): pairs of agents aligned beyond what their slow activity explains.

    For the null, b's windows are permuted within strata of both agents' levels: the r-th window of a stratum in one random order takes the marks of the r-th in another.
    """
    spark, n = actions.sparkSession, n_windows(actions, width)
    if n < least_windows:
        return spark.createDataFrame([], "a string, b string, mi double, expected double, excess double, p double, flagged boolean")
    seen = tables.written(presence(actions, width))
    mi = mutual_information(seen, n)
    total = mi.count()
    top = mi.orderBy(F.desc("mi"), "a", "b").limit(most_pairs)
    top = tables.written(top)
    lv = tables.written(levels(actions, width))
    strata = top.select("a", "b").join(lv.withColumnsRenamed({"agent": "a", "level": "la"}), "a").join(lv.withColumnsRenamed({"agent": "b", "level": "lb"}), ["b", "w"]).select("a", "b", "w", (F.col("la") * 3 + F.col("lb")).alias("s"))
    fan = strata.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    own = Window.partitionBy("a", "b", "r", "s")
    fan = fan.withColumn("i", F.row_number().over(own.orderBy("w"))).withColumn("j", F.row_number().over(own.orderBy(F.xxhash64("a", "b", "w", "r", F.lit(seed)), "w")))
    moved = fan.select("a", "b", "r", "s", "i", "w").join(fan.select("a", "b", "r", "s", F.col("j").alias("i"), F.col("w").alias("v")), ["a", "b", "r", "s", "i"])
    xa, xb = seen.select(F.col("agent").alias("a"), "label", "w"), seen.select(F.col("agent").alias("b"), F.col("label"), F.col("w").alias("v"))
    hit = moved.join(xa, ["a", "w"]).join(xb, ["b", "v", "label"]).groupBy("a", "b", "r", "label").agg(F.count("*").alias("n11"))
    ones = seen.groupBy("agent", "label").agg(F.count("*").alias("n"))
    base = top.select("a", "b").join(ones.select(F.col("agent").alias("a"), "label", F.col("n").alias("n1")), "a").join(ones.select(F.col("agent").alias("b"), "label", F.col("n").alias("n2")), ["b", "label"])
    base = base.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    g = base.join(hit, ["a", "b", "r", "label"], "left").withColumn("n11", F.coalesce("n11", F.lit(0)))
    null = g.groupBy("a", "b", "r").agg(F.sum(_information(F.col("n11"), F.col("n1"), F.col("n2"), n)).alias("m")).groupBy("a", "b").agg(F.avg("m").alias("expected"), F.stddev_pop("m").alias("sd"), F.max("m").alias("most"))
    out = top.join(null, ["a", "b"]).withColumn("z", (F.col("mi") - F.col("expected")) / F.greatest("sd", F.lit(1e-9)))
    tail = F.pandas_udf(lambda z: z.map(lambda x: max(0.5 * math.erfc(x / math.sqrt(2)), 1e-300)), "double")
    out = out.withColumn("p", tail("z"))
    return out.select("a", "b", "mi", "expected", (F.col("mi") - F.col("expected")).alias("excess"), "p", ((F.col("p") * total < alpha) & (F.col("mi") > F.col("most"))).alias("flagged"))


# ------------------------------------------------------------------- text profiles


def hidden(messages: DataFrame) -> DataFrame:
    """(carrier, messages): how many messages hold characters that show nothing; 'any' counts those with any but mixed scripts."""
    n = {k: F.regexp_count("text", F.lit(p)) for k, p in scalars.HIDDEN.items()} | {"mixed_script_words": scalars.mixed_script_words(F.col("text"))}
    any_ = sum((n[k] for k in scalars.HIDDEN), F.lit(0)) > 0
    m = messages.select(F.explode(F.array(*[F.struct(F.lit(k).alias("carrier"), (c > 0).cast("long").alias("x")) for k, c in n.items()], F.struct(F.lit("any").alias("carrier"), any_.cast("long").alias("x")))).alias("c"))
    return m.groupBy("c.carrier").agg(F.sum("c.x").alias("messages"))


def decoded(messages: DataFrame) -> DataFrame:
    """(t, sender, carrier, text) of payloads that spell something printable."""
    t = F.col("text")
    both = F.array(F.struct(F.lit("unicode tags").alias("carrier"), scalars.decoded_tags(t).alias("payload")), F.struct(F.lit("zero-width binary").alias("carrier"), scalars.decoded_zero_width(t).alias("payload")))
    m = messages.select("t", "sender", F.explode(both).alias("c")).where("c.payload IS NOT NULL AND c.payload <> ''")
    return m.select("t", "sender", "c.carrier", F.substring("c.payload", 1, 200).alias("text"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    c = df.groupBy(column).agg(F.count("*").alias("n"))
    s = c.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("x"))
    return s.select((F.log2("t") - F.col("x") / F.col("t")).alias("bits"))


def trigrams(df: DataFrame, text: str) -> DataFrame:
    """(g, n): the trigrams of lower-cased texts."""
    low = F.lower(F.col(text))
    grams = F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))
    return df.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


def trigram_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence in bits of two tables of trigram counts."""
    x, y = a.select("g", F.col("n").alias("p")), b.select("g", F.col("n").alias("q"))
    tot = x.agg(F.sum("p").alias("tp")).crossJoin(y.agg(F.sum("q").alias("tq")))
    j = x.join(y, "g", "full_outer").crossJoin(F.broadcast(tot))  # one row
    p, q = F.coalesce("p", F.lit(0)) / F.col("tp"), F.coalesce("q", F.lit(0)) / F.col("tq")
    j = j.select(p.alias("p"), q.alias("q"), ((p + q) / 2).alias("m"))
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / F.col("m"))).otherwise(0.0)
    return j.agg(((F.sum(part("p")) + F.sum(part("q"))) / 2).alias("distance"))


def profile(messages: DataFrame) -> DataFrame:
    """One row: messages, tokens, vocabulary, type_token_ratio, char_entropy, zipf_slope (of the 200 most frequent tokens)."""
    words = messages.select(F.explode(scalars.tokens(F.col("text"))).alias("token"))
    counts = words.groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(200).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")))
    zipf = top.agg(F.when(F.count("*") >= 5, F.regr_slope(F.log("n"), F.log("rank"))).alias("zipf_slope"))
    basic = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("vocabulary"))
    chars = entropy(messages.select(F.explode(F.split("text", "")).alias("c")).where("c <> ''"), "c").withColumnRenamed("bits", "char_entropy")
    n = messages.agg(F.count("*").alias("messages"))
    out = n.crossJoin(basic).crossJoin(chars).crossJoin(zipf)  # one row each
    return out.select("messages", "tokens", "vocabulary", (F.col("vocabulary") / F.col("tokens")).alias("type_token_ratio"), "char_entropy", "zipf_slope")


def compression(messages: DataFrame) -> DataFrame:
    """Compressed share of the messages' bytes: each partition is one stream of messages in order, so the ratio is that of long runs, not of the whole."""

    def pack(batches):
        z, raw, packed = zlib.compressobj(9), 0, 0
        for pdf in batches:
            for t in pdf["text"]:
                b = (t or "").encode("utf-8", "replace") + b"\n"
                raw += len(b)
                packed += len(z.compress(b))
        yield pd.DataFrame({"raw": [raw], "packed": [packed + len(z.flush())]})

    return messages.select("text").mapInPandas(pack, "raw long, packed long").agg((F.sum("packed") / F.greatest(F.sum("raw"), F.lit(1))).alias("ratio"))

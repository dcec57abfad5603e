"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans of four kinds (email, ip, card, phone); boosted trees score each candidate from its format and its context; thresholds
calibrated per kind on held-out candidates select what is redacted. Candidates that a strict pattern and its check (parts of an address, Luhn, number of digits) confirm
form the base and stay whatever their score; of the others those that overlap the base are dropped. The trees are trained on the driver from a fixed number of generated
sentences (TRAIN_SENTENCES), and calibrated on sentences with other words, cues and formats (HELD_SENTENCES), so the model never depends on the input; scoring is one pass over
the texts, without a shuffle. Every pattern takes time linear in the text, whatever it holds.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm import common
from watchgrid.llm.boosting import Trees

KINDS = ("email", "ip", "card", "phone")
TRAIN_SENTENCES, HELD_SENTENCES = 2400, 2400
#: Least precision on held-out candidates at which a threshold is accepted.
PRECISION = 0.99

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match never begins inside a run of digits: it would begin at the run's start as well
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: Generators of further candidates; spans may overlap each other and the base. Spelled-out addresses are found from their "at" (see _spelled).
_AT = re.compile(r"\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?")
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]++)+")
_LOOSE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|\[\.\])\x20?[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:([\x20._-])[0-9]{4}(?:\1[0-9]{4}){2}|[\x20-][0-9]{6}[\x20-][0-9]{5}))(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"),
}
#: Words that stand before personal data, and words that stand before other numbers.
_FOR = frozenset("call phone tel telephone mobile cell fax contact mail email write reach card visa mastercard amex payment pay ip host server address client login".split())
_AGAINST = frozenset("version order invoice isbn section chapter serial part page total number ref item build release build lot id sku model".split())
_TOP = frozenset("com org net edu gov io de fr es uk eu info biz us ca".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octets(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the strict patterns, leftmost and non-overlapping within a kind; matches that fail their check are dropped and not retried."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if _HAS_DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


_HAS_DIGIT = re.compile("[0-9]")


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses that spell their "at": the whole run of characters of a local part, "at", and labels joined by dots, written or spelled."""
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start() and (domain := _SPELLED_DOMAIN.match(text, m.end())):
            yield start, domain.end()
        end = m.end()


def candidates(text: str) -> list[tuple[int, str, int]]:
    """Spans of the loose generators. A generator is passed over only where the text lacks a character or word that all of its spans have."""
    found = [(a, "email", b) for a, b in _spelled(text)] if "at" in text else []
    if _HAS_DIGIT.search(text):
        found += [(m.start(), k, m.end()) for k, p in _LOOSE.items() for m in p.finditer(text)]
    return sorted(found)


def features(text: str, start: int, kind: str, end: int) -> list[float]:
    span, d = text[start:end], _digits(text[start:end])
    before = re.findall(r"[A-Za-z]+", text[max(0, start - 40) : start].lower())[-4:]
    seps = [c for c in span if not c.isalnum()]
    parts = [len(p) for p in re.findall("[0-9]+", span)]
    left, right = text[start - 1 : start], text[end : end + 1]
    tail = re.findall("[A-Za-z]+", span.lower())[-1:]
    return [
        *(float(kind == k) for k in KINDS), len(span), len(d), float(len(d) >= 14 and luhn(d)), float(span[:1] == "+"), len(seps), len(set(seps)),
        len(parts), max(parts, default=0), min(parts, default=0), float(len(set(parts)) == 1 and len(parts) > 1), float(kind == "ip" and bool(re.fullmatch(r"[0-9.]+", span)) and _octets(span)),
        len(set(d)), float(d[:1] in ("3", "4", "5", "6")), float(left.isalnum()), float(right.isalnum()), float(left in ("+", "#", "=", "-", ".", '"')), float(right in ("-", ".", "%", '"') and text[end + 1 : end + 2].isalnum()),
        float(any(w in _FOR for w in before)), float(any(w in _AGAINST for w in before)), float("(" in span), float("@" in span or " at " in span or "(at)" in span or "[at]" in span), float(tail[0] in _TOP if tail else 0),
    ]


#: Fixed values of the generated sentences: syllables and cues for training, and others for calibration.
_TRAIN_WORDS = ("an er th in on re he ed or es ti st le ou la de en ver ge un que ment ción", "call phone tel mobile card visa payment host server client write contact", "version order invoice isbn part total number build lot sku")
_HELD_WORDS = ("ka mo ri sul tan wex bor pli dja nu gro fen zi hal öst", "telephone cell fax reach mail email mastercard amex pay ip address login", "section chapter serial page ref item release id model")


def _card(r: random.Random, good: bool) -> str:
    d = r.choice("3456") + "".join(r.choices("0123456789", k=14))
    last = next(c for c in "0123456789" if luhn(d + c))
    return d + (last if good else str((int(last) + r.randint(1, 9)) % 10))


def _piece(r: random.Random, kind: str, good: bool, held: bool, word) -> str:
    """A span of a kind, or what looks like one; held ones come in other formats."""
    number = lambda k: "".join(r.choices("0123456789", k=k))
    if kind == "email":
        if not good:
            return f"{word()} at {word()}{r.choice(('. ', ' . ')).join(('', word().title())) if r.random() < 0.8 else '.' + word()}"
        at, dot = r.choice(((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", ".")) if held else ((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", "."), ("[at]", ".")))
        return f"{word()}{r.choice('_-' if held else '.')}{word()}{at}{word()}{dot}{r.choice(sorted(_TOP))}"
    if kind == "ip":
        if not good:
            return ".".join(str(r.randint(200, 999)) for _ in range(4))
        return r.choice((".", " . ") if held else (".", ".", "[.]")).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        c = _card(r, good)
        return r.choice((c, c, r.choice("-." if held else " _").join(c[i : i + 4] for i in range(0, 16, 4))))
    a, b, c = number(3), number(3), number(4)
    if not good:
        return r.choice((f"{number(2)}-{b}-{number(4)}", f"{number(4)}.{b}.{c}") if held else (f"{number(4)} {number(4)} {number(4)}", f"{number(4)}-{b}-{c}"))
    code = r.randint(1, 99)
    return r.choice((f"({a}) {b}.{c}", f"+{code} ({a}) {b} {c}", f"+{code}.{a}.{b}.{c}") if held else (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{code} {a} {b} {c}", f"+{code} ({a}) {b}-{c}", f"{a}.{b}.{c}"))


def _sentences(n: int, seed: int, held: bool = False) -> Iterator[tuple[str, list[tuple[str, str, bool]]]]:
    """Generated texts, each with pieces (kind, piece, whether it is personal data). At times a piece stands right before a number of another kind, which strict patterns run into."""
    r = random.Random(seed)
    syllables, good_cues, bad_cues = (x.split() for x in (_HELD_WORDS if held else _TRAIN_WORDS))
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    for _ in range(n):
        kind, good = r.choice(KINDS), r.random() < 0.5
        piece = _piece(r, kind, good, held, word)
        cue = r.choice(good_cues if good else bad_cues) if (good and kind == "phone" and piece[0] != "+") or r.random() < 0.4 else word()
        pieces = [(kind, piece, good)]
        if kind != "email" and r.random() < 0.25:
            other = r.choice(("ip", "card"))
            pieces.append((other, _card(r, True) if other == "card" else ".".join(str(r.randint(0, 255)) for _ in range(4)), True))
        yield f"{word()} {word()} {cue} {' '.join(p for _, p, _ in pieces)} {word()} {word()}{r.choice('.,! ')}", pieces


@functools.cache
def model() -> tuple[Trees, dict[str, float]]:
    """Trees and the threshold of each kind: the smallest at which held-out candidates reach PRECISION, or 1 if none does. Deterministic.

    Half of the held-out candidates calibrate the probabilities, the other half the thresholds.
    """

    def table(n: int, seed: int, held: bool):
        x, y, kinds = [], [], []
        for text, pieces in _sentences(n, seed, held):
            for a, k, b in candidates(text):
                x.append(features(text, a, k, b))
                y.append(float(any(k == kind and good and text[a:b] == piece for kind, piece, good in pieces)))
                kinds.append(k)
        return np.array(x), np.array(y), np.array(kinds)

    x, y, _ = table(TRAIN_SENTENCES, 7, False)
    trees = Trees().fit(x, y)
    x, y, kinds = table(HELD_SENTENCES, 8, True)
    half = np.arange(len(y)) % 2 == 0
    p, thresholds = trees.calibrate(x[half], y[half]).probability(x), {}
    for k in KINDS:
        own = (kinds == k) & ~half
        order = np.argsort(-p[own], kind="stable")
        score, right = p[own][order], np.cumsum(y[own][order])
        last = np.concatenate([score[1:] < score[:-1], [True]]) if len(score) else np.empty(0, dtype=bool)  # of equal scores
        fit = score[last & (right / np.arange(1, len(score) + 1) >= PRECISION)]
        thresholds[k] = max(0.5, float(fit.min())) if len(fit) else 1.0
    return trees, thresholds


def spans(text: str | None, trees: Trees, thresholds: dict[str, float]) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The base spans, and all spans: the base, and candidates over the threshold that overlap neither the base nor a better candidate."""
    if not text:
        return [], []
    base = base_spans(text)
    more = _apart(candidates(text), sorted((a, b) for a, _, b in base))
    added: list[tuple[int, str, int]] = []
    if more:
        p = trees.probability(np.array([features(text, *c) for c in more]))
        chosen: list[tuple[int, int]] = []  # disjoint, in order
        for i in sorted(range(len(more)), key=lambda i: (-p[i], more[i][0], KINDS.index(more[i][1]))):
            a, k, b = more[i]
            at = bisect(chosen, (a, b))
            if p[i] >= thresholds[k] and not (at and chosen[at - 1][1] > a) and not (at < len(chosen) and chosen[at][0] < b):
                chosen.insert(at, (a, b))
                added.append(more[i])
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _apart(found, taken):
    """Of found those that overlap nothing in taken, sorted intervals."""
    starts, reach = np.array([a for a, _ in taken]), np.maximum.accumulate([b for _, b in taken])
    out = []
    for c in found:
        k = int(np.searchsorted(starts, c[2]))
        if not k or reach[k - 1] <= c[0]:
            out.append(c)
    return out


def _joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in found)


def redact(text: str | None, found) -> str | None:
    """text with each maximal run of overlapping spans replaced by the first one's kind in angle brackets."""
    if not found:
        return text
    out, at = [], 0
    for a, k, b in found:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans, n_spans (base and added ones), n_added, redacted.

    Null and empty texts have no spans; redacted keeps a null. Repeated rows give repeated results; other columns are ignored. Long texts are scanned whole.
    """
    common.small_batches(docs.sparkSession)
    df = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    fitted = model()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                base, found = spans(t, *fitted)
                n = [sum(k == kind for _, k, _ in base) for kind in KINDS]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), len(found), len(found) - len(base), redact(t, found)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added", "redacted"], index=pdf.index)
            yield pd.concat([pdf[["key"]], out], axis=1)

    key_type = df.schema["key"].dataType.simpleString()
    out = df.mapInPandas(scan, f"key {key_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long, redacted string")
    return out.withColumnRenamed("key", key)


def redacted(text: Column) -> Column:
    """A text column with its personal data replaced by kind."""
    common.small_batches(SparkSession.active())
    fitted = model()
    return F.pandas_udf(lambda s: s.map(lambda t: redact(t, spans(t, *fitted)[1])), "string")(text)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.read(spark, sf_dir, "documents")).drop("redacted")

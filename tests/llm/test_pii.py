"""Personal data: whole texts in linear time, spans that depend on nothing else in the text, and precision and recall on the documents."""

import re
import time

import pandas as pd
import pytest

from watchgrid.llm import pii

#: How the documents spell personal data; numbers that fail Luhn are none.
FORMATS = {"email": r"[A-Za-z0-9._%+-]+@mail\d\.example\.com", "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", "card": r"(?<![0-9a-z])\d{16}(?![0-9a-z])", "phone": r"\+1 \(\d{3}\) 555-\d{4}"}


def found(text):
    return [(text[a:b], k) for a, k, b in pii.spans(text, *pii.model())[1]]


def test_precision_and_recall_on_documents():
    right = wrong = lost = added = 0
    for t in pd.read_parquet("/root/testdata/sf0.01/documents.parquet")["text"].dropna():
        truth = {(m.start(), k, m.end()) for k, p in FORMATS.items() for m in re.finditer(p, t) if k != "card" or pii.luhn(m[0])}
        base, got = pii.spans(t, *pii.model())
        added += len(got) - len(base)
        right, wrong, lost = right + len(truth & set(got)), wrong + len(set(got) - truth), lost + len(truth - set(got))
    assert right > 50 and right / (right + wrong) >= 0.99 and right / (right + lost) >= 0.99


def test_model_finds_what_strict_patterns_run_into():
    assert found("call +1 (826) 555-4081 190.137.223.20 now") == [("+1 (826) 555-4081", "phone"), ("190.137.223.20", "ip")]
    assert found("pay 4111111111111111 4012888888881881 now") == [("4111111111111111", "card"), ("4012888888881881", "card")]
    assert found("write to jo_smith (at) mail (dot) example (dot) org please") == [("jo_smith (at) mail (dot) example (dot) org", "email")]
    assert found("order 1234567812345678 shipped at noon. Then more.") == []


@pytest.mark.parametrize("tail", ["", " 7", " @", " (at)"])
def test_a_span_does_not_depend_on_the_rest_of_the_text(tail):
    text = f"mail foo.bar at  example.com now{tail}"
    assert (5, "email", 28) in pii.spans(text, *pii.model())[1]


def test_whole_local_parts():
    [(a, k, b)] = pii.candidates("write " + "x" * 300 + " at " + "y" * 200 + ".com now")
    assert (a, k, b) == (6, "email", 6 + 300 + 4 + 200 + 4)


@pytest.mark.parametrize("text", ["1" * 1_000_000, "1." * 300_000, "a" * 1_000_000 + "@", "at " * 300_000, "+1 (555" * 100_000, " (at) " * 150_000, "a-" * 300_000 + " at b"])
def test_linear_time(text):
    pii.model()
    began = time.time()
    pii.spans(text, *pii.model())
    assert time.time() - began < 5

"""Rules, validators, context, addresses, organisations and overlaps, on one table of cases."""

import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.operators.detect import Policy, detect, entities, paragraphs
from maskwright.operators.patterns import RULES, Rule

CASES = [
    ("mail a.b+tag@sub.example.co.in or user@example.com.", [("EMAIL", "a.b+tag@sub.example.co.in"), ("EMAIL", "user@example.com")]),
    ("call +91 22 3075 2929 now", [("PHONE", "+91 22 3075 2929")]),
    ("Telephone: 022-68052182.", [("PHONE", "022-68052182")]),
    ("or (212) 555-0123 x12", [("PHONE", "(212) 555-0123 x12")]),
    ("Order ID 9039007922, total 1,234,567.89", []),
    ("card 4111 1111 1111 1111, not 4111111111111112 or 0000000000000000", [("CREDIT_CARD", "4111 1111 1111 1111")]),
    ("123-45-6789 000-12-3456 666-12-3456", [("SSN", "123-45-6789")]),
    ("ssn: 123456789", [("SSN", "123456789")]),
    ("10.0.0.255 999.1.1.1 Firmware 2.10.4.15", [("IP_ADDRESS", "10.0.0.255")]),
    ("2001:db8:0:0:0:0:0:1 fe80::1 ::1", [("IP_ADDRESS", "2001:db8:0:0:0:0:0:1"), ("IP_ADDRESS", "fe80::1")]),
    ("DOB: 1990-04-12; Dated December 10, 2025", [("DOB", "1990-04-12")]),
    ("born on April 12, 1990", [("DOB", "April 12, 1990")]),
    ("Flat 5, Lake Road, Andheri, Pune - 411 045, Maharashtra, India", [("ADDRESS", "Flat 5, Lake Road, Andheri, Pune - 411 045, Maharashtra, India")]),
    ("12 Elm Street, Springfield, IL 62704", [("ADDRESS", "12 Elm Street, Springfield, IL 62704")]),
    ("Ticket TKT-542727 Order 123456 shipped", []),
    ("Maharashtra, India", [("ADDRESS", "Maharashtra, India")]),
    ("Alpha Widgets Private Limited and Beta Metals Limited", [("ORG", "Alpha Widgets Private Limited"), ("ORG", "Beta Metals Limited")]),
    ("the Reserve Bank of India", []),
    ("see http://a.b/c).", [("URL", "http://a.b/c")]),
    ("ABCDE1234F 27ABCDE1234F1Z5 INA123456789", [("ID_NUMBER", "ABCDE1234F"), ("ID_NUMBER", "27ABCDE1234F1Z5"), ("ID_NUMBER", "INA123456789")]),
    ("Registration No: AB-12345", [("ID_NUMBER", "AB-12345")]),
    ("😀 a@b.co 😀", [("EMAIL", "a@b.co")]),
    ("   ", []),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)] + [(99, None)], "doc_id long, text string")
    rows = entities(detect(paragraphs(docs), Policy(mode="regex"))).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert CASES[r.doc_id][0][r.start : r.end] == r.original
        out.setdefault(r.doc_id, []).append((r.label, r.original))
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    assert found.get(i, []) == CASES[i][1]


def test_rules_equal_python_regexes(spark):
    rows = [c for c, _ in CASES]
    bare = [Rule(r.name, r.label, 1, r.body, r.lead, r.needs) for r in RULES]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "i long, text string")
    got = {r.i: r.s for r in frame.select("i", F.array(*(r.spans(F.col("text")) for r in bare)).alias("s")).collect()}
    for k, r in enumerate(bare):
        pattern = re.compile((f"(?:{r.lead})" if r.lead else "") + f"(?P<b>{r.body})")
        for i, c in enumerate(rows):
            assert [(s.start, s.end) for s in got[i][k]] == [m.span("b") for m in pattern.finditer(c)], (r.name, c)


def test_resolve_equals_greedy(spark):
    import random

    r = random.Random(1)
    rows = [(i, [(a := r.randrange(20), a + r.randint(1, 6), "X", r.randrange(3)) for _ in range(r.randint(0, 7))]) for i in range(60)]
    got = {x.i: [(s.start, s.end, s.priority) for s in x.k] for x in spark.createDataFrame(rows, f"i int, s {S.SPAN}").select("i", S.resolve(F.col("s")).alias("k")).collect()}
    for i, spans in rows:
        kept = []
        for a, b, _, p in sorted(set(spans), key=lambda s: (-s[3], s[0] - s[1], s[0])):
            if all(b <= x or y <= a for x, y, _ in kept):
                kept.append((a, b, p))
        assert got[i] == sorted(kept)


def test_bad_mode():
    with pytest.raises(ValueError):
        Policy(mode="x")

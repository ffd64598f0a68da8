"""A table of support tickets made from orders: personal data of every kind with its place, and look-alikes.

A template is a row of pieces of SQL, some of which are personal data of a label and a pool. The places of
these are added up from the pieces' lengths, so the gold spans come from the generator and from no rule. The
same pieces make the table in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import names as N
from ..functions.validators import verhoeff_digit

_C = "CAST(o_custkey AS STRING)"
_D = "CAST(o_orderdate AS DATE)"


def _number(factor: int, places: int, lo: int = 0, hi: int | None = None) -> str:
    """A number between two bounds, with leading zeros."""
    hi = 10**places - 1 if hi is None else hi
    return f"lpad(CAST({lo} + (o_orderkey * {factor} + o_custkey) % {hi - lo + 1} AS STRING), {places}, '0')"


def _one_of(values, factor: int = 1) -> str:
    values = list(values)
    return f"split_part('{'|'.join(values)}', '|', CAST((o_orderkey * {factor} + o_custkey) % {len(values)} + 1 AS INT))"


def _date(*parts: str) -> str:
    """A date from its parts: y, m, d (two digits), D (as it is), M (the month's name), or text."""
    months = "|".join("January February March April May June July August September October November December".split())
    of = {
        "y": f"CAST(year({_D}) AS STRING)", "m": f"lpad(CAST(month({_D}) AS STRING), 2, '0')", "d": f"lpad(CAST(day({_D}) AS STRING), 2, '0')", "D": f"CAST(day({_D}) AS STRING)",
        "M": f"split_part('{months}', '|', CAST(month({_D}) AS INT))",
    }
    return " || ".join(of.get(p, f"'{p}'") for p in parts)


def _card() -> str:
    """A card number with a valid check digit: four of its digits vary, every other of them counts twice."""
    digit = lambda factor: f"((o_orderkey * {factor} + o_custkey) % 10)"
    a, b, c, d = (digit(f) for f in (3, 7, 9, 11))
    twice = lambda x: f"CASE WHEN {x} > 4 THEN {x} * 2 - 9 ELSE {x} * 2 END"
    # 4111 11ab cd11 111x: places 7 and 9 from the left are doubled
    rest = "(8 + 1 + 2 + 1 + 2 + 1 + 2 + 1 + 2 + 1 + 2)"
    total = f"({rest} + ({twice(a)}) + {b} + ({twice(c)}) + {d})"
    text = lambda x: f"CAST({x} AS STRING)"
    return f"'4111 11' || {text(a)} || {text(b)} || ' ' || {text(c)} || {text(d)} || '11 111' || CAST((10 - {total} % 10) % 10 AS STRING)"


_AADHAAR = tuple((n := str(23412341234 + 7919 * i)) + str(verhoeff_digit(n)) for i in range(20))
_SPACED = tuple(f"{n[:4]} {n[4:8]} {n[8:]}" for n in _AADHAAR)

#: One for each kind of ticket: pieces of SQL, personal data as (SQL, label, pool).
TEMPLATES = (
    ("'Please write to '", (f"'user' || {_C} || '@mail' || CAST(o_custkey % 7 AS STRING) || '.example.org'", "EMAIL", "number"), "' today.'"),
    ("'Send it to '", (f"'cs.' || lower({_one_of(N.FIRST[:20])}) || '@waterloo' || CAST(o_custkey % 5 AS STRING) || 'bank.co.in'", "EMAIL", "name"), "', please.'"),
    ("'Call me at '", (f"'+91 22 ' || {_number(7919, 4)} || ' ' || {_number(104729, 4)}", "PHONE", "intl"), "' before noon.'"),
    ("'Telephone: '", (f"'022-6805' || {_number(7919, 4)}", "PHONE", "cue"), "' in the office.'"),
    (f"'Order ID 98' || {_number(7919, 8)} || ' is late, reply to '", (f"'97' || {_number(104729, 8)}", "PHONE", "india"), "' please.'"),
    ("'Try '", (f"'(212) 555-' || {_number(7919, 4)}", "PHONE", "us"), f"' for ref 212 555 ' || {_number(17, 4)} || ' again.'"),
    ("'From abroad '", (f"'001-212-555-' || {_number(7919, 4)}", "PHONE", "us prefixed"), "' works.'"),
    ("'DOB: '", (_date("y", "-", "m", "-", "d"), "DOB", "iso"), "' as on my card.'"),
    ("'Date of birth '", (_date("d", "/", "m", "/", "y"), "DOB", "numeric"), "', see the form.'"),
    ("'I was born on '", (_date("D", " ", "M", " ", "y"), "DOB", "worded"), "' in Pune.'"),
    (f"'Dated ' || {_date('M', ' 10, 2025')} || '; d.o.b. '", (_date("M", " ", "D", ", ", "y"), "DOB", "month first"), "' on file.'"),
    ("'My SSN is '", (f"{_number(31, 3, 100, 599)} || '-' || {_number(17, 2, 1)} || '-' || {_number(7919, 4, 1)}", "SSN", "dashed"), f"' and not 666-12-' || {_number(13, 4)} || '.'"),
    ("'Her social security number: '", (f"{_number(7919, 9)}", "SSN", "cue"), "' as told.'"),
    ("'PAN '", (f"'ABCPK' || {_number(7919, 4)} || 'F'", "ID_NUMBER", "pan"), f"' is on file, ABCPKX' || {_number(13, 3)} || ' is not one.'"),
    ("'CIN '", (f"'U' || {_number(31, 5)} || 'MH' || CAST(year({_D}) AS STRING) || 'PTC' || {_number(7919, 6)}", "ID_NUMBER", "cin"), "' is the firm.'"),
    ("'GST '", (f"'27ABCPK' || {_number(7919, 4)} || 'F1Z5'", "ID_NUMBER", "gstin"), "' on the bill.'"),
    ("'Adviser '", (f"'INA' || {_number(7919, 9)}", "ID_NUMBER", "sebi"), "' signed it.'"),
    ("'Membership No. '", (f"'AB-' || {_number(7919, 5)}", "ID_NUMBER", "registration"), "' has ended.'"),
    ("'Card '", (_card(), "CREDIT_CARD", "spaced"), "' was charged.'"),
    (f"'Card 41111111111' || {_number(13, 2)} || '112 or 0000000000000000 was not charged.'",),
    ("'Server '", ("'10.' || CAST(o_custkey % 256 AS STRING) || '.' || CAST(o_orderkey % 256 AS STRING) || '.7'", "IP_ADDRESS", "v4"), "' runs firmware 2.10.' || CAST(o_custkey % 9 AS STRING) || '.15 now.'"),
    ("'Host '", (f"'2001:db8:0:0:0:0:0:' || {_number(31, 3)}", "IP_ADDRESS", "v6"), "' is down.'"),
    ("'Host '", (f"'fe80::' || {_number(31, 3)}", "IP_ADDRESS", "v6 short"), "' is up.'"),
    ("'See '", (f"'https://www.waterloo' || CAST(o_custkey % 5 AS STRING) || '.com/x' || {_C} || '?id=7'", "URL", "whole"), "', then call.'"),
    ("'Shop at '", ("'shop-' || CAST(o_custkey % 9 AS STRING) || '.co.in'", "URL", "bare"), "' or elsewhere.'"),
    ("'Ship there; '", (f"'Flat ' || CAST(o_custkey % 90 + 1 AS STRING) || ', Lake Road, Andheri, Pune - 411 ' || {_number(1, 3)} || ', Maharashtra, India'", "ADDRESS", "pin")),
    ("'I live at '", (f"CAST(o_custkey % 90 + 1 AS STRING) || ' Elm Street, Springfield, IL ' || {_number(7919, 5)}", "ADDRESS", "zip"), "' now.'"),
    ("'The office is '", (f"CAST(o_custkey % 90 + 1 AS STRING) || ', Hill Road, Nashik 4' || {_number(7919, 5)}", "ADDRESS", "bare pin"), "' today.'"),
    ((_one_of(("Maharashtra, India", "Gujarat", "Tamil Nadu, India", "Kerala")), "ADDRESS", "state line"),),
    ("'Aadhaar '", (_one_of(_SPACED), "AADHAAR", "spaced"), "' attached.'"),
    ("'My aadhaar no is '", (_one_of(_AADHAAR), "AADHAAR", "cue"), "' as asked.'"),
    (f"'Number ' || {_one_of(n[:-1] + str((int(n[-1]) + 3) % 10) for n in _SPACED)} || ' is no identity.'",),
    ("'Invoice from '", ("'Waterloo' || CAST(o_custkey % 5 AS STRING) || ' Widgets Private Limited'", "ORG", "one"), "' and Reserve Bank of India.'"),
    ("'Paid by '", ("'Alpha' || CAST(o_custkey % 5 AS STRING) || ' Foods Limited'", "ORG", "two"), "' and '", ("'Beta' || CAST(o_orderkey % 5 AS STRING) || ' Metals Limited'", "ORG", "two"), "' together.'"),
    (f"'Total 1,234,567.89 for ticket TKT-' || {_number(7919, 6)} || ', dated December 10, 2025.'",),
    ("'We spoke to Mr. '", (f"{_one_of(N.FIRST[:20])} || ' ' || {_one_of(N.LAST[:20], 3)}", "PERSON", "titled, listed"), "' about it.'"),
    ("'The form was signed by '", (f"{_one_of(N.FIRST[:20])} || ' ' || {_one_of(N.LAST[:20], 3)}", "PERSON", "listed"), "' yesterday.'"),
    ("'It was Dr. '", (f"{_one_of(('Wakhele', 'Ghugare', 'Quillon'))} || ' ' || {_one_of(('Tambe', 'Orrick', 'Vellam'), 3)}", "PERSON", "titled, unlisted"), "' who called.'"),
)


def _text(template) -> str:
    return " || ".join(p if isinstance(p, str) else p[0] for p in template)


def _gold(template, dialect: str) -> str:
    """The spans of a template: start, end, label and pool, as an array of structs."""
    spans, before = [], ["''"]
    for p in template:
        if not isinstance(p, str):
            start = f"CAST(length({' || '.join(before)}) AS INT)"
            values = {"start": start, "end": f"{start} + CAST(length({p[0]}) AS INT)", "label": f"'{p[1]}'", "pool": f"'{p[2]}'"}
            if dialect == "spark":
                spans.append("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")")
            else:
                spans.append("{" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}")
        before.append(p if isinstance(p, str) else p[0])
    if not spans:
        return "from_json('[]', 'array<struct<start:int,end:int,label:string,pool:string>>')" if dialect == "spark" else "[]"
    return f"array({', '.join(spans)})" if dialect == "spark" else f"[{', '.join(spans)}]"


def _sql(dialect: str) -> str:
    pick = lambda of: f"CASE o_orderkey % {len(TEMPLATES)} " + " ".join(f"WHEN {i} THEN {of(t)}" for i, t in enumerate(TEMPLATES)) + " END"
    return f"SELECT o_orderkey AS ticket_id, o_custkey AS custkey, {pick(_text)} AS text, {pick(lambda t: _gold(t, dialect))} AS gold FROM orders"


#: ticket_id, custkey, text and gold in DuckDB.
SQL = _sql("duckdb")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticket_id, custkey, text and gold (an array of start, end, label and pool)."""
    return spark.sql(_sql("spark").replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))

"""The registered queries against their SQL, and those without SQL against what the tickets' generator says."""

import duckdb
import pytest

import __spark_entry__
from maskwright.plans import catalog, tickets

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    mine = catalog.QUERIES[name](spark, SF)
    theirs = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in theirs.description]
    want = theirs.fetchall()
    assert sorted(mine.columns) == sorted(columns) and want
    assert _rows(mine.columns, mine.collect()) == _rows(columns, want)


def test_tickets_are_the_same_in_both(spark, duck):
    mine = sorted((r.ticket_id, r.text, [tuple(g) for g in r.gold]) for r in tickets.tickets(spark, SF).collect())
    theirs = sorted((i, text, [tuple(g.values()) for g in gold]) for i, _, text, gold in duck.execute(tickets.SQL).fetchall())
    assert mine == theirs and len({t.split()[0] for _, t, _ in mine}) > 20


def test_rules_find_what_the_generator_made(spark):
    """Without a lexicon all but people is found; with it people whose names are listed or stand after a title are, too."""
    got = {r.label: r for r in catalog.QUERIES["prf_by_label"](spark, SF).collect()}
    # twelve digits of a card can be a valid identity number, which goes first
    assert all(r.recall == 1.0 for label, r in got.items() if label not in (None, "PERSON", "CREDIT_CARD")) and got["CREDIT_CARD"].recall > 0.9 and got["PERSON"].tp == 0
    assert {(r.label, r.inconsistent) for r in catalog.QUERIES["consistency_check"](spark, SF).collect() if r.originals > 0} >= {("EMAIL", 0), ("ORG", 0)}
    leaks = {(r.label, r.pool): r.leaked for r in catalog.QUERIES["leaks_by_mode"](spark, SF).collect()}
    assert len(leaks) == len({(p[1], p[2]) for t in tickets.TEMPLATES for p in t if not isinstance(p, str)}) and not any(leaks.values())


def test_every_query_is_registered():
    known = __spark_entry__.queries()
    assert set(catalog.QUERIES) <= set(known) and set(__spark_entry__.oracle_sql()) <= set(known)

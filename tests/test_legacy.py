"""Identity linking by chains of domains and names, against a plain flooding."""

import random

import pytest
from pyspark.sql import functions as F

from resolvescope.operators.components import connected_components
from resolvescope.plans import legacy

ROWS = "n int, domain string, name string, operator string, source string, resolver_identity_id long"
IDENTITIES = "id long, name string, operator string, source string"
DOMAINS = "resolver_identity_id long, domain string, source string, last_observation_ts timestamp"


def plain(rows, identities, domains):
    """(row number, identity) with a new identity named by its smallest row number, negated."""
    lower = lambda t: (t or "").lower()
    by_domain, by_name = {}, {}
    for i, d in domains:
        by_domain[d.lower()] = min(i, by_domain.get(d.lower(), i))
    for i, name, operator in identities:
        if name is not None:
            by_name[lower(name), lower(operator)] = min(i, by_name.get((lower(name), lower(operator)), i))
    known, left, ties, names = {}, [], {}, {}
    for n, domain, name, operator, given in rows:
        domain = domain.rstrip(".").lower() if domain else None
        name = name or domain
        by = (lower(name), lower(operator))
        found = given if given is not None else by_domain.get(domain, by_name.get(by) if name else None)
        if found is not None:
            known[n] = found
            if domain:
                ties[domain] = min(found, ties.get(domain, found))
            names.setdefault(found, []).append((name, operator))
        elif domain or name or operator:
            left.append((n, domain, by))
    for i, name, operator in identities:
        if name is None and i in names and any(x for x, _ in names[i]):
            taken = lower(min(x for x, _ in names[i] if x)), lower(operator or min((o for _, o in names[i] if o), default=None))
            ties[taken] = min(i, ties.get(taken, i))
    while left:
        group, evidence = [left[0]], set()
        while True:
            evidence |= {e for _, d, by in group for e in (d, by) if e}
            more = [r for r in left if r[1] in evidence or r[2] in evidence]
            if len(more) == len(group):
                break
            group = more
        tied = [ties[e] for e in evidence if e in ties]
        known |= {r[0]: min(tied) if tied else -min(x[0] for x in group) - 1 for r in group}
        left = [r for r in left if r not in group]
    return known


def linked(spark, rows, identities, domains, parts=3):
    frame = spark.createDataFrame([(n, d, name, o, "s", g) for n, d, name, o, g in rows], ROWS).repartition(parts)
    return legacy.link_identities(
        frame, spark.createDataFrame([(*i, "t") for i in identities], IDENTITIES),
        spark.createDataFrame([(i, d, "t", None) for i, d in domains], DOMAINS))


def named_by_row(got, highest):
    """New identities by their smallest row, as ``plain`` names them."""
    first = {}
    for n, i in got.items():
        first[i] = min(n, first.get(i, n))
    return {n: i if i <= highest else -first[i] - 1 for n, i in got.items()}


def test_one_name_under_several_domains_is_one_identity(spark):
    rows = [(0, "d1.example", "Op", "Org", None), (1, "d2.example.", "op", "ORG", None), (2, None, "OP", "org", None), (3, "d2.example", "Other", None, None), (4, None, "Other", None, None), (5, None, "Else", None, None)]
    out = linked(spark, rows, [(4, "known", None)], [(4, "k.example")])
    got = {r.n: r.resolver_identity_id for r in out["rows"].collect()}
    assert len({got[n] for n in range(5)}) == 1 and got[5] != got[0] and set(got.values()) == {5, 6}
    assert {(r.resolver_identity_id, r.domain) for r in out["domains"].collect()} == {(4, "k.example"), (got[0], "d1.example"), (got[0], "d2.example")}
    assert {r.id: r.name for r in out["identities"].collect()} == {4: "known", got[0]: "OP", got[5]: "Else"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_equal_flooding_in_any_order(spark, seed):
    draw = random.Random(seed)
    pick = lambda kind, many, none: None if draw.random() < none else f"{draw.choice([kind, kind.upper()])}{draw.randrange(many)}"
    rows = [(n, pick("dom", 60, 0.4), pick("name", 50, 0.3), pick("op", 2, 0.6), draw.choice([None] * 12 + [draw.randrange(1, 9)])) for n in range(120)]
    identities = [(i, None if i % 3 == 0 else f"name{draw.randrange(50)}", draw.choice([None, "op0"])) for i in range(1, 9)]
    domains = [(draw.randrange(1, 9), f"Dom{draw.randrange(60)}") for _ in range(6)]
    domains = [(i, d) for k, (i, d) in enumerate(domains) if (i, d) not in domains[:k]]
    want = plain(rows, identities, domains)
    for order in (rows, rows[::-1]):
        out = linked(spark, order, identities, domains, 3 if order is rows else 7)
        got = {r.n: r.resolver_identity_id for r in out["rows"].where(F.col("resolver_identity_id").isNotNull()).collect()}
        assert named_by_row(got, 8) == want
        assert len({i for i in got.values() if i > 8}) == len({i for i in want.values() if i < 0})
        assert {r.id for r in out["identities"].collect()} == set(range(1, 9)) | {i for i in got.values() if i > 8}


def test_rows_without_evidence_and_empty_tables(spark):
    out = linked(spark, [(0, None, None, None, None), (1, " ", "", "", None)], [], [])
    assert [r.resolver_identity_id for r in out["rows"].collect()] == [None, None] and out["identities"].count() == 0
    assert linked(spark, [], [], [])["rows"].count() == 0


def test_components_of_chains_stars_and_missing_ends(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(200)] + [("s", f"s{i}") for i in range(90)] + [("x", "x"), ("y", None), (None, "z")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {f"c{i:03}": "c000" for i in range(201)} | {"s": "s"} | {f"s{i}": "s" for i in range(90)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0

import random
import re

import numpy as np
import xxhash

from resolvescope.llm import simhash
from resolvescope.llm.common import Scratch, components

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    return value - (1 << 64) if value >> 63 else value


def plain_components(nodes, links):
    root = {n: n for n in nodes}
    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(docs):
    draw = random.Random(3)
    base = [" ".join(draw.choices(["ab", "Cd", "éf", "gh", "ÀI"], k=draw.randint(1, 12))) for _ in range(150)]
    texts = [None, "", "  \t", "one", "ONE", "one two", "one  two", "a\u00a0b c", *base, *base[:20], "w " * 40_000]
    texts = list(enumerate(texts, start=1))
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs(texts)).collect()}
    prints = {i: plain_print(t) for i, t in texts}
    assert {i: p for i, (p, _) in got.items()} == prints
    links = [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 2]
    assert {i: c for i, (_, c) in got.items()} == plain_components(prints, links)


def test_long_lists_are_summed_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    hashes = np.random.default_rng(1).integers(-2**63, 2**63, 50)
    ends = np.array([0, 0, 3, 30, 30, 50])
    want = [sum((1 << b) for b in range(64) if 2 * sum((int(h) >> b) & 1 for h in hashes[s:e]) > e - s) for s, e in zip(ends, ends[1:])]
    assert [int(v) & (1 << 64) - 1 for v in simhash.majority_bits(hashes, ends)] == want


def test_links_within_two_bits(spark):
    draw = random.Random(5)
    start = [draw.getrandbits(64) for _ in range(5)]
    prints = {0, *start, *(s ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64) for s in start for _ in range(30)), *(s ^ 7 for s in start), *(s ^ 15 << 20 for s in start)}
    prints = {p - (1 << 64) if p >> 63 else p for p in prints}
    scratch = Scratch(spark)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r["node"]: r["root"] for r in components(scratch, simhash.linked_fingerprints(scratch, frame)).collect()}
    links = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    want = plain_components(prints, links)
    assert {p: got.get(p, p) for p in prints} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1200), 1000)}
    assert components(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(docs, rows):
    frame = docs([(5, "a b c d"), (2, "a b c d"), (2, "a b c d"), (9, "q r s t u v"), (None, "a b c d"), (None, None), (7, ""), (8, None)])
    assert rows(simhash.one_of_each(frame), "doc_id") == [(None,), (None,), (2,), (7,), (9,)]
    assert simhash.one_of_each(frame).columns == frame.columns
    assert simhash.one_of_each(frame.limit(0)).count() == 0
    ids = rows(simhash.near_duplicates(frame), "doc_id", "component_id")
    assert (None, 2) in ids and (None, 7) in ids and ids.count((2, 2)) == 2


def test_one_row_of_each_group_by_row(table, rows):
    """Rows are told apart by id and text, ids or not; columns named like the operator's own stay."""
    schema = "doc_id long, text string, key string, fp int, loser int, again string, row int"
    texts = [(5, "a b c d"), (2, "a b c d"), (2, "a b c d"), (2, "other words stand here"), (9, "other words stand here"), (None, "a b c d"), (None, "nameless one two"), (None, "nameless one two"), (7, None), (None, "")]
    frame = table([(*r, "k", 1, 2, "z", 3) for r in texts], schema)
    kept = simhash.one_of_each(frame, keep_nameless=False)
    assert kept.columns == frame.columns
    assert rows(kept) == sorted([(2, "a b c d", "k", 1, 2, "z", 3), (2, "other words stand here", "k", 1, 2, "z", 3), (None, "nameless one two", "k", 1, 2, "z", 3), (7, None, "k", 1, 2, "z", 3)], key=lambda r: [(v is not None, v) for v in r])

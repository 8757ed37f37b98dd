import math

import numpy as np

from resolvescope.llm import nearest as nn

SCHEMA = "vec_id long, embedding array<float>, label int, node long"


def plain(vectors, queries, k):
    out = set()
    for q in queries:
        dist = sorted((math.dist(vectors[q], v), i) for i, v in vectors.items() if i != q)
        out |= {(q, r + 1, i) for r, (_, i) in enumerate(dist[:k])}
    return out


def f32(rows):
    return {i: [float(x) for x in np.array(v, dtype=np.float32)] for i, v in rows}


def test_copies_ties_and_unusable_rows(table):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)] + [(100, [3.0, 1.0]), (200, [0.5, 1.0])]
    bad = [(300, None), (400, [0.0, 0.0]), (500, [float("nan"), 1.0]), (600, [float("inf"), 1.0]), (700, [None, 1.0]), (None, [1.0, 1.0]), (0, [0.0, 1.0])]
    frame = table([(i, v, 1, 5) for i, v in rows + bad], SCHEMA)
    got = nn.nearest(frame, lambda v: v % 100 == 0, k=10).collect()
    vectors = f32(rows)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == plain(vectors, [0, 100, 200], 10)
    assert all(abs(r["score"] - math.dist(vectors[r["query_id"]], vectors[r["vec_id"]])) < 1e-12 for r in got)


def test_few_rows(table):
    frame = table([(0, [1.0, 2.0], 1, 1), (1, [2.0, 2.0], 1, 1), (2, [1.0, 2.0], 1, 1)], SCHEMA)
    assert [(r["rank"], r["vec_id"]) for r in nn.nearest(frame, lambda v: v == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert nn.nearest(frame.where("vec_id = 0"), lambda v: v == 0).count() == 0
    assert nn.nearest(frame.limit(0), lambda v: v == 0).count() == 0


def test_recall_against_brute_force(table):
    random = np.random.default_rng(4)
    centres = random.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + random.normal(size=16) * 0.6).tolist()) for i in range(3000)]
    frame = table([(i, v, 1, 5) for i, v in rows], SCHEMA, 4)
    got = {(r["query_id"], r["vec_id"]) for r in nn.nearest(frame, lambda v: v % 100 == 0, k=10).collect()}
    want = {(q, i) for q, _, i in plain(f32(rows), range(0, 3000, 100), 10)}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.95


def test_vectors_of_another_length_take_no_part(table):
    rows = [(i, [float(i), 1.0]) for i in range(8)] + [(100, [1.0, 2.0, 3.0]), (200, [5.0])]
    got = nn.nearest(table([(i, v, 1, 5) for i, v in rows], SCHEMA), lambda v: v % 100 == 0, k=3).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(0, 1, 1), (0, 2, 2), (0, 3, 3)}

import math
import random

import numpy as np
import pytest

from resolvescope.llm import grid_order

SCHEMA = "vec_id long, embedding array<float>, label int, key string, space string, n_links int, members int"


def plain(rows, threshold=0.93):
    """All pairs compared, components by flooding."""
    rows = list(rows)

    def usable(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = [set() for _ in rows]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a == b and usable(v, a) and usable(w, b) and len(v) == len(w):
                x, y = np.array(v, dtype=np.float32).astype(float), np.array(w, dtype=np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                more = links[todo.pop()] - group
                group |= more
                todo += more
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            seen |= dict.fromkeys(group, min(ids) if ids else None)
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] is not None and rows[i][0] == seen[i]))
    return sorted(out, key=repr)


def found(table, rows, parts=3):
    frame = table([(*r, "k", "s", 1, 2) for r in rows], SCHEMA, parts)
    return sorted((tuple(r) for r in grid_order.near_duplicates(frame).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def clouds(seed, n, width, spread, centres):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, width))
    return [(int(i), (middle[draw.integers(centres)] + draw.normal(size=width) * spread).astype(np.float32).tolist(), int(draw.integers(3))) for i in draw.permutation(n)]


@pytest.fixture
def small(monkeypatch):
    """Many blocks and levels of intervals."""
    monkeypatch.setattr(grid_order, "BLOCK_BYTES", 1)
    monkeypatch.setattr(grid_order, "TILE", 8)
    monkeypatch.setattr(grid_order, "FAN", 3)
    monkeypatch.setattr(grid_order, "TASK_BLOCKS", 4)


def test_equals_brute_force(table, small):
    rows = clouds(1, 300, 6, 0.3, 5)
    got = found(table, rows)
    assert got == plain(rows)
    assert len({r[2] for r in got}) > 3 and max(r[1] for r in got) > 10


def test_chains_and_copies(table, small):
    """Links only between neighbours on a circle, so components reach far beyond the threshold."""
    draw = random.Random(2)
    angles = [i * 0.2 for i in range(25)] + [40 * 0.13]
    rows = [(1000 - i, [math.cos(a), math.sin(a), 0.1], i % 2 and 1) for i, a in enumerate(angles)]
    rows += [(2000 + i, [0.5, 0.25, 1.0], 1) for i in range(60)] + [(3000 + i, [1.0, 0.5, 2.0], 1) for i in range(5)]
    draw.shuffle(rows)
    assert found(table, rows) == plain(rows)


def test_unusable_vectors_nulls_and_repeated_rows(table):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [None, 1.0], 1), (9, [inf, 1.0], 1)]
    rows += [(None, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (10, [1.0, -0.0], 1), (10, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0, 0.01], 1), (13, [1e30, 1e28], 1), (14, [1e-30, 0.0], 1), (None, None, None)]
    assert found(table, rows) == plain(rows)
    assert found(table, rows[2:9]) == plain(rows[2:9])
    frame = table([(1, [1.0], 1, "k", "s", 1, 2)], SCHEMA)
    assert grid_order.near_duplicates(frame.limit(0)).collect() == []


def test_double_vectors_and_no_label(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(80)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted(tuple(r) for r in grid_order.near_duplicates(frame, 0.8, label=None, vec_id="id", embedding="v").select("vec_id", "n_links").collect())
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert got == [(i, int((x @ x[i] >= 0.8).sum()) - 1) for i in range(80)]


def test_border_is_exact():
    """A cosine next to the threshold is judged by correctly rounded sums, whatever tile it lies in."""
    a, b = np.array([3.0, 4.0]), np.array([4.0, 3.0])
    assert grid_order.exact_cosine(a, b) == 0.96
    both, one = np.array([a, b]), np.ones(2, dtype=int)
    n_x, _, _ = grid_order.joined(both, both, one, one, True, (2, np.eye(2)), 0.96)
    assert n_x.tolist() == [1, 1]


def test_forest_of_a_tile_connects_what_the_tile_connects():
    draw = np.random.default_rng(7)
    for _ in range(60):
        linked = draw.random((12, 9)) < draw.choice([0.05, 0.15, 0.5])
        edges = grid_order.spanning(linked)
        whole, forest = grid_order.Forest(21), grid_order.Forest(21)
        for i, j in np.argwhere(linked):
            whole.join(int(i), 12 + int(j))
        for i, j in edges:
            assert linked[i, j]
            forest.join(i, 12 + j)
        assert [whole.root(i) for i in range(21)] == [forest.root(i) for i in range(21)]
        assert len(edges) < 21


def test_far_parts_are_skipped(monkeypatch):
    """Two clouds far apart cost no product of their vectors."""
    draw = np.random.default_rng(3)
    x = np.concatenate([np.array([1.0, 0, 0]) + draw.normal(size=(400, 3)) * 0.01, np.array([0, 1.0, 0]) + draw.normal(size=(400, 3)) * 0.01])
    seen = []
    monkeypatch.setattr(grid_order, "products", lambda u, v, real=grid_order.products: seen.append(u.mean(axis=0) @ v.mean(axis=0)) or real(u, v))
    n, _, forest = grid_order.joined(x, x, np.ones(800, dtype=int), np.ones(800, dtype=int), True, (3, np.eye(3)), 0.93)
    assert n.tolist() == [399] * 800 and {forest.root(i) for i in range(800)} == {0, 400}
    assert seen and min(seen) > 0.4  # tiles at the border of the clouds hold rows of both

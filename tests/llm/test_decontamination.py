import random
import re
from itertools import combinations

import numpy as np

from resolvescope.llm import decontamination as dc

ITEMS = "item_id long, text string, doc_id long"


def plain_overlap(doc, item):
    """Longest (tokens, equal, start) with both ends equal, by trying every stretch of every diagonal."""
    best = None
    for i in range(len(item)):
        for d in range(len(doc)):
            if doc[d] != item[i]:
                continue
            equal = 0
            for n in range(1, min(len(item) - i, len(doc) - d) + 1):
                same = doc[d + n - 1] == item[i + n - 1]
                equal += same
                if same and equal * 5 >= n * 4 and n >= min(dc.OVERLAP, len(item)):
                    best = max(best or (0, 0, 0), (n, equal, -d))
    return best and (best[0], best[1], -best[2])


def test_seeds_find_every_short_overlap():
    def held(mask, bad, n):
        return any(all(k == "0" or s + i not in bad for i, k in enumerate(mask)) for s in range(n - len(mask) + 1))

    for n in range(13, 26):
        for k in range(n // 5 + 1):
            assert all(any(held(m, set(bad), n) for m in dc.MASKS) for bad in combinations(range(1, n - 1), k))


def test_overlaps_equal_brute_force(docs, table, rows):
    draw = random.Random(11)
    words = [a + b for a in "bcdfg" for b in "aeiou"]
    text = lambda n: draw.choices(words, k=n)
    items = {i: text(n) for i, n in enumerate([40, 30, 20, 13, 12, 9, 5, 4, 1])}
    changed = lambda ws, p: [draw.choice(words) if draw.random() < p else w for w in ws]
    texts = []
    for i, item in items.items():
        for p in (0.0, 0.05, 0.1, 0.2):
            texts.append(text(30) + changed(item, p) + text(20))
        texts += [item, item[3:], item[:14] + text(60), text(5) + item + text(3) + item]
    texts += [text(200) for _ in range(20)] + [[]]
    rows_in = [(i, " ".join(t).title() + "!") for i, t in enumerate(texts)] + [(900, None), (None, " ".join(items[0])), (0, " ".join(texts[0]))]
    bench = table([(i, ", ".join(t).upper(), i) for i, t in items.items()] + [(50, None, 1), (51, "", 1), (0, " ".join(items[0]), 7)], ITEMS)
    got = {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["n_equal"], r["start"]) for r in dc.find_overlaps(docs(rows_in), bench).collect()}
    want = {}
    for d, t in rows_in:
        for i, item in items.items():
            if len(item) >= dc.LEAST_ITEM and (found := plain_overlap(re.findall(r"\w+", (t or "").lower()), item)):
                want[d, i] = max(found, want.get((d, i), found))
    assert set(got) == set(want)
    # The longest stretches agree; which of two equally long ones is told apart by equal tokens, then by place.
    assert got == want
    kept = rows(dc.without_overlaps(docs(rows_in), bench), "doc_id")
    assert {k[0] for k in kept} == {d for d, _ in rows_in if d is None or not any(d == x for x, _ in want)}


def test_empty_tables(docs, table):
    bench = table([(1, "one two three four five six", 1)], ITEMS)
    assert dc.find_overlaps(docs([(1, "one two three four five six")]), bench.limit(0)).count() == 0
    assert dc.find_overlaps(docs([]), bench).count() == 0
    assert dc.find_overlaps(docs([(1, "one two three four five six")]), bench).count() == 1


def test_stretch_on_a_diagonal():
    doc, item = np.arange(50), np.arange(50)
    assert dc.longest_overlap(doc, item, 0) == (0, 50, 50)
    assert dc.longest_overlap(doc, item + 100, 0) is None
    assert dc.longest_overlap(doc, item[20:40], 20) == (20, 20, 20)
    assert dc.longest_overlap(doc, item, 60) is None


def test_short_items_with_a_replaced_token(docs, table):
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in range(5, 13)}
    texts, want = [], set()
    for n, item in items.items():
        for k in range(n // 5 + 2):
            for bad in combinations(range(n), k):
                if k <= n // 5 or bad[0] == 0:
                    if k <= n // 5:
                        want.add((len(texts), n, 3, n, n - k))
                    texts.append(["a", "b", "c", *("other" if i in bad else w for i, w in enumerate(item)), "d"])
    bench = table([(n, " ".join(item), 1) for n, item in items.items()], ITEMS)
    got = dc.find_overlaps(docs([(i, " ".join(t)) for i, t in enumerate(texts)]), bench)
    assert {tuple(r) for r in got.select("doc_id", "item_id", "start", "n_tokens", "n_equal").collect()} == want


def test_seeds_find_every_overlap_up_to_25():
    for n in range(13, 26):
        # Per start of a mask the kept positions as bits; a pattern is missed if it hits all of them.
        spans = [sum(1 << s + i for i, k in enumerate(m) if k == "1") for m in dc.MASKS for s in range(n - len(m) + 1)]
        for k in range(n // 5 + 1):
            bad = np.array([sum(1 << i for i in b) for b in combinations(range(1, n - 1), k)])
            assert np.all([(bad & s) > 0 for s in spans], axis=0).sum() == 0


def test_a_passage_at_the_end_of_a_very_long_text(docs, table):
    draw = random.Random(3)
    item = [f"term{i}" for i in range(30)]
    filler = " ".join(f"w{draw.randrange(5000)}" for _ in range(300_000))
    frame = docs([(1, f"{filler} {' '.join(item)}"), (2, filler), (3, " ".join(item[:12]) + " " + filler)])
    found = dc.find_overlaps(frame, table([(1, " ".join(item), 9)], ITEMS)).collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in found] == [(1, 300_000, 30)]

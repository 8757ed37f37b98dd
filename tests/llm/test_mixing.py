import hashlib
import random

import pytest
from pyspark.sql import functions as F

from resolvescope.llm import mixing


def plain_order(seed, epoch, doc_id):
    return int(hashlib.md5(f"{seed}:{epoch}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:15], 16)


def test_share_gives_shortages_to_siblings():
    assert mixing.share(100, [10, 1000, 1000], [1, 1, 2]) == pytest.approx([10, 30, 60])
    assert mixing.share(100, [10, 20, 30], [1, 1, 1]) == pytest.approx([10, 20, 30])
    assert mixing.share(90, [1000, 1000], [0, 1]) == pytest.approx([0, 90])
    assert mixing.share(90, [1000, 40], [0, 1]) == pytest.approx([50, 40])
    assert mixing.share(90, [], []) == []


def test_shortage_stays_with_siblings_before_ancestors():
    leaves = [(("a", "x", "s1"), 10.0), (("a", "x", "s2"), 100.0), (("a", "y", "s1"), 100.0), (("b", "x", "s1"), 1000.0)]
    got = mixing.leaf_budgets(leaves, 200, {}, 1)
    assert got == pytest.approx({("a", "x", "s1"): 10, ("a", "x", "s2"): 40, ("a", "y", "s1"): 50, ("b", "x", "s1"): 100})
    got = mixing.leaf_budgets(leaves, 1000, {}, 1)
    assert got == pytest.approx({("a", "x", "s1"): 10, ("a", "x", "s2"): 100, ("a", "y", "s1"): 100, ("b", "x", "s1"): 790})


@pytest.mark.parametrize("budget", [None, 1, 700, 100_000])
def test_prefixes_equal_plain_code(table, rows, budget):
    draw = random.Random(2)
    texts = [(i if i % 9 else i % 2 or None, " ".join(["w"] * draw.randint(0, 9)), draw.choice(["en", "de", None]), draw.choice(["s0", "s0", "s0", "s1", None]), "x") for i in range(400)]
    texts += texts[:5] + [(1000, None, "fr", "s9", "x"), (1001, "", "en", "s0", "x")]
    frame = table(texts, "doc_id long, text string, lang string, source string, epoch string")
    domain = lambda: F.when(F.col("source") == "s0", "head").otherwise("tail")
    weights = {("head",): 1.0, ("tail",): 3.0, ("head", "en"): 2.0}
    got = rows(mixing.mix(frame, domain, weights, budget=budget, most_epochs=3, seed=7), "domain", "lang", "source", "epoch", "doc_id", "n_tokens")

    by_leaf = {}
    for i, t, lang, source, _ in texts:
        by_leaf.setdefault(("head" if source == "s0" else "tail", lang, source), []).append((i, len((t or "").split())))
    totals = [(leaf, float(sum(n for _, n in d))) for leaf, d in by_leaf.items() if sum(n for _, n in d)]
    dealt = mixing.leaf_budgets(totals, budget if budget is not None else sum(t for _, t in totals), weights, 3)
    want = []
    for leaf, total in totals:
        whole, rest = divmod(int(dealt[leaf] + 1e-6), int(total))
        whole, rest = (3, 0) if whole >= 3 else (whole, rest)
        want += [(*leaf, e, i, n) for e in range(whole) for i, n in by_leaf[leaf]]
        used = 0
        for i, n in sorted(by_leaf[leaf], key=lambda d: (plain_order(7, whole, d[0]), d[0] is not None, d[0] or 0, d[1])) if rest else []:
            used += n
            if used > rest:
                break
            want.append((*leaf, whole, i, n))
    assert got == sorted(want, key=lambda r: [(v is not None, v) for v in r])


def test_empty_table(docs):
    assert mixing.mix(docs([]), lambda: F.lit("d"), {}).count() == 0
    assert mixing.mix(docs([(1, ""), (2, None)]), lambda: F.lit("d"), {}).count() == 0


def test_rows_without_ids_and_long_texts(table):
    """A third of all rows share no id: the cut goes through them, one row of counts, not a row each."""
    texts = [(None, "a b", "en", "s") for _ in range(3000)] + [(i, "a b c", "en", "s") for i in range(2000)] + [(9000, "w " * 100_000, "en", "s")]
    frame = table(texts, "doc_id long, text string, lang string, source string")
    for budget in (5_000, 9_001, 108_000):
        got = mixing.mix(frame, lambda: F.lit("d"), {}, budget=budget, most_epochs=1)
        order = sorted(texts, key=lambda d: (plain_order(42, 0, d[0]), len(d[1])))
        used = kept = 0
        for _, text, *_ in order:
            used += len(text.split())
            if used > budget:
                break
            kept += 1
        assert got.count() == kept

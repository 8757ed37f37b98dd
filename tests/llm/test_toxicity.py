import math
import random
import re
import zlib

import numpy as np
import xxhash

from resolvescope.llm import toxicity as tx

LABELS = "doc_id long, quality int, toxic int, text string"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def made(n, seed=1):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 6))) for _ in range(400)]
    bad = ["zonkle", "zonkling", "zonkler", "vile"]
    docs, labels = [], []
    for i in range(n):
        toxic = draw.random() < 0.2
        text = draw.choices(words, k=draw.randint(5, 80))
        for _ in range(draw.randint(1, 4) if toxic else 0):
            text.insert(draw.randrange(len(text)), draw.choice(bad))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic), "label text"))
    return docs, labels


def test_held_out_rows_are_told_apart(docs, table):
    texts, labels = made(1500)
    extra = [(2000, None), (2001, ""), (None, "zonkle vile"), (texts[0][0], texts[0][1])]
    marks = table(labels + [(2001, 1, None, ""), (None, 1, 1, ""), (3, 0, 7, ""), (9999, 1, 1, "")], LABELS)
    got = tx.toxicity(docs(texts + extra), marks).collect()
    assert len(got) == len(texts) + len(extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) for r in got)
    truth = {i: t for i, _, t, _ in labels}
    out = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p for t, p in out if t]) > 0.95 and np.mean([p for t, p in out if not t]) < 0.01
    assert len({r["score"] for r in got if r["doc_id"] in (2000, 2001)}) == 1


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(docs, table):
    texts, labels = made(300)
    turned = [(i, 0, 1 - t if held(i) else t, "x") for i, _, t, _ in labels]
    one, two = (tx.train(docs(texts), table(x, LABELS)) for x in (labels, turned))
    assert one.intercept == two.intercept and np.array_equal(one.at, two.at) and np.array_equal(one.value, two.value)


def test_weights_are_sparse_and_the_sample_is_bounded(docs, table):
    texts, labels = made(900)
    weights = tx.train(docs(texts), table(labels, LABELS), sample=200)
    assert 0 < len(weights.at) < (1 << tx.BITS) // 50
    assert tx.train(docs(texts), table([], LABELS)).intercept == 0
    assert tx.toxicity(docs([]), table(labels, LABELS)).count() == 0
    kept = tx.without_toxic(docs(texts), table(labels, LABELS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < kept.count() < 900


def test_coordinates_do_not_cross_texts(spark, docs):
    both = docs([(1, "a b c"), (2, "d e"), (3, "")]).coalesce(1).select(tx.word_hashes(tx.text_of()).alias("_words")).toArrow().combine_chunks().to_batches()[0]
    at, row = tx.coordinates(both.column("_words"))
    # Words and two stems each, pairs of neighbours, and pairs that skip a word.
    assert sorted(np.bincount(row, minlength=3).tolist()) == [0, 2 * 3 + 1, 3 * 3 + 2 + 1]


MASK = (1 << 64) - 1


def plain_features(text):
    """Coordinates of a text by plain loops: words, their beginnings, neighbours and pairs that skip a word."""
    mix = [int(m) for m in tx.MIX]
    word = lambda w, seed=42: xxhash.xxh64_intdigest(w.encode(), seed=seed)
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    h = [word(w) for w in words]

    def stem(w, n):
        # The engine hashes the letters first and the length with that as its seed.
        return xxhash.xxh64_intdigest(n.to_bytes(4, "little"), seed=word(w[:n]))

    found = [x * mix[0] & MASK for x in [*h, *(stem(w, n) for n in tx.STEMS for w in words)]]
    for gap, first, second in ((1, 1, 2), (2, 3, 1)):
        for a, b in zip(h, h[gap:]):
            pair = (a * mix[first] & MASK) ^ (b * mix[second] & MASK)
            found.append((pair ^ pair >> 29) * mix[0] & MASK)
    return {x >> 64 - tx.BITS for x in found}


def plain_ftrl(examples, l1, alpha=1.0, beta=1.0, l2=0.01, toxic_weight=2.0):
    """Follow the regularised leader, coordinate by coordinate, as published."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(tx.PASSES):
        for features, label in examples:
            w = {i: weight(i) for i in features}
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.values())))))
            g = (p - label) * (toxic_weight if label else 1.0)
            for i in features:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_weights_equal_plain_ftrl(spark, docs, table):
    texts, labels = made(250, seed=4)
    model = tx.train(docs(texts), table(labels, LABELS))
    order = dict(spark.range(250).select("id", tx.F.xxhash64("id")).collect())
    truth = {i: t for i, _, t, _ in labels}
    learned = sorted((i for i, _ in texts if not held(i)), key=order.get)
    examples = [({*plain_features(dict(texts)[i]), "intercept"}, truth[i]) for i in learned]
    want = plain_ftrl(examples, l1=min(8.0, max(2.0, len(examples) / 500)))
    assert math.isclose(model.intercept, want.pop("intercept", 0.0), abs_tol=1e-9)
    got = dict(zip(model.at.tolist(), model.value.tolist()))
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in want) and len(want) > 5


def test_very_long_texts_are_scored_whole(docs, table):
    texts, labels = made(900)
    long = "harmless " * 200_000
    got = {r["doc_id"]: r["predicted"] for r in tx.toxicity(docs(texts + [(5000, long), (5001, long + "zonkle vile zonkler zonkling")]), table(labels, LABELS)).collect()}
    assert got[5000] == 0 and got[5001] == 1

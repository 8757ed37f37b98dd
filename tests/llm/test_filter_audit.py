import itertools
import random
import re

from resolvescope.llm import filter_audit

DOCS = "doc_id long, text string, lang string, part string, failed int, n long, key string"
LABELS = "doc_id long, quality int, toxic int, q string"


def plain(docs, labels):
    """Every order applied one filter after the other, document by document."""
    marks = {}
    for doc_id, quality, toxic in labels:
        good, bad = marks.get(doc_id, (False, False))
        marks[doc_id] = (good or quality == 1, bad or toxic == 1)
    smallest = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    fails = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = ""
        failed += "A" * (len(words) < 200)
        failed += "B" * (100 * len(set(words)) < 50 * len(words))
        failed += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        failed += "D" * bool(re.search(r"[#$%&*|]", text))
        failed += "E" * (doc_id is not None and smallest[text] < doc_id)
        good, toxic = marks.get(doc_id, (False, False)) if doc_id is not None else (False, False)
        fails.append((lang or "", failed, good, toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [f for f in fails if f[0] == part]
        everywhere = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                everywhere[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in f[1] for f in own) - len(gone), sum(f[1] == letter for f in own),
                    sum(f[2] for f in gone), sum(f[3] for f in gone), letter]
        for key, values in out.items():
            if key[0] == part:
                values[-1] = everywhere[values[-1]] if isinstance(values[-1], str) else values[-1]
    return {key: tuple(values) for key, values in out.items()}


def audited(frame, labels):
    got = filter_audit.filter_interactions(frame, labels)
    assert [f.dataType.simpleString() for f in got.schema][2:] == ["int"] + ["bigint"] * 7
    columns = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    rows = got.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in rows}
    assert len(found) == len(rows)
    return found


def text(draw):
    size = draw.choice([0, 1, 150, 199, 200, 201, 230, 400])
    words = [f"{draw.choice(['wort', 'Word', 'été'])}{draw.randrange(draw.choice([60, 5000]))}" for _ in range(size)]
    return draw.choice([" ", "\n", "  "]).join(words) + draw.choice(["", "", " 5 %", " a|b", "\t", " "])


def test_equals_orders_applied_one_by_one(table):
    draw = random.Random(3)
    texts = [text(draw) for _ in range(60)] + [None, "", " "]
    docs = [(i, draw.choice(texts), draw.choice(["en", "de", None, ""])) for i in range(260)]
    docs += [(7, docs[7][1], "en"), docs[9], docs[9], (11, "other text", "fr"), (None, texts[0], "en"), (None, texts[0], "de"), (None, None, "en")]
    labels = [(draw.randrange(280), draw.choice([0, 1, None]), draw.choice([0, 0, 1, None])) for _ in range(200)] + [(None, 1, 1)]
    frame = table([(*d, "x", 1, 2, "k") for d in docs], DOCS)
    assert audited(frame, table([(*row, "x") for row in labels], LABELS)) == plain(docs, labels)


def test_a_text_of_a_third_of_all_rows_and_empty_tables(table):
    draw = random.Random(5)
    docs = [(i, "same words here" if i % 3 == 0 else text(draw), "en") for i in range(150)]
    frame, none = table([(*d, "x", 1, 2, "k") for d in docs], DOCS), table([(1, 1, 1, "x")], LABELS).limit(0)
    assert audited(frame, none) == plain(docs, [])
    assert audited(frame.limit(0), none) == {}


def test_a_very_long_text(table):
    long = " ".join(f"w{i % 70000}" for i in range(120000)) + " END"
    docs = [(1, long, "en"), (2, long, "en"), (3, long.upper(), "en")]
    assert audited(table([(*d, "x", 1, 2, "k") for d in docs], DOCS), table([(2, 1, 0, "x"), (3, 0, 1, "x")], LABELS)) == plain(docs, [(2, 1, 0), (3, 0, 1)])


def test_potentials_give_shapley_values_of_any_game(spark):
    """Against the definition: the mean gain over all orders."""
    draw = random.Random(1)
    for k in (1, 2, 3, 4, 5):
        worth = [0] + [draw.randrange(1000) for _ in range((1 << k) - 1)]
        got = spark.createDataFrame([(worth,)], "worth array<long>").select(filter_audit.potentials(filter_audit.F.col("worth"), k)).first()[0]
        every = (1 << k) - 1
        orders = list(itertools.permutations(range(k)))
        for i in range(k):
            gains = sum(worth[before | 1 << i] - worth[before] for o in orders for before in [sum(1 << j for j in o[:o.index(i)])])
            assert (got[every] - got[every ^ 1 << i]) * len(orders) == gains * filter_audit.scale(k)

import hashlib
import random
import re

import numpy as np

from resolvescope.llm import fill_in_middle as fim

DOCS = "doc_id long, text string, n string, form int, output string, _text string, _name string"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """The transformation by list slices and string concatenation."""
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(part) for part in (tokens[:low], tokens[low:high], tokens[high:]))
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def some_text(draw):
    alphabet = ["a", "Wort", "été", "漢字", "𝒳", " ", "  ", "\n", "\t\r", " ", " ", "\x1f", "<", ">", "P>", "<S", "M"]
    return "".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 60)))


def test_equals_the_plain_form_and_restores(table):
    draw = random.Random(8)
    docs = [(i, some_text(draw)) for i in range(600)]
    docs += [(700, None), (701, ""), (702, " "), (None, "no name here"), (None, None), (5, "again"), (5, "again"), (703, "<P> a <S> b"), (704, "x<M>"), (705, "one")]
    made = fim.fill_in_middle(table([(*d, "x", 1, "o", "t", "m") for d in docs], DOCS)).withColumn("back", fim.restore_column(fim.F.col("output"), fim.F.col("form"))).collect()
    got = sorted(((r["doc_id"], r["back"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made), key=repr)
    assert got == sorted(((i, t or "", *plain(i, t)) for i, t in docs), key=repr)
    assert {"plain", "spm", "psm"} == {r["form"] for r in made}


def test_digests_and_very_long_text(table):
    long = " ".join(f"wört{i}" for i in range(300000))
    docs = [(i, long if i < 6 else "short text") for i in range(12)]
    got = {r["doc_id"]: r for r in fim.digests(fim.fill_in_middle(table([(*d, "x", 1, "o", "t", "m") for d in docs], DOCS))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in docs:
        n, form, prefix, middle, output = plain(i, t)
        assert tuple(got[i]) == (i, n, form, prefix, middle, sha(output), sha(t))
    assert fim.digests(fim.fill_in_middle(table([(1, "a", "x", 1, "o", "t", "m")], DOCS).limit(0))).collect() == []


def test_all_cuts_in_both_forms():
    for text in (b"", b"a", b"ab cd", "ein über langer".encode()):
        for first in range(len(text) + 1):
            for second in range(first, len(text) + 1):
                p, m, s = text[:first], text[first:second], text[second:]
                assert fim.arranged(text, first, second, "psm") == b"<P>" + p + b"<S>" + s + b"<M>" + m
                assert fim.arranged(text, first, second, "spm") == b"<S>" + s + b"<P>" + p + b"<M>" + m
                for form in ("psm", "spm"):
                    assert fim.restored(bytes(fim.arranged(text, first, second, form)), form) == text


def test_rotation_by_reversals():
    for size in range(8):
        for start in range(size + 1):
            for cut in range(start, size + 1):
                for end in range(cut, size + 1):
                    buffer = np.arange(size, dtype=np.uint8)
                    want = np.concatenate([buffer[:start], buffer[cut:end], buffer[start:cut], buffer[end:]])
                    fim.rotate(buffer, start, cut, end)
                    assert (buffer == want).all()

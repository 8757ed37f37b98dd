import base64
import gzip
import hashlib
import io
import random
import re
import time

import duckdb
import numpy as np
import pytest

from resolvescope.llm import html_extraction as hx
from resolvescope.llm import warc
from resolvescope.llm.common import Scratch
from resolvescope.llm.queries import OP2_SQL

LONG = "A paragraph with many words that goes on for a while, so that its ratio of text to tags is high. "
PAGES = "page_id long, url string, html string, text string, digest string"
CASES = [
    ("", ""),
    ("plain <b>te</b>xt &amp; more", "plain text & more"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T&eacute;</h1><p>{LONG}<p>short.<br>after</article><footer>c</footer>", f"Té\n{LONG.strip()}\nshort. after"),
    (f"<header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>{LONG}</p><aside>no</aside><section class='user-comments'><article><p>{LONG}</p></article></section></article></main>", f"T\n{LONG.strip()}"),
    (f"<div id=topMenu><a>m</a></div><div><div><p>{LONG}</p></div><div><p>x</p></div></div><div class='ad box'>{LONG}</div><div role=search>s</div>", f"{LONG.strip()}\nx"),
    (f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>{LONG}</p><p>{LONG}</p></body>", f"{LONG.strip()}\n{LONG.strip()}"),
    (f"<article><p>a\n\t b&nbsp;c</p><script>var x = '</p>';</script><style>p{{}}</style><!-- no --><form><p>f</p></form><div class=cookie-notice>n</div><p>{LONG}", f"a b c\n{LONG.strip()}"),
    ("<article><p>1 &lt; 2 &#x41;&#66;&notanentity;</p></article>", "1 < 2 AB&notanentity;".replace("&not", "¬")),
    ("<nav>only</nav><script>x</script>", ""),
]


@pytest.mark.parametrize("html, text", CASES)
def test_main_text(html, text):
    assert hx.main_text(html) == text


NAV, SIDE, FOOT = "<nav><a href=1>Home</a> <a href=2>News</a></nav>", "<aside>Most read today</aside>", "<footer>Contact and imprint</footer>"
ARTICLE = f"<h1>Title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p>"
BODY = f"Title\n{LONG.strip()}\nShort one.\n{LONG.strip()}"


@pytest.mark.parametrize("html, text", [
    (f"<body>{NAV}<div class='layout has-sidebar'><article>{ARTICLE}</article>{SIDE}</div>{FOOT}", BODY),
    (f"<body>{NAV}<article class='post no-comments'>{ARTICLE}</article>{FOOT}", BODY),
    (f"<body><form id=page method=post>{NAV}<div><div>{ARTICLE}</div></div>{SIDE}<input name=q></form></body>", BODY),
    (f"<body><div id='sidebar-layout'>{NAV}<main>{ARTICLE}<form>Your mail: <input></form></main></div>", BODY),  # a wrapper, and a form in it
    (f"<article>{ARTICLE}</article><section id=comments>{''.join(f'<p>{LONG} {i}</p>' for i in range(40))}</section>", BODY),  # comments outweigh the article
    (f"<div class='post comments-open'>{ARTICLE}<div class=comments>{LONG * 30}</div></div>", BODY),
    (f"<div>{ARTICLE}</div><div class='cookie-notice'>{LONG * 3}</div><div class='ad'>{LONG * 2}</div><nav>{'<a href=x>Section</a><br>' * 60}</nav>", BODY),
    (f"<article>{ARTICLE}<ul><li><a href=1>More</a><li><a href=2>Like</a><li><a href=3>This</a></ul></article>", BODY),
    ("<div class=menu><a href=1>a</a></div>", ""),
])
def test_names_do_not_silence_the_article(html, text):
    assert hx.main_text(html) == text


def test_scores_pick_the_content(monkeypatch):
    """A teaser in an article element loses to the rich part of the page; with flat scores it would not."""
    page = f"<body><article><h2><a href=1>Also new</a></h2></article><div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><p>Tail.</p></div></body>"
    assert hx.main_text(page) == "\n".join([LONG.strip()] * 3)
    monkeypatch.setattr(hx, "smoothed", lambda ratios, sigma=1.0: np.ones(len(ratios)))
    assert hx.main_text(page) != "\n".join([LONG.strip()] * 3)


def plain_selection(html):
    """The selection by its rules, over whole chains of ancestors."""
    parser = hx.Lines()
    parser.feed(html)
    parser.close()
    chain = lambda tree, i: [] if i < 0 else [i, *chain(tree, tree[i][0])]
    regions = [(parent, name) for name, parent in parser.regions]
    lines = [(" ".join("".join(x.parts).split()), set(chain(regions, x.region)), set(chain(parser.marks, x.mark)), x) for x in parser.lines]
    shown = [bool(t) and not x.unseen for t, _, _, x in lines]
    if not any(shown):
        return ""

    def rich(ok):
        ratios = [len(t) / max(1, x.tags) if o else 0.0 for (t, _, _, x), o in zip(lines, ok)]
        scores = []
        for i in range(len(ratios)):
            near = [(np.exp(-0.5 * (i - j) ** 2), r) for j, r in enumerate(ratios) if abs(i - j) <= 3]
            scores.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        border = hx.threshold(np.array(scores))
        return [s >= border - 1e-9 for s in scores]

    first = [len(t) if s and not x.linked else 0 for (t, _, _, x), s in zip(lines, shown)]
    total, disbelieved = sum(first), set()
    article = sum(n for n, line in zip(first, lines) if not line[2] and any(regions[r][1] in ("article", "main") for r in line[1]))
    for m, (parent, wrapper) in enumerate(parser.marks if article < hx.PROSE else []):
        free = sum(n for n, line in zip(first, lines) if line[2] <= disbelieved)
        held = sum(n for n, line in zip(first, lines) if m in line[2])
        if free < hx.LEFT * total and wrapper and held > total / 2 and held >= hx.PROSE and set(chain(parser.marks, parent)) <= disbelieved:
            disbelieved.add(m)
    may = [s and line[2] <= disbelieved for s, line in zip(shown, lines)]
    if not any(may):
        return ""
    strong = rich(may)
    telling = [i for i in range(len(lines)) if may[i] and strong[i]] or [i for i in range(len(lines)) if may[i]]
    mass = lambda r: sum(len(lines[i][0]) for i in telling if r in lines[i][1])
    picked, named = None, True
    for kind in ("article", "main"):
        own = [r for r, (parent, name) in enumerate(regions) if name == kind and mass(r) and not any(regions[a][1] == kind for a in chain(regions, parent))]
        if picked is None and own and 2 * sum(map(mass, own)) >= sum(len(lines[i][0]) for i in telling):
            picked = set(own)
    if picked is None:
        around = max(set.intersection(*[lines[i][1] for i in telling]), key=lambda r: len(chain(regions, r)))
        if around and sum(may[i] and around in line[1] for i, line in enumerate(lines)) == 1:
            around = regions[around][0]
        picked, named = {around}, False
    left = [i for i in range(len(lines)) if may[i]]
    links = "".join("L" if lines[i][3].linked and not lines[i][3].heading and not strong[i] else "." for i in left)
    menu = {k for m in re.finditer("L{3,}" if named else "L", links) for k in range(*m.span())}
    return "\n".join(lines[i][0] for k, i in enumerate(left) if lines[i][1] & picked and k not in menu)


def random_page(draw):
    def element(depth):
        if depth == 0 or draw.random() < 0.3:
            return draw.choice([f"<p>{LONG * draw.randrange(1, 4)}</p>", "<p>short</p>", "<a href=1>link</a><br>", "<li><a href=2>item</a>", "<p>", "</p>", "</div>", "text ", "<h2>Head</h2>", "<script>x</script>"])
        tag = draw.choice(["div", "div", "div", "section", "article", "main", "nav", "form", "aside", "header", "footer", "ul", "td"])
        name = draw.choice(["", "", "", " class='menu'", " class='has-sidebar x'", " id=comments", " class='ad'", " role=form", " hidden"])
        return f"<{tag}{name}>" + "".join(element(depth - 1) for _ in range(draw.randrange(1, 5))) + draw.choice([f"</{tag}>"] * 5 + [""])

    return "".join(element(draw.randrange(1, 6)) for _ in range(draw.randrange(1, 5)))


def test_selection_equals_the_plain_one():
    draw = random.Random(12)
    pages = [random_page(draw) for _ in range(1500)]
    wrong = [p for p in pages if hx.main_text(p) != plain_selection(p)]
    assert wrong == []
    assert len({hx.main_text(p) for p in pages}) > 300


def test_deep_and_unclosed_markup_takes_linear_time():
    def seconds(n):
        page = "<div class=menu-x><p>" * n + LONG * 2 + "</b></i></section></table>" * n + "</div>" * n
        start = time.perf_counter()
        assert hx.main_text(page) == (LONG * 2).strip()
        return time.perf_counter() - start

    seconds(2000)
    few, many = seconds(5000), seconds(50_000)
    assert many < 40 * few + 1


def test_pieces_fed_do_not_matter(monkeypatch):
    monkeypatch.setattr(hx, "FED", 3)
    for html, text in CASES:
        assert hx.main_text(html) == text


def test_smoothing_and_threshold():
    assert hx.smoothed(np.ones(9)) == pytest.approx(np.ones(9))
    assert hx.threshold(np.array([1.0, 2, 1, 50, 60])) == pytest.approx((4 / 3 + 55) / 2)
    assert hx.threshold(np.array([3.0, 3.0])) == 3


def test_extract_frames(table, rows):
    pages = table([(i, f"u{i}", h, "old", "d") for i, (h, _) in enumerate(CASES)] + [(50, None, None, "old", "d"), (0, "u0", "", "old", "d"), (51, "u", f"<article><p>{LONG * 5000}</p></article>", "", "")], PAGES)
    got = rows(hx.extract_text(pages), "page_id", "url", "text", "n_chars")
    want = [(i, f"u{i}", t, len(t)) for i, (_, t) in enumerate(CASES)] + [(50, None, "", 0), (0, "u0", "", 0), (51, "u", (LONG * 5000).strip(), len(LONG) * 5000 - 1)]
    assert got == sorted(want, key=lambda r: (r[0], r[1] is not None, r[1]))
    assert hx.extract_text(pages.limit(0)).count() == 0


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


PAYLOADS = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (7, "u", "same"), (3, "u", None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\né世\r\n"), (6, "u", "x" * 5000), (None, "u", "same"), (None, "u", "alone"), (8, "u", "twice"), (8, "u", "twice")]


@pytest.mark.parametrize("least", [0, 1, 5])
def test_round_trip(table, rows, least, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    pages = table([(i, u, h, "t", "d") for i, u, h in PAYLOADS], PAGES)
    got = rows(warc.archived(pages, least_bytes=least), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, html in PAYLOADS:
        html = html or ""
        size = len(html.encode())
        first = max((p for p, _, h in PAYLOADS if (h or "") == html and p is not None), default=None)
        many = sum((h or "") == html for _, _, h in PAYLOADS) > 1
        revisit = size >= least and many and first is not None and i != first
        want.append((i, size, digest(html), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=lambda r: [(v is not None, v) for v in r])


def test_chunk_rows(spark, table):
    text = "é" * 1700
    pages = table([(1, "http://a/", text, "", ""), (2, "http://b/", text, "", ""), (3, "http://c/", "z", "", "")], PAGES)
    archives = warc.write_archives(pages, Scratch(spark))
    found = [r for a in archives.collect() for r in warc.archive_chunks(open(warc.filesystem(a["path"])[1], "rb"), chunk=1000)]
    data = {}
    for r in found:
        data[r["page_id"]] = data.get(r["page_id"], b"") + r["data"]
        assert r["record_type"] == "revisit" or r["digest"] == base64.b32encode(hashlib.sha1(data[r["page_id"]]).digest()).decode()
    assert data == {2: text.encode(), 1: b"", 3: b"z"}
    assert [r["chunk"] for r in found if r["page_id"] == 2] == [0, 1, 2, 3]
    whole = warc.read_chunks(archives).where("page_id = 2").collect()
    assert b"".join(r["data"] for r in sorted(whole, key=lambda r: r["chunk"])) == text.encode()
    assert warc.archived(pages.limit(0)).count() == 0


def test_damaged_archives_fail():
    head = warc.record_head({"record_type": "response", "page_id": 1, "url": "u", "digest": digest("ab"), "n_bytes": 2, "refers_to": None}, "2024-01-01T00:00:00Z")
    good = head + b"ab\r\n\r\n"
    assert [r["data"] for r in warc.archive_chunks(io.BytesIO(gzip.compress(good) * 2))] == [b"ab", b"ab"]
    for bad in (head + b"ax\r\n\r\n", head + b"a", b"junk\r\n\r\n", head + b"ab\r\nmore\r\n"):
        with pytest.raises(ValueError):
            list(warc.archive_chunks(io.BytesIO(gzip.compress(bad))))


def test_equals_duckdb(spark, rows):
    path = "/root/testdata/sf0.001/pages.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = db.execute(f"SELECT {', '.join(names)} FROM ({OP2_SQL})").fetchall()
    assert rows(warc.archived(spark.read.parquet(path)), *names) == sorted(map(tuple, want))

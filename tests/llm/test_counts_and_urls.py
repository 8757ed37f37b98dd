import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from resolvescope.llm import token_counts, url_filters
from resolvescope.llm.queries import URL_RULES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNT = token_counts.text_counter(*token_counts.load_merges(PATH))
PIECES = [*" \n\t\r\x0b\x0c\x1c\x85\xa0\u3000aAtheré世界😀́½Ⅷ'!?_09", "'ll", "'S", "<|endoftext|>", "<|endof", " the"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_counts_equal_the_library(text):
    assert COUNT(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_long_runs_without_spaces():
    for text in ["a" * 30_000, "".join(random.Random(1).choices("abcdé", k=20_000)), " " * 5_000]:
        assert COUNT(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_count_tokens_of_frames(table, rows):
    frame = table([(1, "hello world", 7), (1, "hello world", 7), (2, None, 8), (3, "", 9), (None, "é" * 600, 0)], "doc_id long, text string, n_tokens long")
    out = token_counts.count_tokens(frame, PATH)
    long = len(LIBRARY.encode("é" * 600, add_special_tokens=False).ids)
    assert rows(out, "doc_id", "n_bytes", "n_tokens", "over_limit") == [(None, 1200, long, long > 512), (1, 11, 2, False), (1, 11, 2, False), (2, 0, 0, False), (3, 0, 0, False)]
    assert token_counts.count_tokens(frame.limit(0), PATH).count() == 0


def plain_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = lambda s, marks: s[:min([s.find(m) for m in marks if m in s], default=len(s))]
    host = cut(rest, "/?#")
    return host.translate({c: c + 32 for c in range(65, 91)}), cut(rest[len(host):], "?#")


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no-scheme.org/x", "http://A.Example.ORG/es/1", "https://example.org/en/12?q", "https://example.org/en/2", "x://org/", "x://org", "http://forg/", "http://b.com/de/",
    "http://b.com/fr/#top", "http://www.n.net/a/", "http://n.net/a", "http://n.net/a?x=1", "http://m.net/b", "http://m.net/é", "a://b://c/d", "http://É.net/É",
]


def test_urls_against_plain_code(table, rows):
    pages = table([(i, u, "html", "block") for i, u in enumerate(URLS + URLS)], "page_id long, url string, html string, verdict string")
    listed = pages.sparkSession.createDataFrame([("n.net/a",), ("n.net/a",), ("org",), ("",), (None,)], "canonical string")
    want = []
    for i, url in enumerate(URLS + URLS):
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        key = host.removeprefix("www.") + path.rstrip("/")
        want.append((i, host, path, rule, verdict or ("block" if key in ("n.net/a", "org") else "allow")))
    assert rows(url_filters.filter_urls(pages, URL_RULES, listed, ["page_id"])) == want
    assert {r[0] for r in rows(url_filters.filter_urls(pages, [], listed.limit(0), ["page_id"]), "verdict")} == {"allow"}
    assert url_filters.filter_urls(pages.limit(0), URL_RULES, listed, ["page_id"]).count() == 0


def test_very_long_urls(table, rows):
    path = "/p" * 200_000
    pages = table([(1, f"http://n.net{path}?q", "h", "v"), (2, f"http://n.net{path}x", "h", "v")], "page_id long, url string, html string, verdict string")
    listed = pages.sparkSession.createDataFrame([(f"n.net{path}",)], "canonical string")
    assert rows(url_filters.filter_urls(pages, URL_RULES, listed, ["page_id"]), "page_id", "path", "verdict") == [(1, path, "block"), (2, path + "x", "allow")]


@pytest.mark.parametrize("most_bits", [1 << 9, 1 << 20])
def test_bloom_filter_loses_no_key(spark, most_bits):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = url_filters.BlockedBloom(keys, most_bits=most_bits)
    assert keys.where(bloom.may_hold(F.col("key"))).count() == 3000
    others = spark.range(3000).select(F.concat(F.lit("o"), "id").alias("key")).where(bloom.may_hold(F.col("key"))).count()
    assert others < 30 or most_bits < 3000

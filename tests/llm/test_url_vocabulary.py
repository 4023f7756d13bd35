"""URL filter beside a plain version with regular expressions."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pairweave.llm.queries import URL_RULES
from pairweave.llm.url_vocabulary import SOFT, STRICT, Rules, Vocabulary, judge_urls, split_url

EDGE = r"[a-z0-9\u0080-\U0010ffff]"


def plain_counts(url, strict, soft):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    n = {t: len(re.findall(rf"(?<!{EDGE})(?={re.escape(t)}(?!{EDGE}))", text)) for t in {*strict, *soft}}
    soft = {t for t in soft if t not in strict}
    return sum(n[t] for t in strict), sum(n[t] for t in soft), sum(n[t] > 0 for t in soft)


@given(st.lists(st.sampled_from(["bets", "free", "casino", "-", ".", "/", "x", "é", "A", "BETS", "free-bets", "7"]), max_size=12))
def test_counts_equal_regular_expressions(parts):
    strict, soft = ("casino", "x"), ("free", "bets", "free-bets", "x")
    url = "".join(parts)
    assert Vocabulary(strict, soft).count(url) == plain_counts(url, strict, soft)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "")),
        ("", ("", "")),
        ("example.com/a", ("", "")),
        ("http://", ("", "")),
        ("HTTP://WWW.Example.COM/En/?q#f", ("www.example.com", "/En/")),
        ("x://a?b/c", ("a", "")),
        ("x://a#b?c/d", ("a", "")),
        ("x://a/b://c", ("a", "/b://c")),
        ("a:b://ÄB:80/Ä", ("Äb:80", "/Ä")),
    ],
)
def test_host_and_path(url, want):
    assert split_url(url) == want


@pytest.mark.parametrize(
    ("host", "path", "want"),
    [
        ("example.com", "/en/1", ("example.com/en/", "block")),
        ("www.example.com", "/en/1", ("www.example.com/en/", "allow")),
        ("a.www.example.com", "/en/", ("www.example.com/en/", "allow")),
        ("notexample.com", "/en/1", ("com/", "allow")),
        ("example.com", "/en", ("com/", "allow")),
        ("example.com", "", None),
        ("com", "/", ("com/", "allow")),
        ("a.net", "/es/x", ("net/es/", "block")),
        ("a.net", "/en/x", None),
        ("anet", "/es/x", None),
        ("", "", None),
    ],
)
def test_longest_rule(host, path, want):
    assert Rules(URL_RULES).fit(host, path) == want


def test_equal_lengths_take_the_longer_host_then_the_first():
    rules = Rules([("block", "b.c", "/xx"), ("allow", "a.b.c", "/"), ("block", "a.b.c", "/")])
    assert rules.fit("a.b.c", "/xx") == ("a.b.c/", "allow")


def test_rows(spark):
    urls = [
        None,
        "",
        "http://casino-win.example.net/en/1",
        "http://blog.free-bets.example.net/en/1",
        "http://free.example.net/en/1",
        "http://freebets.example.net/en/1",
        "http://example.net/en/?q=FREE+Bets",
        "http://free-bets.example.net/fr/1",
        "https://casino.example.com/de/1",
        "http://example.net/" + "free-" * 200_000,
    ]
    rows = [(i, u, "c", True) for i, u in enumerate(urls)] + [(2, urls[2], "c", False), (None, urls[4], "c", None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, verdict string, host boolean").repartition(3)
    got = judge_urls(pages, URL_RULES)
    assert got.dtypes[0] == ("page_id", "int")
    found = sorted(((r.page_id, r.rule, r.verdict) for r in got.collect()), key=repr)
    want = [(i, None, v) for i, v in enumerate("allow allow block block allow allow block - - allow".split()) if v != "-"]
    want += [(7, "net/fr/", "block"), (8, "com/", "allow"), (2, None, "block"), (None, None, "allow")]
    assert found == sorted(want, key=repr)
    assert {r.n_soft for r in got.collect() if r.page_id == 9} == {200_000}
    scan = judge_urls(spark.createDataFrame(rows, pages.schema), URL_RULES)
    assert "Exchange" not in scan._jdf.queryExecution().executedPlan().toString()


def test_empty_table_and_no_terms(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(empty, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://casino.net/")], "page_id long, url string")
    assert judge_urls(one, (), (), ()).first().verdict == "allow"
    with pytest.raises(ValueError):
        Vocabulary((), ("",))


def test_vocabulary_is_lower_case_and_bounded():
    assert all(t == t.lower() for t in STRICT + SOFT)
    assert len(set(STRICT + SOFT)) < 200

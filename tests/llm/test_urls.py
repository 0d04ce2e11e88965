"""Rules, terms and their edges."""

import pytest

from noteforge.llm.urls import find_terms, judge_urls

CASES = [
    ("https://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://EXAMPLE.org/en/1?x=/es/", "example.org", "/en/1", "example.org/en/1", "block"),
    ("http://example.org/en/21", "example.org", "/en/21", "org/", "allow"),
    ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("http://spam.org/xxx", "spam.org", "/xxx", "org/", "allow"),
    ("http://spam.org", "spam.org", "", None, "block"),
    ("http://x.com/de/page#top", "x.com", "/de/page", "com/de/", "block"),
    ("http://x.com/fr/casino", "x.com", "/fr/casino", "com/fr/", "allow"),
    ("http://x.com/DE/", "x.com", "/DE/", None, "allow"),
    ("http://m.spam-farm.net/", "m.spam-farm.net", "/", None, "block"),
    ("http://spammers.net/", "spammers.net", "/", None, "allow"),
    ("http://ads-track.net/a", "ads-track.net", "/a", None, "block"),
    ("http://ads.net/ads/ads", "ads.net", "/ads/ads", None, "allow"),
    ("http://éads.net/track", "éads.net", "/track", None, "allow"),
    ("no scheme /casino/", "", "", None, "block"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("x://h?casino", "h", "", None, "block"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_cases(spark):
    rows = [(i, c[0], "kept") for i, c in enumerate(CASES)] + [(0, CASES[0][0], "kept")]
    got = judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, host string")).orderBy("page_id").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["url"], r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["page_id"]]


@pytest.mark.parametrize("strict,soft", [((), ()), (("a",), ())])
def test_small_vocabularies(strict, soft):
    assert find_terms("b-a-c a", strict, soft) == (list(strict), [])


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id bigint, url string")).collect() == []

"""URL filter: host and path rules first, else a weighted vocabulary of URL terms.

All terms are found in one pass of an Aho-Corasick automaton. A term counts
only where no letter or digit stands next to it (characters beyond ASCII count
as letters). One strict term, or ``soft_limit`` different soft terms, block.

Defined results: a null url, and one without ``://``, have an empty host and
path; no rule fits an empty host, and a null url is allowed, as it holds no
term. An empty vocabulary allows all. Columns of the input are kept; those
named like a result are replaced. Rows are judged one by one, so repeated rows
have equal results and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import lower_ascii


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: One of these in a URL is enough.
STRICT = (
    "bestiality", "casino", "casinos", "escort", "escorts", "gore", "hardcore", "hentai", "malware", "phishing",
    "porn", "porno", "pornography", "spam", "spam-farm", "viagra", "warez", "xxx",
)
#: Several different ones of these are needed.
SOFT = (
    "ad", "adult", "ads", "bet", "betting", "cams", "cheap", "clickbait", "dating", "doubleclick", "erotic", "gambling",
    "jackpot", "loan", "loans", "nude", "pills", "poker", "promo", "sex", "sexy", "slots", "torrent", "track",
    "tracker", "tracking", "win",
)
SOFT_LIMIT = 2

TERM_TYPE = "struct<strict:array<string>,soft:array<string>>"
URL_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    trie = ahocorasick.Automaton()
    for term in soft:
        trie.add_word(term, (term, False))
    for term in strict:
        trie.add_word(term, (term, True))
    trie.make_automaton()
    return trie


def _joins_words(ch: str) -> bool:
    return ch >= "\x80" or "a" <= ch <= "z" or "0" <= ch <= "9"


def find_terms(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """The different strict and soft terms of a URL in lower case, sorted."""
    if not strict and not soft:
        return [], []
    hits: tuple[set[str], set[str]] = (set(), set())
    last = len(url) - 1
    for end, (term, is_strict) in _automaton(strict, soft).iter(url):
        start = end - len(term) + 1
        if start and _joins_words(url[start - 1]) or end < last and _joins_words(url[end + 1]):
            continue
        hits[not is_strict].add(term)
    return sorted(hits[0]), sorted(hits[1])


def terms_udf(strict: Sequence[str], soft: Sequence[str]):
    strict, soft = tuple(strict), tuple(soft)

    @F.arrow_udf(TERM_TYPE)
    def terms(urls: pa.Array) -> pa.Array:
        found = [find_terms(u or "", strict, soft) for u in urls.to_pylist()]
        texts = pa.list_(pa.string())
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], texts), pa.array([f[1] for f in found], texts)], ["strict", "soft"]
        )

    return terms


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict``, ``strict_terms`` and ``soft_terms``. A projection: no shuffle."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = lower_ascii(F.regexp_extract(text, URL_PARTS, 1))
    path = F.regexp_extract(text, URL_PARTS, 2)
    terms = terms_udf(strict, soft)(lower_ascii(F.col(url)))
    df = pages.withColumn("_terms", terms).withColumn("_host", host).withColumn("_path", path)
    h, p = F.col("_host"), F.col("_path")
    longest_first = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
    rule = F.coalesce(*[F.when(_fits(r, h, p), r.name) for r in longest_first], F.lit(None).cast("string"))
    by_rule = F.coalesce(*[F.when(_fits(r, h, p), r.verdict) for r in longest_first], F.lit(None).cast("string"))
    n_strict, n_soft = F.size("_terms.strict"), F.size("_terms.soft")
    by_terms = F.when((n_strict >= 1) | (n_soft >= soft_limit), "block").otherwise("allow")
    return df.withColumns({
        "host": h, "path": p, "rule": rule, "verdict": F.coalesce(by_rule, by_terms),
        "strict_terms": F.col("_terms.strict"), "soft_terms": F.col("_terms.soft"),
    }).drop("_terms", "_host", "_path")

"""URL filters by weighted vocabulary.

An Aho-Corasick automaton finds the terms of a vocabulary, words and phrases with every way to join
their parts, in one pass over the lower-cased URL; a hit counts only between boundaries, and of hits
that overlap the leftmost longest one alone. A URL is rejected when its distinct terms weigh enough
together: one strict term, or several soft ones.
Host rules come first; the longest fitting rule wins.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Host rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The vocabulary that is used unless another file is given.
VOCABULARY = os.path.join(os.path.dirname(os.path.abspath(__file__)), "url_terms.txt")
#: Weight of distinct terms that rejects, and the weight from which a term is strict.
LIMIT = STRICT = 2.0
# What may stand between the parts of a phrase, which vocabularies write with -.
JOINERS = ("-", "_", ".", "+", "%20", "")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Weights by term, from lines of a term, a tab and a weight; lines that begin with # and empty lines don't count.

    Read on the driver; terms are lower-cased. A line without a weight above 0 raises ValueError.
    """
    out: dict[str, float] = {}
    with open(path, encoding="utf-8") as f:
        for line in map(str.rstrip, f):
            if line and not line.startswith("#"):
                term, _, weight = line.partition("\t")
                if not term or not weight or float(weight) <= 0:
                    raise ValueError(f"{path}: a term and its weight are needed: {line!r}")
                out[term.translate(LOWER)] = float(weight)
    return out


def url_parts(url):
    """(host, path) columns of a url column; both empty where it is null or has no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host, path, rules=RULES):
    """(rule, verdict) columns of the longest fitting rule, null if none fits."""
    rule = verdict = None
    for kind, domain, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule = F.when(fits, domain + prefix) if rule is None else rule.when(fits, domain + prefix)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def spellings(vocabulary: dict[str, float]) -> dict[str, str]:
    """Terms by each of their spellings; a spelling that is a term itself, or an earlier term's, stays that one's."""
    out = {term: term for term in vocabulary}
    for term in vocabulary:
        parts = term.split("-")
        if len(parts) > 1 and all(parts):
            for between in itertools.product(JOINERS, repeat=len(parts) - 1):
                out.setdefault(parts[0] + "".join(j + p for j, p in zip(between, parts[1:], strict=True)), term)
    return out


def build_automaton(vocabulary: dict[str, float]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for spelling, term in spellings(vocabulary).items():
        automaton.add_word(spelling, (len(spelling), term, vocabulary[term]))
    automaton.make_automaton()
    return automaton


def find_terms(automaton: ahocorasick.Automaton, url: str) -> dict[str, float]:
    """The distinct terms of a lower-cased URL, with their weights: bounded hits, from the left, the longest first, none within another."""
    if not len(automaton):
        return {}
    hits = []
    for end, (length, term, weight) in automaton.iter(url):
        start = end - length + 1
        if (start == 0 or not is_word(url[start - 1])) and (end + 1 == len(url) or not is_word(url[end + 1])):
            hits.append((start, -end, term, weight))
    found, upto = {}, -1
    for start, end, term, weight in sorted(hits):
        if start > upto:
            found[term], upto = weight, -end
    return found


def is_word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, vocabulary: dict[str, float] | None = None, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, strict_hits, soft_hits, weight, verdict for every row of ``pages``.

    A null or empty url has empty parts, no hits and is allowed. Other columns are ignored and
    never read; repeated rows are judged one by one; an empty table gives no rows; a url of any
    length is read whole. There is no shuffle. ``vocabulary`` (as of ``read_vocabulary``) goes to
    the tasks as it is: some hundred terms.
    """
    terms = read_vocabulary() if vocabulary is None else vocabulary

    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = build_automaton(terms)
        for urls in batches:
            out = []
            for url in urls:
                weights = find_terms(automaton, url.translate(LOWER)).values() if url else ()
                strict = sum(w >= STRICT for w in weights)
                out.append((strict, len(weights) - strict, float(sum(weights))))
            yield pd.DataFrame(out, columns=["strict_hits", "soft_hits", "weight"]).astype({"strict_hits": "int32", "soft_hits": "int32", "weight": "float64"})

    counted = F.pandas_udf(hits, "strict_hits int, soft_hits int, weight double")
    url = F.col(url_col)
    host, path = url_parts(url)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), counted(url).alias("hits"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("hits.weight") >= limit, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), "hits.*", F.coalesce(verdict, own).alias("verdict"))

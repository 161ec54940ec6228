"""URL filter: rules indexed by their rarest literal token. Native: DataFrame functions only.

A URL's tokens fetch the rules indexed under them, and only those rules run their regular expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, lookup, may_broadcast

_TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A rule on hosts and their subdomains (host and path prefix), or on any URL (pattern, for host + path).

    tokens: literal tokens, lower case, that stand whole in host + path of each URL that the rule fits.
    """

    name: str
    verdict: str
    regex: str
    rank: int
    tokens: tuple[str, ...]


def host_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """Fits the host, its subdomains, and paths that start with `path`. Longer rules outrank shorter ones."""
    text = host + path
    whole = [m for m in re.finditer(_TOKEN, text.lower()) if m.end() < len(text)]  # a token at the end may go on in the URL
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", 1_000_000 + len(text), tuple(dict.fromkeys(m[0] for m in whole)))


def word_rule(verdict: str, word: str) -> Rule:
    """Fits URLs whose host holds the word whole, between dots, hyphens or the ends. Any host rule outranks it."""
    return Rule(word, verdict, rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|\z)", len(word), tuple(re.findall(_TOKEN, word)))


def segment_rule(verdict: str, word: str) -> Rule:
    """Fits URLs that have the word as a whole segment of their path. Any host rule outranks it."""
    return Rule(f"/{word}/", verdict, rf"^[^/]*/(?:[\s\S]*/)?{re.escape(word)}(?:/|\z)", len(word), tuple(re.findall(_TOKEN, word)))


def label_rule(verdict: str, label: str) -> Rule:
    """Fits URLs whose host starts with the label. Any host rule outranks it."""
    return Rule(f"{label}.", verdict, rf"^{re.escape(label)}\.", len(label), tuple(re.findall(_TOKEN, label)))


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ? or #; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _values(spark: SparkSession, rows: list[dict], columns: str) -> DataFrame:
    """A small table from the driver as one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{columns}>>")))


def rule_table(spark: SparkSession, rules: Sequence[Rule], seen: DataFrame) -> DataFrame:
    """(token, regex, name, verdict, rank): each rule under that of its tokens which the fewest URLs have.

    seen: (token, urls) for the tokens of rules. Rules without a token are not in it.
    """
    rows = [{"id": i, "name": r.name, "verdict": r.verdict, "regex": r.regex, "rank": r.rank, "token": t} for i, r in enumerate(rules) for t in r.tokens]
    table = _values(spark, rows, "id: int, name: string, verdict: string, regex: string, rank: int, token: string")
    counted = table.join(seen, "token", "left").withColumn("urls", F.coalesce("urls", F.lit(0)))
    return counted.groupBy("id", "name", "verdict", "regex", "rank").agg(F.min_by("token", F.struct("urls", "token")).alias("token")).drop("id")


def judge(urls: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """For each distinct url: host, path, rule, verdict.

    The rule of the highest rank (ties: the smaller name, then the smaller verdict) decides; without one, the rule is
    null and the verdict `default`. A null url has an empty host and path. Copies of a url are judged once: they are
    merged, on the map side first, before tokens are drawn. Empty urls or no rules: defined results all the same.
    """
    spark = urls.sparkSession
    one = urls.select(F.col(url).alias("url")).distinct()
    parsed = cut(one.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")), "urls")
    if not rules:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    target = F.concat("host", "path")
    tokens = F.array_distinct(F.regexp_extract_all(F.translate(target, UPPER, LOWER), F.lit(f"({_TOKEN})"), F.lit(1)))
    words = parsed.filter(F.col("host") != "").select("url", target.alias("target"), F.explode(tokens).alias("token"))
    wanted = cut(_values(spark, [{"token": t} for t in sorted({t for r in rules for t in r.tokens})], "token: string"), "rule-tokens")
    seen = cut(lookup(words.select("token"), wanted, ["token"], "inner").groupBy("token").agg(F.count(F.lit(1)).alias("urls")), "token-counts")
    index = cut(rule_table(spark, rules, seen), "rule-index")
    fits = _fetch(words, index).filter(F.rlike("target", F.col("regex"))).select("url", "rank", "name", "verdict")
    bare = [r for r in rules if not r.tokens]
    if bare:
        # without a token to look up, each is tried on every URL, in a projection
        tried = [F.when(F.rlike(target, F.lit(r.regex)), F.struct(F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))) for r in bare]
        fits = fits.unionByName(parsed.filter("host != ''").select("url", F.inline(F.array_compact(F.array(*tried)))))
    best = fits.groupBy("url").agg(F.min(F.struct(-F.col("rank"), "name", "verdict")).alias("hit"))
    decided = parsed.join(best, "url", "left")
    return decided.select("url", "host", "path", F.col("hit.name").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def _fetch(words: DataFrame, index: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """The rules that each url's tokens fetch. A small index is broadcast; a large one is joined by a shuffle, whose hot tokens adaptive execution splits."""
    side = F.broadcast(index) if may_broadcast(index, max_rows) else index.hint("merge")
    return words.join(side, "token").drop("token")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """pages (all columns and rows kept) plus host, path, rule and verdict; columns of those names are replaced."""
    judged = judge(pages, rules, default, url).withColumnRenamed("url", "__url")
    plain = pages.drop("host", "path", "rule", "verdict")
    return plain.join(judged, plain[url].eqNullSafe(judged["__url"]), "left").drop("__url")

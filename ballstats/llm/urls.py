"""URL rules, found by their rarest literal token and only then matched as regular expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A pattern over ``host/path`` and the literal tokens that any match of it contains; without any it runs on every URL."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def site_rule(verdict: str, site: str) -> Rule:
    """A rule for a host, its subdomains and the paths that start as given, such as ``example.net/en/``."""
    host, _, path = site.partition("/")
    literal = "".join("\\" + c if not c.isalnum() else c for c in path)
    pattern = rf"(?s)^(?:[^\x00/]*\.)?{re.escape(host)}\x00/{literal}"
    tokens = re.findall("[a-z0-9]+", host) + re.findall("[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    return Rule(site, verdict, pattern, tuple(tokens))


RULES = (
    site_rule("block", "net/"),
    site_rule("allow", "example.net/en/"),
    site_rule("block", "example.com/de/"),
    site_rule("allow", "org/fr/"),
)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; none: empty."""
    return F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; none: empty."""
    host = F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; a ``://`` further on starts no other host."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*(/[^?#]*)", 1)


def rule_index(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Each rule under that one of its tokens which the fewest different URLs contain, or under the empty one if it has none."""
    spark = urls.sparkSession
    rows = [(i, r.name, r.verdict, r.pattern, list(r.tokens) or [""]) for i, r in enumerate(rules)]
    book = spark.createDataFrame(rows, "rule_no int, rule string, rule_verdict string, pattern string, tokens array<string>")
    wanted = book.select("rule_no", "rule", "rule_verdict", "pattern", F.explode("tokens").alias("token"))
    named = F.col("token").isin([t for r in rules for t in r.tokens])
    counts = urls.select(F.explode(F.array_distinct("tokens")).alias("token")).filter(named).groupBy("token").count()
    ranked = wanted.join(counts, "token", "left").groupBy("rule_no", "rule", "rule_verdict", "pattern")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("token")))
    return ranked.agg(rarest.getField("token").alias("token"))


def judge_urls(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules: Sequence[Rule] = RULES,
    default: str = "allow",
) -> DataFrame:
    """For each row: key, host, path, rule (or null) and verdict; the longest fitting rule wins.

    Rules are read once per different URL: its tokens fetch candidates from the index, and only
    candidates run their regular expression.  Of rules of one length the first in name order
    wins.  A rule without tokens is a candidate of every URL.  Without a rule the verdict is ``default``.  A null URL or one without ``://`` has an
    empty host and path and fits nothing.  Repeated rows each get their row; an empty table
    gives none.  Only key and URL are read.
    """
    rows = pages.select(F.col(key).alias(key), F.col(url).alias("_url"))
    target = F.concat(F.col("host"), F.lit("\0"), F.col("path"))
    tokens = F.regexp_extract_all(target, F.lit("([A-Za-z0-9]+)"))
    if not all(r.tokens for r in rules):
        tokens = F.concat(tokens, F.array(F.lit("")))
    urls = (
        rows.select("_url")
        .filter(F.col("_url").isNotNull())
        .distinct()
        .select("_url", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
        .filter(F.col("host") != "")
        .select("_url", target.alias("target"), tokens.alias("tokens"))
    )
    index = rule_index(urls, rules)
    candidates = urls.select("_url", "target", F.explode(F.array_distinct("tokens")).alias("token")).join(index, "token")
    fits = candidates.filter(F.expr("target rlike pattern"))
    best = F.min(F.struct((-F.length("rule")).alias("order"), F.col("rule"), F.col("rule_verdict")))
    winners = fits.groupBy("_url").agg(best.alias("best"))
    return rows.join(winners, "_url", "left").select(
        key,
        url_host(F.col("_url")).alias("host"),
        url_path(F.col("_url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )

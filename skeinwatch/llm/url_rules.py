"""Verdicts on URLs from pattern rules indexed by their rarest literal token.

A rule is a regular expression over `host + path` (host rules) or over the whole URL (patterns).
From its text come the tokens that any URL it fits must contain whole. Of these, the one that the fewest
URLs hold becomes its key. Each URL fetches the rules whose key is among its tokens by a join, and only
those are tried. Rules without such a token have the key of all URLs.

Everything is DataFrame functions. Rules are a table; whether it is broadcast is left to Spark,
which knows its size. Rules are numbered in order of strength, so the winner is an integer maximum.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = "[a-z0-9]+"
#: Host rules: verdict, host, path that the URL's path starts with.
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Patterns for the rest: `||` begins a host label, `|` an end of the URL, `*` anything, `^` a separator or the end; `@@` allows.
PATTERNS = (
    "||spam-farm.",
    "||cheap-pills.",
    "/casino/",
    "/ads/*banner",
    "^utm_medium=spam^",
    ".exe|",
    ".zip|",
    "||doubleclick.net^",
    "@@||archive.*/wiki/",
)


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _literals(text: str, open_left: bool, open_right: bool) -> list[str]:
    """Tokens of a literal part of a rule that are whole tokens of every URL the rule fits."""
    text = text.lower()
    return [
        m[0] for m in re.finditer(_TOKEN, text)
        if (m.start() > 0 or not open_left) and (m.end() < len(text) or not open_right)
    ]


def host_rule(verdict: str, host: str, path: str) -> dict:
    return {
        "rule": host + path, "verdict": verdict, "by_host": True,
        "regex": rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}".replace(r"\/", "/"),
        "literals": _literals(host + path, False, True),
    }


def pattern_rule(pattern: str) -> dict:
    """A pattern with its wildcards as a regular expression, case-insensitive for A-Z."""
    allow, body = pattern.startswith("@@"), pattern.removeprefix("@@")
    regex, literals = "(?i)", []
    if body.startswith("||"):
        regex, body, open_left = regex + r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", body[2:], False
    elif body.startswith("|"):
        regex, body, open_left = regex + "^", body[1:], False
    else:
        open_left = True
    closed = body.endswith("|")
    parts = re.split(r"([*^])", body.removesuffix("|"))
    for i, part in enumerate(parts):
        if part == "*":
            regex, open_left = regex + r"[\s\S]*", True
        elif part == "^":
            regex, open_left = regex + r"(?:[^a-z0-9_.%-]|$)", False
        elif part:
            follows = parts[i + 1] if i + 1 < len(parts) else ""
            open_right = follows == "*" or not follows and not closed
            literals += _literals(part, open_left, open_right)
            regex, open_left = regex + re.escape(part).replace(r"\/", "/"), True
    return {
        "rule": pattern, "verdict": "allow" if allow else "block", "by_host": False,
        "regex": regex + (r"\z" if closed else ""), "literals": literals,
    }


def rules_table(spark: SparkSession, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """Compiled rules, numbered by strength: host rules before patterns, then the longer, then block before allow.

    Among patterns an exception (`@@`) is stronger than any block. Repeated rules count once.
    """
    rules = {r["rule"] + r["verdict"] + str(r["by_host"]): r for r in (*[host_rule(*r) for r in host_rules], *map(pattern_rule, patterns))}
    order = sorted(rules.values(), key=lambda r: (r["by_host"], not r["by_host"] and r["verdict"] == "allow", len(r["rule"]), r["verdict"] == "block", r["rule"]))
    rows = [
        F.struct(
            F.lit(i).alias("number"), F.lit(r["rule"]).alias("rule"), F.lit(r["verdict"]).alias("verdict"), F.lit(r["by_host"]).alias("by_host"),
            F.lit(r["regex"]).alias("regex"), F.array(*[F.lit(t) for t in sorted(set(r["literals"]))]).cast("array<string>").alias("literals"),
        )
        for i, r in enumerate(order)
    ]
    empty = "array<struct<number:int,rule:string,verdict:string,by_host:boolean,regex:string,literals:array<string>>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(empty)))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return _lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Distinct tokens, and the empty one that every URL has."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(_lower(F.coalesce(url, F.lit(""))), F.lit(f"({_TOKEN})"), F.lit(1))))


def rule_index(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """`rules` with `token`: of a rule's literals the one in the fewest of `urls` (ties: the first by name), else empty."""
    wanted = rules.select(F.explode("literals").alias("token")).distinct()
    seen = (
        urls.select(F.explode(url_tokens(F.col(url))).alias("token"))
        .join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    )
    keys = (
        rules.select("number", F.explode("literals").alias("token")).join(seen, "token", "left")
        .groupBy("number").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("k"))
        .select("number", F.col("k.token").alias("token"))
    )
    return rules.drop("literals").join(keys, "number", "left").withColumn("token", F.coalesce("token", F.lit("")))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """One row per page: `keep`, host, path, rule (the host rule that decided, else null), verdict, pattern (the pattern that decided, else null).

    A host rule fits its host and subdomains if the path starts with the rule's; the longest wins. With
    none, the strongest fitting pattern decides, and with none of these `default`. Null and
    malformed URLs have an empty host and path. Repeated rows each have their result; columns not in `keep` are not read.
    """
    index = rule_index(pages, rules, url)
    host, path = url_parts(F.col(url))
    rows = pages.select(*keep, F.monotonically_increasing_id().alias("_row"), F.coalesce(url, F.lit("")).alias("_url"), host.alias("host"), path.alias("path"))
    tried = rows.select("*", F.explode(url_tokens(F.col("_url"))).alias("token")).join(index.select("token", "number", "by_host", "regex"), "token", "left")
    fits = F.rlike(F.when(F.col("by_host"), F.concat("host", "path")).otherwise(F.col("_url")), F.col("regex"))
    best = tried.groupBy("_row", *keep, "host", "path").agg(F.max(F.when(fits, F.col("number"))).alias("number"))
    named = best.join(rules.select("number", "rule", "verdict", "by_host"), "number", "left")
    return named.select(
        *keep, "host", "path",
        F.when(F.col("by_host"), F.col("rule")).alias("rule"),
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
        F.when(~F.col("by_host"), F.col("rule")).alias("pattern"),
    )

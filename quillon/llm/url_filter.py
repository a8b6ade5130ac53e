"""URL filters: rules indexed by their rarest literal token.

A URL is cut into tokens (runs of ASCII letters and digits). Every rule is filed under one literal token that each URL
it can match must contain as a whole token; of its tokens the one that the fewest URL tokens equal. The tokens of a
URL fetch candidate rules by an equi-join, and only those run their regular expressions. Rules without any such token
are filed under the empty token, which every URL has.

Plan: scan (url columns) -> explode tokens -> broadcast hash join with the rule index -> regex filter -> one partial
and one final aggregate on a unique row number, so no URL or host, however common, gathers in one task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import at, columns_but, lower_ascii, packed, unpacked

#: Rule indexes up to this many rules are broadcast (some 200 bytes each); larger ones are joined by a shuffle.
MAX_BROADCAST_RULES = 200_000
#: Tokens up to this many stand in the plan itself, more in a table; rules of one file, which the driver holds.
MAX_LISTED_TOKENS, MAX_RULES = 200, 5_000_000


@dataclass(frozen=True)
class UrlRule:
    """One rule.

    kind "prefix": text is host/path; it fits the host and its subdomains when the path starts with the rule's path.
    kind "host_word": text is a word that stands alone between other characters than letters and digits in the host.
    kind "glob": text has `*` (anything), `^` (a separator or the end), and may start with `||` (a domain or
    subdomain) or `|` (start) and end with `|` (end); letters match in either case.
    """

    text: str
    action: str = "block"
    kind: str = "prefix"


#: The rules of the contract, host and path as one string.
PREFIX_RULES = (
    UrlRule("com/en/", "block"),
    UrlRule("example.com/en/7", "allow"),
    UrlRule("net/de/", "allow"),
    UrlRule("example.net/de/8", "block"),
    UrlRule("org/es/", "block"),
)
#: Words of host names that a text corpus leaves out, and paths that hold no prose.
PATTERN_RULES = tuple(UrlRule(w, "block", "host_word") for w in ("adult", "bets", "casino", "gambling", "pills", "poker", "porn", "spam", "track", "viagra", "xxx")) + (
    UrlRule("/wp-login.", "block", "glob"),
    UrlRule("/cgi-bin/", "block", "glob"),
    UrlRule("||doubleclick.net^", "block", "glob"),
    UrlRule("/robots.txt|", "allow", "glob"),
)

_TOKEN = re.compile(r"[0-9a-z]+")


def compile_rule(rule: UrlRule) -> tuple[str, list[str]]:
    """The rule's regular expression, and the tokens that every URL it matches holds as whole tokens."""
    if rule.action not in ("block", "allow"):
        raise ValueError(f"unknown action {rule.action!r}")
    if rule.kind == "prefix":
        host, slash, path = rule.text.partition("/")
        host = "".join(c.lower() if c.isascii() else c for c in host)
        body = host + slash + path
        regex = rf"^(?:[^/]*\.)?{re.escape(body)}" if slash else rf"^(?:[^/]*\.)?{re.escape(body)}(?=/|$)"
        whole, open_end = body, bool(slash)
    elif rule.kind == "host_word":
        word = rule.text.lower()
        if not _TOKEN.fullmatch(word):
            raise ValueError(f"a host word has letters and digits only: {rule.text!r}")
        return rf"(?i)^[^/?#]*?://[^/?#]*(?<![0-9a-z]){word}(?![0-9a-z])", [word]
    elif rule.kind == "glob":
        text = rule.text
        head, tail = "", ""
        if text.startswith("||"):
            head, text = r"^[^/?#]*?://(?:[^/?#]*\.)?", text[2:]
        elif text.startswith("|"):
            head, text = "^", text[1:]
        if text.endswith("|"):
            tail, text = "$", text[:-1]
        parts = {"*": ".*", "^": r"(?:[^0-9A-Za-z_.%\-]|$)"}
        regex = "(?is)" + head + "".join(parts.get(c) or re.escape(c) for c in text) + tail
        low = "".join(c.lower() if c.isascii() else c for c in text)
        tokens = [m[0] for m in _TOKEN.finditer(low) if (m.start() > 0 or head) and (m.end() < len(low) or tail) and low[m.start() - 1 : m.start()] != "*" and low[m.end() : m.end() + 1] != "*"]
        return regex, tokens
    else:
        raise ValueError(f"unknown kind {rule.kind!r}")
    low = "".join(c.lower() if c.isascii() else c for c in whole)
    return regex, [m[0] for m in _TOKEN.finditer(low) if not (open_end and m.end() == len(low))]


def read_rules(spark: SparkSession, path: str) -> list[UrlRule]:
    """Rules from a text file, one a line: `prefix:host/path`, `word:` a word of hosts, all else a glob.

    `@@` before a rule allows. Empty lines and those that begin with `!` are passed over. Rules come in order of their
    text, each once.
    """
    lines = spark.read.text(path).select(F.btrim("value").alias("line")).where("line <> '' AND line NOT LIKE '!%'").distinct().limit(MAX_RULES + 1).collect()
    if len(lines) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = []
    for line in sorted(r.line for r in lines):
        action, text = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
        kind = {"prefix": "prefix", "word": "host_word"}.get(text.partition(":")[0], "glob") if ":" in text else "glob"
        found.append(UrlRule(text if kind == "glob" else text.partition(":")[2], action, kind))
    return found


def _parts(url):
    """Host and path of a URL column, as the contract cuts them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def _tokens(url):
    """The distinct tokens of a URL, and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(lower_ascii(F.coalesce(url, F.lit(""))), "[^0-9a-z]+")))


def token_counts(df: DataFrame, tokens: Sequence[str], url: str = "url") -> dict[str, int]:
    """How many URLs hold each of the given tokens; counted over all rows, the result is as small as the token list."""
    found = df.select(F.explode(_tokens(at(url))).alias("token"))
    if len(tokens) <= MAX_LISTED_TOKENS:
        found = found.where(F.col("token").isin(list(tokens)))
    else:
        wanted = df.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
        found = found.join(F.broadcast(wanted) if len(tokens) <= MAX_BROADCAST_RULES else wanted, "token", "left_semi")
    return {r[0]: r[1] for r in found.groupBy("token").count().collect()}


def rule_index(spark: SparkSession, prefix_rules: Sequence[UrlRule], pattern_rules: Sequence[UrlRule], counts: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(token, rank, regex, on_parts), and (rank, rule, pattern, verdict). A higher rank wins.

    Prefix rules outrank pattern rules, and the longest of them wins (ties: the later in text order); of pattern rules
    an allowing one wins.
    """
    ranked = sorted(pattern_rules, key=lambda r: (r.action == "allow", r.text)) + sorted(prefix_rules, key=lambda r: (len(r.text), r.text))
    index, said = [("", 0, None, False)], []
    for rank, rule in enumerate(ranked, 1):
        regex, tokens = compile_rule(rule)
        token = min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        index.append((token, rank, regex, rule.kind == "prefix"))
        said.append((rank, rule.text if rule.kind == "prefix" else None, None if rule.kind == "prefix" else rule.text, rule.action))
    left = spark.createDataFrame(index, "token string, __rank int, __regex string, __on_parts boolean")
    right = spark.createDataFrame(said, "__rank int, rule string, pattern string, verdict string")
    return left, right


def filter_urls(df: DataFrame, prefix_rules: Sequence[UrlRule] = PREFIX_RULES, pattern_rules: Sequence[UrlRule] = PATTERN_RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """Judge the URL of every row.

    Adds host, path, rule (the prefix rule that decided, else null), pattern (the pattern rule that decided, else
    null) and verdict. Columns of these names in the input are replaced, all others are kept.

    Edge cases: a null URL, or one without `://`, has an empty host and path and gets the default verdict (a glob
    without an anchor may still match the text of the latter). Repeated rows each get their own row back. An empty
    table gives an empty result. Very long URLs are handled whole; the URL is copied only for its candidates.
    """
    spark = df.sparkSession
    rules = [*prefix_rules, *pattern_rules]
    wanted = sorted({t for r in rules for t in compile_rule(r)[1]})
    index, said = rule_index(spark, prefix_rules, pattern_rules, token_counts(df, wanted, url))
    if len(rules) <= MAX_BROADCAST_RULES:
        index, said = F.broadcast(index), F.broadcast(said)
    out = ("host", "path", "rule", "pattern", "verdict")
    kept = columns_but(df, out)
    host, path = _parts(at(url))
    rows = df.select(F.monotonically_increasing_id().alias("__row"), packed(kept), at(url).alias("__url"), host.alias("host"), path.alias("path"))
    tokens = rows.select("*", F.explode(_tokens(F.col("__url"))).alias("token"))
    fits = (F.col("__rank") == 0) | F.expr("coalesce(CASE WHEN __on_parts THEN concat(host, path) ELSE coalesce(__url, '') END rlike __regex, false)")
    hits = tokens.join(index, "token").where(fits)
    best = hits.groupBy("__row").agg(F.first("__in").alias("__in"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("__rank").alias("__rank"))
    judged = best.join(said, "__rank", "left")
    return judged.select(*unpacked(kept), "host", "path", "rule", "pattern", F.coalesce("verdict", F.lit(default)).alias("verdict"))

"""Operator 2: URL filters, in DataFrame expressions only.

A pattern rule is a regular expression over a URL's host and path and a verdict. Each rule
is indexed by its rarest literal token, the one that the fewest URLs hold; the tokens of a URL
fetch its candidate rules, and only those run their regular expression. Rules without a
whole literal token are candidates of every URL.

Two kinds of rules: host rules (a domain with all its subdomains, and a path prefix), whose
longest match decides; and, for URLs that none of them fits, filter patterns with `*` and `^`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the registered query: host and path, verdict.
HOST_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Filter patterns for what no host rule fits: `||` begins at a domain, `*` is anything, `^` parts tokens or ends the URL.
FILTERS = (("||ads-track.*^", "block"), ("||free-bets.*^", "block"), ("||cheap-pills.*^", "block"), ("||casino.*^", "block"), ("/adserver/*", "block"), ("^banner^*^ads^", "block"), ("||blog.*/en/*.html", "allow"))
#: Verdict of a URL that no rule fits.
OTHERWISE = "allow"
#: Up to so many rules the index is broadcast, which its size allows; a longer list is joined by shuffling.
MOST_BROADCAST = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    text: str
    pattern: str
    verdict: str
    priority: int
    tokens: tuple[str, ...]


def host_rule(text: str, verdict: str) -> Rule:
    """host/path: fits the host and its subdomains where the path starts with /path."""
    pattern = r"^(?:[^/]*\.)?" + re.escape(text)
    ends = [m.end() for m in re.finditer(TOKEN, text)]
    tokens = tuple(m[0] for m in re.finditer(TOKEN, text) if m.end() != len(text) or m.end() not in ends)
    return Rule(text, pattern, verdict, 1_000_000 + len(text), tokens)


def filter_rule(text: str, verdict: str) -> Rule:
    """A filter pattern; its whole tokens are those with a literal mark or the pattern's anchor on both sides."""
    anchored = text.startswith("||")
    body = text[2:] if anchored else text
    parts = {"*": ".*", "^": "(?:[^A-Za-z0-9_.%-]|$)"}
    pattern = (r"^(?:[^/]*\.)?" if anchored else "") + "".join(parts.get(c, re.escape(c)) for c in body)
    tokens = tuple(m[0] for m in re.finditer(TOKEN, body) if (m.start() > 0 or anchored) and body[m.start() - 1 : m.start()] != "*" and m.end() < len(body) and body[m.end()] != "*")
    return Rule(text, pattern, verdict, len(text), tokens)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def index(spark: SparkSession, rules: list[Rule], tokens: DataFrame) -> DataFrame:
    """A row for each rule: token (its rarest by the URLs of `tokens`, empty if it has none), number and the rest."""
    flat = [(i, r.text, r.pattern, r.verdict, r.priority) for i, r in enumerate(rules)]
    named = spark.createDataFrame(flat, "number int, rule string, pattern string, rule_verdict string, priority int")
    own = spark.createDataFrame([(i, t) for i, r in enumerate(rules) for t in set(r.tokens)], "number int, token string")
    counts = tokens.join(_small(own.select("token").distinct(), len(rules)), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = own.join(counts, "token", "left").groupBy("number").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("best"))
    return named.join(rarest, "number", "left").select(F.coalesce("best.token", F.lit("")).alias("token"), "number", "rule", "pattern", "rule_verdict", "priority")


def _small(rules: DataFrame, size: int) -> DataFrame:
    return F.broadcast(rules) if size <= MOST_BROADCAST else rules


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, filters=FILTERS, otherwise: str = OTHERWISE, url: str = "url") -> DataFrame:
    """pages with host, path, rule (the longest host rule that fits, else null), pattern (of the filter that decides where none does) and verdict.

    A null URL, or one without ``://``, has an empty host and path and fits no host rule.
    Ties between rules of one length go to the one given first. Repeated rows are judged one
    by one; columns of pages with the added names, in any case of letters, are replaced. URLs of any length work.
    """
    rules = [host_rule(*r) for r in host_rules] + [filter_rule(*r) for r in filters]
    pages = pages.drop("host", "path", "rule", "pattern", "verdict")
    own = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in pages.columns])  # in a struct, no name of theirs clashes with one used here
    parsed = pages.select(own.alias("_own"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("_at", F.concat("host", "path"))
    tokens = F.array_distinct(F.split("_at", "[^A-Za-z0-9]+"))
    counted = parsed.select(F.explode(tokens).alias("token")).where(F.col("token") != "")
    indexed = _small(index(pages.sparkSession, rules, counted), len(rules))

    # A URL's own row has no token, so it is kept whatever its candidates; rules are few after the join.
    row = parsed.withColumn("_row", F.monotonically_increasing_id())
    asked = row.withColumn("token", F.explode(F.array_union(F.array(F.lit("")), tokens)))
    fits = F.rlike("_at", F.col("pattern"))
    if len(rules) <= MOST_BROADCAST:
        met = asked.join(indexed, "token", "left")
    else:  # every URL asks for the rules without a token, so these must be few; they never are one key of the shuffle
        if sum(not r.tokens for r in rules) > MOST_BROADCAST:
            raise ValueError(f"more than {MOST_BROADCAST} rules have no whole literal token")
        free = indexed.where(F.col("token") == "")
        own = asked.where(F.col("token") == "").join(F.broadcast(free), "token", "left")
        met = own.unionByName(asked.where(F.col("token") != "").join(indexed.where(F.col("token") != ""), "token"))
    hits = met.withColumn("_fits", F.coalesce(fits, F.lit(False))).where(F.col("_fits") | (F.col("token") == ""))
    found = F.when(F.col("_fits"), F.struct(F.col("priority"), (-F.col("number")).alias("order"), "rule", "rule_verdict"))
    best = hits.groupBy("_row").agg(F.first(F.struct("_own", "host", "path")).alias("_row_of"), F.max(found).alias("_best")).select("_row_of.*", "_best")
    is_host = F.col("_best.priority") >= 1_000_000
    return best.select(
        "_own.*", "host", "path", F.when(is_host, F.col("_best.rule")).alias("rule"), F.when(~is_host, F.col("_best.rule")).alias("pattern"),
        F.coalesce("_best.rule_verdict", F.lit(otherwise)).alias("verdict"),
    )


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql_filter(text: str) -> str:
    """A filter pattern as a DuckDB expression over at_."""
    return f"regexp_matches(at_, '{filter_rule(text, '').pattern}')"


OP2_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES {", ".join(f"('{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}', '{v}')" for t, v in HOST_RULES)}
), fitting AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, m.verdict) AS verdict
FROM (SELECT *, host || path AS at_ FROM split) s LEFT JOIN fitting f USING (page_id),
LATERAL (SELECT CASE {" ".join(f"WHEN {_sql_filter(t)} THEN '{v}'" for t, v in sorted(FILTERS, key=lambda x: -len(x[0])))} ELSE '{OTHERWISE}' END AS verdict) m
"""

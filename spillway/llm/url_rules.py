"""Operator 9, URL filters: patterns indexed by their rarest literal token.

A pattern is lower-case text in which ``*`` stands for anything, ``^`` for a
separator (a character that is none of a-z 0-9 _ . % -) or the end, ``||`` at the
beginning for the beginning of a host or of one of its parent domains, and ``|`` at
either end for that end of the URL. A literal token is a run of a-z and 0-9 that
any matching URL must hold as a whole token: it has a sign other than ``*`` on both sides.

Every rule is indexed by the one of its literal tokens that the fewest URLs hold,
counted over all URLs. A URL's tokens fetch candidate rules, and only these run their
regular expression, each in the JVM. Rules without a literal token (few, as any URL may match them) run on every
URL, as constant expressions of its projection. The rules' index is broadcast while it has at most FEW rows; above that the
join shuffles. A URL is handled whole, however long it is.

Defined cases. A null URL matches nothing; an empty one only rules without
literals. Upper and lower case count alike. Repeated rows each give their matches; a rule
listed twice under different ids gives both. Ties for the rarest token go to the first in
the alphabet. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

FEW = 500_000
RULES = [
    (1, "gambling", "||free-bets.example.com^"), (2, "gambling", "||*casino*.example.*^"), (3, "gambling", "-bets.example.com/"),
    (4, "adult", "||xxx*.example.*/"), (5, "adult", "/adult/"), (6, "tracking", "?utm_source=feed|"), (7, "tracking", "&ref="),
    (8, "tracking", "?page=*&ref=x"), (9, "blog", "://blog.*.example."), (10, "mobile", "||m.*.example.*^"), (11, "mobile", "://m."),
    (12, "anchor", "#top|"), (13, "insecure", "|http://"), (14, "language", ".example.org/de/"), (15, "language", "/fr/*.html|"),
    (16, "language", ".net/es/"), (17, "host", "||blog.tionsh.example.com^"), (18, "host", "||ththti.example.net^"), (19, "paging", "?page=2&"),
    (20, "spam", "/cheap-pills/"), (21, "spam", "||cheap-pills.example.*^"), (22, "spam", "||win-prizes.example.*^"), (23, "shortener", "://bit.ly/"),
    (24, "static", ".html|"), (25, "static", ".js|"), (26, "directory", "/en/*/|"), (27, "number", "/en/1|"), (28, "any", "*#*"),
]


def regex(pattern: str) -> str:
    """A regular expression for lower-case URLs that Java, RE2 and Python read alike."""
    head = tail = ""
    body = pattern
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    out = "".join({"*": ".*", "^": r"([^a-z0-9_.%-]|$)"}.get(c, c if re.match(r"[a-z0-9_/:=&%,;~<>@! -]", c) else "\\" + c) for c in body)
    return head + out + tail


def literals(pattern: str) -> list[str]:
    """Tokens that a URL must hold whole to match."""
    return sorted({m[0] for m in re.finditer("[a-z0-9]+", pattern) if m.start() > 0 and m.end() < len(pattern) and pattern[m.start() - 1] != "*" and pattern[m.end()] != "*"})


def matches(pages: DataFrame, rules: list[tuple[int, str, str]] = RULES, key: str = "page_id", few: int = FEW) -> DataFrame:
    """(key, url, rule_id, category) for each row and rule that matches it."""
    spark = pages.sparkSession
    urls = pages.select(F.col(key), "url").where("url is not null")
    token = F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("token")
    tokens = spark.createDataFrame([(i, t) for i, _, p in rules for t in literals(p)], "rule_id int, token string")
    table = spark.createDataFrame([(i, c, regex(p)) for i, c, p in rules], "rule_id int, category string, regex string")
    small = (lambda df: F.broadcast(df)) if len(rules) <= few else (lambda df: df)
    wanted = tokens.select("token").distinct()
    counts = urls.select(token).join(small(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = tokens.join(counts, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    index = ranked.select("rule_id", F.col("best.token").alias("token")).join(table, "rule_id")
    fetched = urls.select("*", token).join(small(index), "token")
    columns = [key, "url", "rule_id", "category"]
    out = fetched.where(F.expr("rlike(lower(url), regex)")).select(*columns)
    every = [F.when(F.lower("url").rlike(regex(p)), F.struct(F.lit(i).alias("rule_id"), F.lit(c).alias("category"))) for i, c, p in rules if not literals(p)]
    if not every:
        return out
    rest = urls.withColumn("__rule", F.explode(F.array_compact(F.array(*every))))
    return out.unionByName(rest.select(key, "url", "__rule.rule_id", "__rule.category"))


def keep(pages: DataFrame, categories: list[str], rules: list[tuple[int, str, str]] = RULES) -> DataFrame:
    """The rows whose URL matches no rule of the categories; rows without a URL stay."""
    bad = matches(pages.select(F.col("url")).distinct().withColumn("__k", F.lit(0)), [r for r in rules if r[1] in categories], "__k").select(F.col("url").alias("__url")).distinct()
    return pages.join(bad, pages["url"] == bad["__url"], "left_anti")


_VALUES = ", ".join(f"({i}, '{c}', '{p}')" for i, c, p in RULES)
# reads the patterns by itself, without ``regex``
ORACLE = f"""
WITH r AS (SELECT *, regexp_extract(pattern, '^([|]{{0,2}})(.*?)([|]?)$', ['head', 'body', 'tail']) AS part FROM (VALUES {_VALUES}) AS r(rule_id, category, pattern)),
x AS (SELECT rule_id, category, CASE part.head WHEN '||' THEN '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?' WHEN '|' THEN '^' ELSE '' END
  || replace(replace(regexp_replace(part.body, '([^a-z0-9])', '[\\1]', 'g'), '[*]', '(?s:.*)'), '[^]', '([^a-z0-9_.%-]|$)') || CASE part.tail WHEN '|' THEN '$' ELSE '' END AS regex FROM r)
SELECT p.page_id, p.url, x.rule_id, x.category FROM pages p JOIN x ON regexp_matches(lower(p.url), x.regex)
"""


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "pages"))

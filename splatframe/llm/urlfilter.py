"""URL filters: allow and block rules on hosts and paths, in DataFrame operations only.

A rule is a host and a path; it fits that host and its subdomains where the URL's path starts with the
rule's path. Each URL is expanded into host-suffix and path-prefix expressions: its host's suffixes of those numbers of labels, and its path's
prefixes of those lengths, that occur in the rules. The
expressions meet the rules in an equi-join on the first four bytes of SHA-256; the whole digests are compared
next, and of the rules that are left the longest wins.

URLs are expanded once each, however many pages share them. The rules' side is broadcast only if Spark finds
it below ``spark.sql.autoBroadcastJoinThreshold``; otherwise both sides are shuffled by the
hash prefix, and adaptive execution splits the prefixes of very common hosts.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule of a host.
A page that fits no rule gets *default* (allow). Of equally long rules the one with the longer host wins,
then block over allow. Repeated rules count once; rules with a null host, path or verdict are ignored. Every page keeps its
row, also repeated ones. Other columns of the pages are kept, whatever their names; columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, whole_row


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty if it is null or has no ``://``."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def _key(host: Column, path: Column) -> Column:
    """The expression of a host and a path. No host holds a slash, and every path that isn't empty starts with one."""
    return F.concat(host, F.lit("\n"), path)


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def _short(digest: Column) -> Column:
    """The first four bytes of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def host_suffixes(host: Column, counts: Column) -> Column:
    """The suffixes of those numbers of labels in *counts*: ``a.b.c`` has ``c`` for 1, ``b.c`` for 2 and ``a.b.c`` for 3."""
    return F.transform(F.filter(counts, lambda n: n <= _labels(host)), lambda n: F.call_function("substring_index", host, F.lit("."), -n))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """*pages* with host, path, rule and verdict, in place of columns of those names.

    *rules*: host, path, verdict (allow or block).
    """
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    digest = _digest(_key(F.col("host"), F.col("path")))
    listed = rules.select(
        digest.alias("rule_digest"), _short(digest).alias("short"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"), F.length("path").alias("path_length"), _labels(F.col("host")).alias("labels")
    )
    # One row: the lengths of paths and numbers of labels that rules have, at most as many as the longest path and host have characters.
    lengths = listed.agg(F.collect_set("path_length").alias("lengths"), F.collect_set("labels").alias("labels"))

    taken = {"host", "path", "rule", "verdict"}
    rows = pages.select(whole_row(pages).alias("row"), F.col(quoted(url)).alias("url"))
    host, path = split_url(F.col("url"))
    urls = rows.select("url").where(F.col("url").contains("://")).distinct().select("url", host.alias("host"), path.alias("path"))
    prefixes = F.transform(F.filter(F.col("lengths"), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    expressions = (
        urls.join(F.broadcast(lengths))  # a single row
        .select("url", F.explode(host_suffixes(F.col("host"), F.col("labels"))).alias("suffix"), prefixes.alias("prefixes"))
        .select("url", "suffix", F.explode("prefixes").alias("prefix"))
        .select("url", _digest(_key(F.col("suffix"), F.col("prefix"))).alias("digest"))
        .select("url", "digest", _short(F.col("digest")).alias("short"))
    )
    rank = F.struct(F.col("host_length") + F.col("path_length"), "host_length", F.col("verdict") == "block", "rule", "verdict")
    best = (
        expressions.join(listed, "short")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("url")
        .agg(F.max(rank.alias("rank")).alias("best"))
        .select(F.col("url").alias("judged"), "best")
    )
    told = rows.join(best, F.col("url") == F.col("judged"), "left")
    new = {"host": host, "path": path, "rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))}
    return told.select(*(F.col(f"row.{quoted(c)}").alias(c) for c in pages.columns if c.lower() not in taken), *(c.alias(n) for n, c in new.items()))


#: The rules that the registered query applies.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def url_verdicts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of each page by ``RULES``."""
    spark = pages.sparkSession
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge_urls(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_HOST = r"translate(regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1)"
ORACLE = f"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
best AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM judged), rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path
)
SELECT page_id, j.host, j.path, rule, coalesce(v, 'allow') AS verdict
FROM judged j LEFT JOIN best b ON j.host = b.host AND j.path = b.path
"""

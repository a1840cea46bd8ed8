"""URL filtering by hashed host-suffix and path-prefix expressions.

Each URL is expanded into the expressions ``host suffix + path prefix`` that a rule could have
written, the expressions meet the rules in an equi-join on a 32-bit hash prefix, full digests
confirm the hits, and the longest confirmed rule decides.

A rule's shape is (labels of its host, length of its path). A URL can only meet a rule of a shape
that some rule has, so a URL is expanded into one expression for each such shape it is long enough
for: complete for any rule set, and far fewer than all suffixes times all prefixes.

Cases: a null URL, or one without ``://``, has an empty host and path and meets no rule with a host.
Rules that are equal in length go by the longer host, then by the larger rule text. Two rules with
the same host and path but opposite verdicts: ``block`` wins. Repeated rows each get their verdict.
Columns of the input beside the id and the URL are ignored; null ids stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import ascii_lower

#: (host, path, verdict) of the production rules. Fixed values.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

#: Hex digits of the digest in the join key: 32 bits.
PREFIX_DIGITS = 8

#: Rule tables up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    rest = F.regexp_replace(_after_scheme(url), r"^[^/?#]+", "")
    return F.regexp_extract(rest, r"^[^?#]*", 0)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, the deciding rule or null, and the verdict."""
    urls = pages.select(
        F.col(id_col).alias("page_id"),
        url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"),
    )

    shaped = rules.select(
        F.col("host").alias("rule_host"),
        F.col("path").alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("path_length"),
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
    ).withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    # At most as many rows as a host has labels times a path has characters.
    shapes = [(r.labels, r.path_length) for r in shaped.select("labels", "path_length").distinct().collect()]
    if not shapes:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if rules.count() <= BROADCAST_RULES:
        shaped = F.broadcast(shaped)

    parts = F.split("host", r"\.")
    expressions = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.size(parts) >= labels) & (F.length("path") >= length),
                    F.struct(
                        F.array_join(F.slice(parts, -labels, labels), ".").alias("suffix"),
                        F.substring("path", 1, length).alias("prefix"),
                    ),
                )
                for labels, length in sorted(shapes)
            ]
        )
    )
    hits = (
        urls.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(expressions).alias("e"))
        .withColumn("digest", _digest(F.col("e.suffix"), F.col("e.prefix")))
        .join(shaped, F.substring("digest", 1, PREFIX_DIGITS) == F.col("rule_prefix"))
        .where(F.col("digest") == F.col("rule_digest"))
    )
    rank = F.struct(
        F.length("rule_host") + F.col("path_length"),
        F.length("rule_host"),
        F.col("rule_host"),
        F.col("rule_path"),
        F.col("rule_verdict"),
    )
    best = (
        hits.groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), rank).alias("best"))
        # A key of its own makes the join below shuffle both sides afresh, so that a URL with very
        # many rows can be split at run time.
        .select(F.xxhash64("host", "path").alias("k"), F.col("host").alias("h"), F.col("path").alias("p"), "best")
    )
    return (
        urls.withColumn("key", F.xxhash64("host", "path"))
        .join(best, (F.col("key") == F.col("k")) & (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        )
    )


ORACLE_SQL = """
WITH cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), named AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(regexp_replace(rest, '^[^/?#]+', ''), '^[^?#]*') AS path
    FROM cut
), rules(rh, rp, rv) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), met AS (
    SELECT host, path, rh || rp AS rule, rv,
           row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, length(rh) DESC, rh DESC) AS n
    FROM (SELECT DISTINCT host, path FROM named) u
    JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, n.host, n.path, rule, coalesce(rv, 'allow') AS verdict
FROM named n LEFT JOIN (SELECT * FROM met WHERE n = 1) m ON n.host = m.host AND n.path = m.path
"""

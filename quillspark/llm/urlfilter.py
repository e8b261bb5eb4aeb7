"""URL filters by hashed host-suffix and path-prefix expressions.

A URL stands for every suffix of its host at a label border joined with every
prefix of its path of a length that some rule has.  Expressions meet rules on
the first eight hexadecimal digits of their SHA-256; the full digest confirms a
match, and the longest rule decides.  Distinct (host, path head) pairs are
expanded, not pages, so a host with a third of all pages costs one row.

Defined results: a null url, or one without ``://``, has an empty host and
path; a url that no rule fits has a null rule and the default verdict; repeated
rows are judged alike; of rules of equal length the one with the longer host
wins, and of rules of equal host and path with different verdicts the one whose
verdict is greatest as a text (block before allow); rules with null parts fit
nothing; other columns are not read; empty tables give an empty result, or the
default verdict for all.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, table, written

#: (host, path, verdict) of the registered query: fixed by its contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Rules up to this number are sent to all executors; more are joined by a shuffle.
BROADCAST_RULES = 50_000


def parts(url):
    """Columns host and path of a url column."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id_col, host, path, rule, verdict`` of every page, by ``rules (host, path, verdict)``."""
    host, path = parts(pages[url_col])
    seen = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    digest = F.sha2(F.col("expression"), 256)
    known = rules.where("host is not null and path is not null and verdict is not null")
    known = known.groupBy(F.concat("host", "path").alias("expression")).agg(F.max(F.struct(F.length("host").alias("of_host"), "verdict")).alias("r")).select("expression", "r.of_host", "r.verdict")
    known = known.withColumns({"digest": digest, "short": F.substring(digest, 1, 8)}).withColumnRenamed("expression", "rule")
    lengths = sorted(r[0] for r in rules.where("path is not null").select(F.length("path")).distinct().collect())  # few: lengths of rule paths
    head = F.substring("path", 1, max(lengths, default=0))
    seen = seen.withColumn("head", head)
    sites = seen.select("host", "head").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array_distinct(F.array(*(F.substring("head", 1, n) for n in lengths))) if lengths else F.array(F.lit(""))
    expanded = sites.select("host", "head", F.explode(suffixes).alias("suffix"), starts.alias("starts")).select("host", "head", F.explode("starts").alias("start"), "suffix")
    expanded = expanded.select("host", "head", F.concat("suffix", "start").alias("expression")).withColumn("whole", digest).withColumn("short", F.substring("whole", 1, 8)).drop("expression")
    if known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        known = F.broadcast(known)
    hits = expanded.join(known, "short").where("whole = digest")
    order = F.struct(F.length("rule").alias("n"), F.col("of_host").alias("h"))
    best = hits.groupBy("host", "head").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    # written, so that the join back is one of two plain sides: it can be a broadcast, or a hot host be split
    out = seen.join(few(written(best, "verdicts"), BROADCAST_RULES), ["host", "head"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of ``pages``."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


OP4_SQL = """
WITH p AS (
  SELECT page_id,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS raw_host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
q AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
r(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT q.page_id, q.host, q.path,
       (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM r
         WHERE (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)) AS rule,
       coalesce((SELECT arg_max(r.verdict, length(r.host || r.path)) FROM r
         WHERE (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)), 'allow') AS verdict
FROM q
"""

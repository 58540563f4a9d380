"""URL rules by hashed host-suffix and path-prefix expressions, in native operations.

Each URL expands into (host suffix, path prefix) expressions. Expressions meet
rules on the first four bytes of their SHA-256; the full digest is compared
after that, so that a shared prefix alone never counts as a match. Of the rules
that fit, the longest wins; equal lengths cannot both fit with different texts
unless a host and a path trade a label, and then the smaller text wins.

Defined results: a null URL or one without ``://`` has an empty host and path
and gets the default verdict; a repeated rule counts once, and a rule listed
with both verdicts blocks; rules with a null or empty host are ignored; an
empty rule table leaves every URL with the default verdict; extra columns of
the input are carried through unless they bear one of the result's names,
which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.llm.text import read

#: Rules of the registered query: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """rule, verdict, digest and prefix of each distinct rule."""
    return (
        rules.where("coalesce(host, '') <> ''")
        .select(F.concat(F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))).alias("rule"), "verdict", F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
        .groupBy("rule", "rule_host", "rule_path")
        .agg(F.max("verdict").alias("verdict"))  # block sorts after allow
        .withColumn("digest", _digest(F.concat_ws("\n", "rule_host", "rule_path")))
        .withColumn("prefix", F.substring("digest", 1, 8))
    )


def expressions(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Host suffixes of up to ``labels`` labels, each with the path's prefixes of the given lengths.

    The two bounds come from the rules: no other expression can equal a rule.
    """
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(labels), F.size(parts))), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, 1, n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat_ws("\n", h, p))))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict."""
    named = pages.drop(*[c for c in pages.columns if c.lower() in {"host", "path", "rule", "verdict"}])
    named = named.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    known = rule_table(rules)
    shape = known.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0)).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    if not shape["n"]:
        return named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # each distinct host and path once, however often a page repeats it; no rule fits an empty host
    places = named.where("host <> ''").select("host", "path").distinct()
    met = places.withColumn("expression", F.explode(expressions(F.col("host"), F.col("path"), shape["labels"], sorted(shape["lengths"])))).withColumn("digest", _digest(F.col("expression"))).withColumn("prefix", F.substring("digest", 1, 8))
    right = known.select(F.col("prefix"), F.col("digest").alias("rule_digest"), "rule", F.col("verdict").alias("rule_verdict"))
    best = (
        met.join(right, "prefix")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "rule_verdict")).alias("best"))
    )
    out = named.join(best, ["host", "path"], "left")
    return out.withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.rule_verdict", F.lit(default))}).drop("best").select(*named.columns, "rule", "verdict")


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT u.*, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE k = 1
"""

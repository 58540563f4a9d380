"""Quality rules with thresholds that adapt per language and source, in native operations.

Each metric of a document is an integer. Histograms with 32 buckets to a power
of two (exact below 64, a relative error of at most 1/32 above) are the
quantile sketches: their counts add up, so sketches of partitions, sources and
languages merge exactly and in any order. The high fence of a metric is the
median plus ``spread`` times the distance from the median up to an upper quantile
of the group, the low fence the same downwards with the mirrored quantile. Only
where a group hardly varies on that side, so that the distance is under
``least``, does ``least`` stand in for it. Groups of fewer than ``min_group``
documents borrow the merged sketch of their language, or of all documents, as
their own quantiles would rest on single documents. The fences are joined back
and applied.

Defined results: a null or empty text has no words and fails the base rule;
null languages and sources form groups of their own; repeated rows are judged
alike, each on its own row; an empty table gives an empty result; extra columns
are carried through by ``filtered`` unless they bear a result's name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwarden.llm.text import GAPS, WORD, read, words
from inkwarden.session import stage



@dataclass(frozen=True)
class Fence:
    """How a metric's fences follow from its sketch; quantiles are in permille."""

    high: int  # upper quantile; its mirror is the lower one
    spread: int
    least: int
    low: bool = False  # whether there is a low fence


#: Symbols are judged by the quartile, which a quarter of junk documents does not move; repeats have a
#: long tail in clean text too, so their quantile is higher.
METRICS = {
    "symbol_pct": Fence(750, 6, 5),
    "repeat_permille": Fence(950, 10, 30),
    "dup_line_permille": Fence(950, 10, 45),
    "mean_chars_x100": Fence(750, 6, 25, low=True),
}
MIN_GROUP = 30
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def repeat_words(w: Column) -> Column:
    """Words in a 3-word window that the text has twice or more, in O(n log n) a text."""

    def covered(pos: Column) -> Column:
        steps = F.transform(pos, lambda p, k: F.when(k < F.size(pos) - 1, F.least(F.lit(3), F.get(pos, k + 1) - p)).otherwise(3))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def again(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(pairs, lambda p: let(F.array_sort(F.transform(F.filter(p, lambda s, k: ((k > 0) & (F.get(p, k - 1)["x"] == s["x"])) | ((k < F.size(p) - 1) & (F.get(p, k + 1)["x"] == s["x"]))), lambda s: s["i"])), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(again(h)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(counted).cast("long")


def features(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with the base counts, ``base_failed`` and the integer metrics of each document."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    counted = docs.select(
        *keys,
        let(words(body), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("c"),
        F.length(F.regexp_replace(body, GAPS, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("d"),
    ).select(*keys, "c.n_words", "word_chars", "n_symbols", "d.n_dup_lines", "c.n_repeat_words", "d.n_lines")
    per = lambda part, whole, times: F.when(F.col(whole) > 0, F.expr(f"{times} * {part} div {whole}")).otherwise(0).cast("long")
    return counted.withColumns({
        "base_failed": F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"),
        "symbol_pct": per("n_symbols", "n_words", 100),
        "repeat_permille": per("n_repeat_words", "n_words", 1000),
        "dup_line_permille": per("n_dup_lines", "n_lines", 1000),
        "mean_chars_x100": per("word_chars", "n_words", 100),
    })


def bucket(value: Column) -> Column:
    """The lower bound of a value's histogram bucket."""
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - 6)
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(found: DataFrame) -> DataFrame:
    """Histograms at each level: level 2 for a language and source, 1 for a language, 0 for all."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS]))
    fine = found.where(~F.col("base_failed")).select("lang", "source", cells.alias("m")).groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))
    nothing = F.lit(None).cast("string")
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), a.alias("lang"), b.alias("source")) for k, a, b in ((2, F.col("lang"), F.col("source")), (1, F.col("lang"), nothing), (0, nothing, nothing))]))
    return fine.select(levels.alias("l"), "metric", "bucket", "n").groupBy("l.level", "l.lang", "l.source", "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(found: DataFrame) -> DataFrame:
    """level, lang, source, docs, and low and high bounds of every metric; a low bound is null where the metric has none."""
    at = Window.partitionBy("level", "lang", "source", "metric")
    ranked = sketches(found).withColumns({"upto": F.sum("n").over(at.orderBy("bucket")), "docs": F.sum("n").over(at)})
    metric, upto, docs = F.col("metric"), F.col("upto"), F.col("docs")
    quantile = lambda m, k: F.min(F.when((metric == m) & (1000 * upto >= k * docs), F.col("bucket")))
    found_at = {(m, k): f"{m}_{k}" for m, rule in METRICS.items() for k in (500, rule.high, *([1000 - rule.high] if rule.low else []))}
    q = ranked.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *[quantile(*key).alias(name) for key, name in found_at.items()])
    limits = {}
    for m, rule in METRICS.items():
        middle = F.col(found_at[m, 500])
        away = lambda x, rule=rule: rule.spread * F.greatest(x, F.lit(rule.least))
        limits[f"high_{m}"] = middle + away(F.col(found_at[m, rule.high]) - middle)
        limits[f"low_{m}"] = middle - away(middle - F.col(found_at[m, 1000 - rule.high])) if rule.low else F.lit(None).cast("long")
    return q.select("level", "lang", "source", "docs", *[x.alias(name) for name, x in limits.items()])


def bounds(found: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """f_lang, f_source and the struct f of the fences that hold for each group of ``found``."""
    names = [f"{side}_{m}" for m in METRICS for side in ("low", "high")]
    every = fences(found)
    level = lambda k: every.where(F.col("level") == k)
    groups = level(2).select("lang", "source", "docs", F.struct(*names).alias("g"))
    langs = level(1).select("lang", F.col("docs").alias("lang_docs"), F.struct(*names).alias("l"))
    whole = level(0).select(F.lit(1).alias("one"), F.struct(*names).alias("w"))
    same = lambda *cols: reduce(lambda a, b: a & b, [F.col(f"k.{c}").eqNullSafe(F.col(f"o.{c}")) for c in cols])
    return (
        found.select("lang", "source").distinct().withColumn("one", F.lit(1)).alias("k")
        .join(groups.alias("o"), same("lang", "source"), "left").select("k.*", "docs", "g").alias("k")
        .join(langs.alias("o"), same("lang"), "left").select("k.*", "lang_docs", "l")
        .join(whole, "one", "left")
        .select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), F.when(F.col("docs") >= min_group, F.col("g")).when(F.col("lang_docs") >= min_group, F.col("l")).otherwise(F.col("w")).alias("f"))
    )


def apply_bounds(found: DataFrame, limits: DataFrame) -> DataFrame:
    """``found`` with ``kept``. Rows of a hot group stay where they are: the small side moves."""
    inside = reduce(lambda a, b: a & b, [(F.col(m) <= F.col(f"f.high_{m}")) & (F.col(m) >= F.col(f"f.low_{m}") if rule.low else F.lit(True)) for m, rule in METRICS.items()])
    out = found.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("f_lang", "f_source", "f")


def _with_groups(docs: DataFrame) -> DataFrame:
    return docs.withColumns({c: F.lit(None).cast("string") for c in ("lang", "source") if c not in docs.columns})


def judged(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` with base counts, metrics, base_failed and kept, one row per document."""
    found = stage(features(_with_groups(docs), [key, "lang", "source"]), "quality")
    return apply_bounds(found, bounds(found))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns and values they came with.

    Each text is analysed once: documents that pass the base rule are written with
    their metrics, the sketches read the metrics alone, and the fences are applied
    to what was written.
    """
    whole = _with_groups(docs).select(F.struct(*docs.columns).alias("row"), "lang", "source", "text")
    able = stage(features(whole, ["row", "lang", "source"]).where(~F.col("base_failed")), "quality")
    limits = stage(bounds(able.drop("row")), "fences")
    return apply_bounds(able, limits).where("kept").select("row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept")


_METRIC_SQL = {
    "symbol_pct": "100 * n_symbols // greatest(n_words, 1)",
    "repeat_permille": "1000 * n_repeat_words // greatest(n_words, 1)",
    "dup_line_permille": "1000 * n_dup_lines // greatest(n_lines, 1)",
    "mean_chars_x100": "100 * word_chars // greatest(n_words, 1)",
}


def feature_sql(table: str = "documents") -> str:
    """WITH terms that end in ``feats``: the base counts and metrics of each row of ``table``."""
    return rf"""
docs AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS body FROM {table}),
w AS (SELECT rid, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws FROM docs),
win AS (SELECT rid, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS t FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
dup AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM win),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup, (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY rid),
ln AS (SELECT rid, l FROM (SELECT rid, unnest(string_split(body, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln GROUP BY rid),
base AS (
  SELECT docs.*, len(ws) AS n_words, length(regexp_replace(w.body, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(w.body) - length(regexp_replace(w.body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM docs JOIN w USING (rid) LEFT JOIN lc USING (rid) LEFT JOIN cov USING (rid)
),
feats AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{x} AS {m}" for m, x in _METRIC_SQL.items())} FROM base)"""


def verdict_sql(table: str = "documents") -> str:
    """WITH terms that end in ``judged``: ``feats`` with ``kept``."""
    quantiles, limits, inside = {}, [], []
    for m, rule in METRICS.items():
        for k in (500, rule.high, 1000 - rule.high):
            quantiles[f"{m}_{k}"] = f"min(CASE WHEN metric = '{m}' AND 1000 * upto >= {k} * docs THEN b END) AS {m}_{k}"
        limits.append(f"{m}_500 + {rule.spread} * greatest({m}_{rule.high} - {m}_500, {rule.least}) AS high_{m}")
        inside.append(f"{m} <= coalesce(g.high_{m}, l.high_{m}, a.high_{m})")
        if rule.low:
            limits.append(f"{m}_500 - {rule.spread} * greatest({m}_500 - {m}_{1000 - rule.high}, {rule.least}) AS low_{m}")
            inside.append(f"{m} >= coalesce(g.low_{m}, l.low_{m}, a.low_{m})")
    cells = " UNION ALL ".join(f"SELECT {lv} AS level, {lang} AS lang, {src} AS source, '{m}' AS metric, {m} AS v FROM feats WHERE NOT base_failed" for m in METRICS for lv, lang, src in ((2, "lang", "source"), (1, "lang", "NULL"), (0, "NULL", "NULL")))
    return feature_sql(table) + f""",
cells AS ({cells}),
hist AS (SELECT level, lang, source, metric, (v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6) AS b, count(*) AS n FROM cells GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY b) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS docs FROM hist),
q AS (SELECT level, lang, source, max(docs) AS docs, {", ".join(quantiles.values())} FROM ranked GROUP BY ALL),
fence AS (SELECT level, lang, source, docs, {", ".join(limits)} FROM q),
judged AS (
  SELECT feats.*, NOT base_failed AND coalesce({" AND ".join(inside)}, true) AS kept FROM feats
  LEFT JOIN (SELECT * FROM fence WHERE level = 2 AND docs >= {MIN_GROUP}) g ON feats.lang IS NOT DISTINCT FROM g.lang AND feats.source IS NOT DISTINCT FROM g.source
  LEFT JOIN (SELECT * FROM fence WHERE level = 1 AND docs >= {MIN_GROUP}) l ON feats.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN (SELECT * FROM fence WHERE level = 0) a ON true
)"""


SQL = f"WITH {verdict_sql()} SELECT doc_id, {', '.join(BASE)}, base_failed, kept FROM judged"

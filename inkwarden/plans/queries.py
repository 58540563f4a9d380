"""The engine's queries over the fixture tables, each next to SQL that must give the same rows.

Documents stand for posts: the source decides the type, the language whether the
text is known to be complete, and labels stand for reviews and web results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarden.functions import text as T
from inkwarden.operators import compliance, findings, near, posts, web
from inkwarden.streaming import budgets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Phrases that the phrase query looks for in the fixture.
PHRASES = ("allrightsreserved", "releasedunderthemitlicense", "licensedunderccbync40")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("$POSTS", POSTS_SQL).replace("$FINDINGS", FINDINGS_SQL).replace("$STATUS", STATUS_SQL)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("source") == "src1", "reply").when(F.col("source") == "src2", "quote").when(F.col("source") == "src3", "repost").when(F.col("source") == "src4", "article").otherwise("original")
    method = F.when(F.col("source") == "src5", "AI generated").when(F.col("source") == "src6", "not AI generated").when(F.col("source") == "src7", "human written").otherwise("")
    rows = d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ord"), F.concat(F.lit("https://x.com/i/status/"), "doc_id").alias("url"), "text", kind.alias("type"),
        F.when(F.col("lang") != "es", True).alias("text_complete"), method.alias("creation_method"),
        F.when(F.col("source") == "src8", "an own account of what the source leaves out").otherwise("").alias("contribution"),
    )
    return posts.with_clean(posts.complete_schema(rows))


POSTS_SQL = r"""posts AS (
  SELECT doc_id::VARCHAR AS id, doc_id AS ord, 'https://x.com/i/status/' || doc_id AS url, text, n_chars,
         CASE source WHEN 'src1' THEN 'reply' WHEN 'src2' THEN 'quote' WHEN 'src3' THEN 'repost' WHEN 'src4' THEN 'article' ELSE 'original' END AS type,
         CASE WHEN lang <> 'es' THEN true END AS text_complete,
         CASE source WHEN 'src5' THEN 'AI generated' WHEN 'src6' THEN 'not AI generated' WHEN 'src7' THEN 'human written' ELSE '' END AS creation_method,
         source = 'src8' AS contributed,
         regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), 'https?://\S+', '', 'g'), '[^\p{L}\p{N}]+', '', 'g') AS clean
  FROM documents)"""

_PHRASE_SQL = ", ".join(f"('{p}')" for p in PHRASES)
FINDINGS_SQL = f"""grp AS (SELECT id, count(*) OVER (PARTITION BY clean) AS members FROM posts WHERE length(clean) >= 24 AND type <> 'repost'),
phr AS (SELECT id, count(*) OVER (PARTITION BY p) AS n FROM posts, (VALUES {_PHRASE_SQL}) v(p) WHERE contains(clean, p)),
found0 AS (
  SELECT id, 'high_risk' AS level, 'internal_exact' AS code FROM grp WHERE members > 1
  UNION ALL SELECT id, 'review', 'repeated_engagement_phrase' FROM phr WHERE n >= 3
  UNION ALL SELECT id, 'review', 'repost_record' FROM posts WHERE type = 'repost'
  UNION ALL SELECT id, 'insufficient', 'missing_text' FROM posts WHERE type <> 'repost' AND clean = ''
  UNION ALL SELECT id, 'insufficient', 'text_incomplete' FROM posts WHERE NOT coalesce(text_complete, type = 'repost')
  UNION ALL SELECT id, 'review', 'quote_source_missing' FROM posts WHERE type = 'quote'
  UNION ALL SELECT id, NULL, 'creation_method_declared' FROM posts WHERE creation_method <> ''),
found AS (SELECT * FROM found0 UNION ALL SELECT id, NULL, 'no_supplied_text_match' FROM posts WHERE id NOT IN (SELECT id FROM found0))"""
STATUS_SQL = """stat AS (
  SELECT posts.*, CASE coalesce(min(CASE level WHEN 'high_risk' THEN 1 WHEN 'insufficient' THEN 2 WHEN 'review' THEN 3 END), 4) WHEN 1 THEN 'high_risk' WHEN 2 THEN 'insufficient' WHEN 3 THEN 'review' ELSE 'low_signal' END AS status
  FROM posts LEFT JOIN found USING (id) GROUP BY ALL)"""


def fixture_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = fixture_posts(spark, sf_dir)
    return p, findings.findings(p, phrases=PHRASES)


def fixture_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.statuses(*fixture_findings(spark, sf_dir))


# ---------------------------------------------------------------- duplicates


@query("""WITH $POSTS, m AS (SELECT id, ord, clean, count(*) OVER w AS members, row_number() OVER (PARTITION BY clean ORDER BY ord) AS k FROM posts WHERE length(clean) >= 24 AND type <> 'repost' WINDOW w AS (PARTITION BY clean)),
h AS (SELECT clean, list(id ORDER BY ord) AS head FROM m WHERE members > 1 AND k <= 9 GROUP BY clean)
SELECT id, members, array_to_string([x for x in head if x <> id][1:8], ',') AS peers FROM m JOIN h USING (clean)""")
def internal_exact(spark, sf_dir):
    return findings.exact_groups(fixture_posts(spark, sf_dir)).select("id", "members", F.array_join("peers", ",").alias("peers"))


@query("WITH $POSTS, g AS (SELECT count(*) AS members FROM posts WHERE length(clean) >= 24 AND type <> 'repost' GROUP BY clean) SELECT members, count(*) AS groups FROM g WHERE members > 1 GROUP BY members")
def exact_group_sizes(spark, sf_dir):
    able = fixture_posts(spark, sf_dir).where((F.length("clean") >= T.COMPARABLE) & (F.col("type") != "repost"))
    return able.groupBy("clean").agg(F.count("*").alias("members")).where("members > 1").groupBy("members").agg(F.count("*").alias("groups"))


@query("""WITH $POSTS, t AS (SELECT clean, min(ord) AS ord FROM posts WHERE type <> 'repost' AND length(clean) >= 40 GROUP BY clean),
g AS (SELECT DISTINCT ord, hash(substr(clean, i, 4)) AS g FROM (SELECT ord, clean, unnest(generate_series(1, length(clean) - 3)) AS i FROM t)),
n AS (SELECT ord, count(*) AS n FROM g GROUP BY ord), gn AS (SELECT * FROM g JOIN n USING (ord)),
s AS (SELECT a.ord, b.ord AS other, a.n AS x, b.n AS y, count(*) AS shared FROM gn a JOIN gn b ON a.g = b.g AND a.ord > b.ord AND least(a.n, b.n) >= 0.84 * greatest(a.n, b.n) GROUP BY ALL)
SELECT ord::VARCHAR AS id, other::VARCHAR AS other, shared / (x + y - shared) AS similarity FROM s WHERE shared / (x + y - shared) >= 0.84""")
def near_jaccard(spark, sf_dir):
    return near.near_pairs(fixture_posts(spark, sf_dir)).select("id", "other", "similarity")


_NEAR_SQL = """near_t AS (SELECT clean, min(ord) AS ord FROM posts WHERE type <> 'repost' AND length(clean) >= 40 GROUP BY clean),
near_g AS (SELECT DISTINCT ord, hash(substr(clean, i, 4)) AS g FROM (SELECT ord, clean, unnest(generate_series(1, length(clean) - 3)) AS i FROM near_t)),
near_n AS (SELECT ord, count(*) AS n FROM near_g GROUP BY ord), near_gn AS (SELECT * FROM near_g JOIN near_n USING (ord)),
near_s AS (SELECT a.ord, b.ord AS other, a.n AS x, b.n AS y, count(*) AS shared FROM near_gn a JOIN near_gn b ON a.g = b.g AND a.ord > b.ord AND least(a.n, b.n) >= 0.84 * greatest(a.n, b.n) GROUP BY ALL),
near_p AS (SELECT ord::VARCHAR AS id, other::VARCHAR AS other, shared / (x + y - shared) AS similarity FROM near_s WHERE shared / (x + y - shared) >= 0.84),
near_sides AS (SELECT id, other, similarity FROM near_p UNION ALL SELECT other, id, similarity FROM near_p)"""


@query(f"WITH $POSTS, {_NEAR_SQL}, r AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS place, count(*) OVER (PARTITION BY id) AS total FROM near_sides) SELECT * FROM r WHERE place <= 8")
def near_reasons(spark, sf_dir):
    """The closest near-duplicates of each post, by Jaccard similarity, and how many it has."""
    return findings.near_reasons(near.near_pairs(fixture_posts(spark, sf_dir))).select("id", "other", "place", "total")


_NEAR_FINDINGS_SQL = FINDINGS_SQL.replace("found0 AS (", "found0 AS (SELECT DISTINCT id, 'review' AS level, 'internal_near' AS code FROM near_sides UNION ALL ", 1)


@query(f"WITH $POSTS, {_NEAR_SQL}, {_NEAR_FINDINGS_SQL}, {STATUS_SQL}, near_c AS (SELECT id, count(*) AS near FROM near_sides GROUP BY id) SELECT stat.id, status, coalesce(near, 0) AS near FROM stat LEFT JOIN near_c USING (id)")
def near_statuses(spark, sf_dir):
    """Statuses where near-duplicates, by Jaccard similarity, are findings too, and how many each post has."""
    p = fixture_posts(spark, sf_dir)
    found = findings.findings(p, near.near_pairs(p), phrases=PHRASES)
    total = found.where("code = 'internal_near'").select("id", F.col("total").alias("near"))
    return findings.statuses(p, found).join(total, "id", "left").select("id", "status", F.coalesce("near", F.lit(0)).alias("near"))


_REASONS_SQL = ", ".join(f"({k}, '{c}')" for k, c in enumerate(findings.ARCHIVE_REASONS))


@query(f"""WITH $POSTS, {_NEAR_SQL}, {_NEAR_FINDINGS_SQL}, {STATUS_SQL},
able AS (SELECT id, id IN (SELECT id FROM found WHERE code IN ('internal_exact', 'internal_near')) AS dup FROM posts WHERE type <> 'repost' AND text_complete AND length(clean) >= 24),
told AS (SELECT k, code, count(DISTINCT id) AS n FROM found JOIN (VALUES {_REASONS_SQL}) v(k, code) USING (code) GROUP BY ALL),
ex AS (SELECT stat.id, status, row_number() OVER (ORDER BY CASE status WHEN 'high_risk' THEN 1 WHEN 'insufficient' THEN 2 WHEN 'review' THEN 3 ELSE 4 END, ord) AS k, list_sort(list(DISTINCT found.code))[1:4] AS codes FROM stat LEFT JOIN found USING (id) GROUP BY stat.id, status, ord)
SELECT (SELECT count(*) FROM posts) AS total, (SELECT count(*) FROM posts WHERE type IN ('original', 'article')) AS posts, (SELECT count(*) FROM posts WHERE type = 'reply') AS replies, (SELECT count(*) FROM posts WHERE type = 'repost') AS reposts, (SELECT count(*) FROM posts WHERE type = 'quote') AS quotes,
  (SELECT count(*) FROM stat WHERE status = 'high_risk') AS high_risk, (SELECT count(*) FROM stat WHERE status = 'insufficient') AS insufficient, (SELECT count(*) FROM stat WHERE status = 'review') AS review, (SELECT count(*) FROM stat WHERE status = 'low_signal') AS low_signal,
  (SELECT count(*) FROM able) AS nonduplicate_denominator, (SELECT count(*) FROM able WHERE NOT dup) AS nonduplicate_numerator, (SELECT count(*) FROM posts WHERE type <> 'repost') - (SELECT count(*) FROM able) AS comparison_excluded,
  0::BIGINT AS media_references, 0::BIGINT AS hashed_media, (SELECT round(100 * count(*) FILTER (NOT dup) / nullif(count(*), 0), 1) FROM able) AS nonduplicate_percent, NULL::DOUBLE AS media_completeness_percent,
  (SELECT string_agg(code || ':' || n, ',' ORDER BY k) FROM told) AS reasons, (SELECT string_agg(id || ':' || status || ':' || array_to_string(codes, '+'), ',' ORDER BY k) FROM ex WHERE k <= 12) AS examples""")
def archive_result(spark, sf_dir):
    """The compact result over all posts, near-duplicates by Jaccard similarity among its reasons."""
    p = fixture_posts(spark, sf_dir)
    out = findings.archive_result(p, findings.findings(p, near.near_pairs(p), phrases=PHRASES))
    reasons = F.array_join(F.transform("reasons", lambda r: F.concat(r["code"], F.lit(":"), r["posts"].cast("string"))), ",")
    examples = F.array_join(F.transform("examples", lambda e: F.concat_ws(":", e["id"], e["status"], F.array_join(e["codes"], "+"))), ",")
    return out.withColumns({"reasons": reasons, "examples": examples})


@query("""WITH c AS (SELECT 'd' || doc_id AS id, regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), 'https?://\\S+', '', 'g'), '[^\\p{L}\\p{N}]+', '', 'g') AS clean FROM documents
  UNION ALL SELECT 'b' || item_id, regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), 'https?://\\S+', '', 'g'), '[^\\p{L}\\p{N}]+', '', 'g') FROM benchmark),
g AS (SELECT DISTINCT id, hash(substr(clean, i, 4)) AS g FROM (SELECT id, clean, unnest(generate_series(1, length(clean) - 3)) AS i FROM c WHERE length(clean) >= 24)),
n AS (SELECT id, count(*) AS n FROM g WHERE id[1] = 'b' GROUP BY id),
s AS (SELECT a.id, b.id AS source_id, n, count(*) AS shared FROM g a JOIN n USING (id) JOIN g b ON a.g = b.g AND b.id[1] = 'd' WHERE a.id[1] = 'b' GROUP BY ALL)
SELECT substr(id, 2)::BIGINT AS id, substr(source_id, 2)::BIGINT AS source_id, shared / n AS overlap, CASE WHEN shared / n >= 0.88 THEN 'source_overlap_no_contribution' ELSE 'source_partial_overlap' END AS code FROM s WHERE shared / n >= 0.5""".replace("\\\\", "\\"))
def source_containment(spark, sf_dir):
    hits = near.contained(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))
    return hits.withColumn("code", F.when(F.col("overlap") >= near.WHOLE, "source_overlap_no_contribution").otherwise("source_partial_overlap"))


@query("WITH $POSTS, c AS (SELECT DISTINCT id, sha256(clean) AS hash FROM posts), m AS (SELECT *, count(*) OVER (PARTITION BY hash) AS posts FROM c) SELECT * FROM m WHERE posts > 1")
def media_same_hash(spark, sf_dir):
    one = F.array(F.struct(F.col("id").alias("name"), F.sha2("clean", 256).alias("hash"), F.lit("image").alias("kind"), F.lit("").alias("hash_origin")))
    return findings.same_media(fixture_posts(spark, sf_dir).withColumn("media", one))


# ---------------------------------------------------------------- rules and statuses


@query("WITH $POSTS, $FINDINGS SELECT code, count(DISTINCT id) AS posts FROM found GROUP BY code")
def findings_by_code(spark, sf_dir):
    return findings.code_counts(fixture_findings(spark, sf_dir)[1])


@query("WITH $POSTS, $FINDINGS, $STATUS SELECT id, status FROM stat")
def post_status(spark, sf_dir):
    return fixture_status(spark, sf_dir).select("id", "status")


@query("WITH $POSTS, $FINDINGS, $STATUS SELECT s AS status, count(id) AS posts FROM (VALUES ('high_risk'), ('insufficient'), ('review'), ('low_signal')) v(s) LEFT JOIN stat ON status = s GROUP BY s")
def status_histogram(spark, sf_dir):
    return findings.status_histogram(fixture_status(spark, sf_dir))


@query("WITH $POSTS SELECT CASE WHEN type IN ('original', 'article') THEN 'posts' ELSE type END AS kind, count(*) AS posts FROM posts GROUP BY 1")
def type_histogram(spark, sf_dir):
    kind = F.when(F.col("type").isin("original", "article"), "posts").otherwise(F.col("type"))
    return fixture_posts(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("posts"))


@query("""WITH $POSTS, $FINDINGS, a AS (SELECT id, id IN (SELECT id FROM found WHERE code = 'internal_exact') AS dup FROM posts WHERE type <> 'repost' AND text_complete AND length(clean) >= 24)
SELECT count(*) AS denominator, count(*) FILTER (NOT dup) AS numerator, count(*) FILTER (NOT dup) / nullif(count(*), 0) AS share FROM a""")
def nonduplicate_ratio(spark, sf_dir):
    return findings.nonduplicate(*fixture_findings(spark, sf_dir))


@query("""WITH $POSTS, $FINDINGS, $STATUS, o AS (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY contributed DESC, least(length(clean), 2000) DESC, ord) AS k FROM stat WHERE type IN ('original', 'article', 'quote') AND status = 'low_signal' AND length(clean) >= 40)
SELECT (row_number() OVER (ORDER BY contributed DESC, least(length(clean), 2000) DESC, ord))::INT AS rank, id, url, text FROM o WHERE k = 1 ORDER BY rank LIMIT 10""")
def candidate_topk(spark, sf_dir):
    return posts.candidates(fixture_status(spark, sf_dir))


@query("""WITH $POSTS, $FINDINGS, $STATUS SELECT id, status, substr(text, 1, 240) AS excerpt FROM stat ORDER BY CASE status WHEN 'high_risk' THEN 1 WHEN 'insufficient' THEN 2 WHEN 'review' THEN 3 ELSE 4 END, ord LIMIT 12""")
def example_sampling(spark, sf_dir):
    return posts.examples(fixture_status(spark, sf_dir))


@query("""WITH $POSTS SELECT count(*) AS analyzed, count(*) FILTER (clean <> '') AS with_text, count(*) FILTER (clean <> '' AND text_complete) AS complete_text, 0::BIGINT AS media_references, 0::BIGINT AS hashed_media,
CASE WHEN count(*) <= 400000 THEN count(*) / 400000 END AS coverage, NULL::DOUBLE AS media_coverage FROM posts""")
def coverage_percent(spark, sf_dir):
    return findings.coverage(fixture_posts(spark, sf_dir), 400_000)


@query(f"""WITH $POSTS, h AS (SELECT DISTINCT id, p AS phrase FROM posts, (VALUES {_PHRASE_SQL}) v(p) WHERE contains(clean, p)), n AS (SELECT *, count(*) OVER (PARTITION BY phrase) AS posts FROM h) SELECT * FROM n WHERE posts >= 3""")
def engagement_phrases(spark, sf_dir):
    return findings.repeated_phrases(fixture_posts(spark, sf_dir), PHRASES)


def fixture_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads: every seventh declares one part more than it has, every fifth declares no total."""
    c = table(spark, sf_dir, "conversations")
    size = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    total = F.when(F.col("conv_id") % 5 != 0, F.col("last") + 1 + (F.col("conv_id") % 7 == 0).cast("int"))
    rows = c.join(size, "conv_id").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("thread_id"), (F.col("turn") + 1).alias("thread_order"), total.alias("thread_total"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text")
    return posts.complete_schema(rows)


_THREADS = """c AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
t AS (SELECT conv_id, turn + 1 AS o, CASE WHEN conv_id % 5 <> 0 THEN last + 1 + (conv_id % 7 = 0)::INT END AS total FROM c)"""


@query(f"""WITH {_THREADS} SELECT conv_id::VARCHAR AS thread_id, count(*) AS members, coalesce(max(total), count(*)) > count(DISTINCT o) AS missing,
count(DISTINCT total) > 1 OR count(o) <> count(DISTINCT o) OR coalesce(max(o) > max(total), false) AS inconsistent, count(DISTINCT total) = 0 AS "unknown" FROM t GROUP BY conv_id""")
def thread_completeness(spark, sf_dir):
    return findings.threads(fixture_threads(spark, sf_dir))


@query("SELECT conv_id::VARCHAR AS thread_id, conv_id || '-' || min(turn) AS entry_id FROM conversations GROUP BY conv_id")
def thread_entry(spark, sf_dir):
    return posts.thread_entry(fixture_threads(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT conv_id * 1000 + turn AS node, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations),
r AS (SELECT node, node AS root FROM e WHERE parent IS NULL OR parent NOT IN (SELECT node FROM e) UNION ALL SELECT e.node, r.root FROM e JOIN r ON e.parent = r.node) SELECT node, root FROM r""")
def reply_components(spark, sf_dir):
    node = F.col("conv_id") * 1000 + F.col("turn")
    return posts.reply_groups(table(spark, sf_dir, "conversations").select(node.alias("node"), F.when(F.col("turn") > 0, node - 1).alias("parent")))


@query("""WITH r AS (SELECT role || (conv_id % 50) AS id, text, row_number() OVER (ORDER BY conv_id, turn) AS ord FROM conversations),
s AS (SELECT *, lag(text) OVER w AS before, row_number() OVER w AS nth FROM r WINDOW w AS (PARTITION BY id ORDER BY ord)), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS m FROM s WHERE nth = 1 OR text IS DISTINCT FROM before)
SELECT CASE WHEN nth > 1 OR m > 1 THEN id || '__' || ord ELSE id END AS id, text, ord FROM k""")
def conflict_dedupe(spark, sf_dir):
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations")
    place = c.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("conv_id")) - F.col("n"))
    inside = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = c.withColumn("k", inside).join(place, "conv_id").select(F.concat("role", F.col("conv_id") % 50).alias("id"), F.lit("").alias("url"), "text", (F.col("before") + F.col("k")).alias("ord"))
    return posts.first_wins(rows).select("id", "text", "ord")


# ---------------------------------------------------------------- windows, search and paging


@query("""WITH b AS (SELECT CASE WHEN (ts + INTERVAL 8 HOUR)::DATE BETWEEN DATE '2024-01-02' AND DATE '2024-01-05' THEN 'selected' ELSE 'outside' END AS bucket FROM events) SELECT bucket, count(*) AS posts FROM b GROUP BY bucket""")
def date_window(spark, sf_dir):
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "events").select(posts.window_bucket(at, "2024-01-02", "2024-01-05").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("posts"))


@query("SELECT min((ts + INTERVAL 8 HOUR)::DATE) AS first_day, max((ts + INTERVAL 8 HOUR)::DATE) AS last_day FROM events")
def actual_dates(spark, sf_dir):
    day = F.to_date(F.from_utc_timestamp(T.moment(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), "Asia/Shanghai"))
    return table(spark, sf_dir, "events").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS used FROM events")
def hourly_usage(spark, sf_dir):
    return budgets.rolling_usage(table(spark, sf_dir, "events"), "user_id").select("event_id", "user_id", "used")


@query("WITH $POSTS, t AS (SELECT count(*) AS total FROM posts) SELECT id, total, CASE WHEN total > 150 THEN 150::BIGINT END AS next_offset FROM posts, t ORDER BY ord LIMIT 50 OFFSET 100")
def post_page(spark, sf_dir):
    return posts.page(fixture_posts(spark, sf_dir), 100, 50).select("id", "total", "next_offset")


_REASON = """CASE WHEN type = 'repost' THEN 'repost' WHEN type = 'reply' THEN 'reply' WHEN clean = '' THEN 'empty_text' WHEN text_complete IS NULL THEN 'incomplete_text' WHEN length(clean) < 24 THEN 'short_text' END"""


@query(f"WITH $POSTS SELECT id FROM posts WHERE contains(lower(text), 'licensed') AND {_REASON} IS NULL")
def post_search(spark, sf_dir):
    return posts.search(posts.ambiguous(fixture_posts(spark, sf_dir)), "Licensed", "eligible").select("id")


@query(f"WITH $POSTS SELECT coalesce({_REASON}, 'eligible') AS reason, count(*) AS posts FROM posts GROUP BY 1")
def web_eligibility(spark, sf_dir):
    p = posts.ambiguous(fixture_posts(spark, sf_dir))
    return p.groupBy(F.coalesce(posts.web_reason(), F.lit("eligible")).alias("reason")).agg(F.count("*").alias("posts"))


@query(f"""WITH $POSTS, w AS (SELECT item_id::VARCHAR AS id FROM benchmark), e AS (SELECT id FROM posts WHERE {_REASON} IS NULL)
SELECT count(*) AS chosen, count(DISTINCT w.id) AS distinct_posts, count(e.id) AS eligible, count(*) = 10 AND count(DISTINCT w.id) = 10 AND count(e.id) = 10 AS valid FROM w LEFT JOIN e USING (id)""")
def selection_validation(spark, sf_dir):
    chosen = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("https://x.com/i/status/"), "item_id").alias("value"))
    return posts.validate_selection(posts.ambiguous(fixture_posts(spark, sf_dir)), chosen)


@query("WITH $POSTS SELECT id FROM posts WHERE id NOT IN (SELECT doc_id::VARCHAR FROM labels) AND ord >= 20 ORDER BY ord LIMIT 10")
def batch_plan(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return posts.batch_plan(fixture_posts(spark, sf_dir), done, 20, 10).select("id")


@query("SELECT item_id::VARCHAR AS id, item_id AS ord FROM benchmark ORDER BY item_id LIMIT 10")
def candidate_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("https://x.com/i/status/"), "item_id").alias("value"), F.col("item_id").alias("ord"))
    return posts.candidate_lookup(fixture_posts(spark, sf_dir), wanted)


@query("SELECT lang, min(doc_id) AS ord FROM documents GROUP BY lang")
def ordered_distinct(spark, sf_dir):
    return posts.ordered_distinct(table(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id")), "lang")


@query("""WITH r AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'matched' ELSE 'no_match' END AS status, 0 AS new FROM labels UNION ALL SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'abandoned' ELSE 'partial' END, 1 FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN status = 'abandoned' THEN 1 ELSE 0 END, new DESC) AS k FROM r) SELECT id, status FROM k WHERE k = 1""")
def upsert_results(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "matched").otherwise("no_match").alias("status"), F.col("doc_id").alias("ord"))
    new = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") < 1000, "abandoned").otherwise("partial").alias("status"), F.col("doc_id").alias("ord"))
    return posts.upsert(old, new).select("id", "status")


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INT AS place, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE place <= 4""")
def evidence_bounded(spark, sf_dir):
    return posts.bounded(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 4).select("o_custkey", "o_orderkey", "place", "total")


@query("""WITH f AS (SELECT l_orderkey AS id, l_partkey AS url, min(struct_pack(r := l_linenumber, q := l_linenumber % 2)) AS spot FROM lineitem GROUP BY ALL)
SELECT * FROM (SELECT id, url, (row_number() OVER (PARTITION BY id ORDER BY spot, url))::INT AS place FROM f) WHERE place <= 5""")
def rank_interleave(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("url"), F.col("l_linenumber").alias("rank"), (F.col("l_linenumber") % 2).alias("query_no"))
    return posts.interleaved(hits)


@query("""SELECT * FROM (SELECT l_orderkey AS id, l_partkey AS url, l_discount AS score, (row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_discount DESC, l_partkey))::INT AS place, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem) WHERE place <= 3""")
def match_ordering(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("url"), F.col("l_discount").alias("score"), F.when(F.col("l_returnflag") == "R", "page_body").otherwise("snippet").alias("source_kind"))
    return posts.ordered_matches(m).select("id", "url", "score", "place", "total")


# ---------------------------------------------------------------- text functions


_FLAT = r"trim(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '\s+', ' ', 'g'))"
_CL = r"length(regexp_replace(replace(lower(regexp_replace({}, 'https?://\S+', '', 'g')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def _fragments_sql(table: str, key: str) -> str:
    """WITH terms that end in v: ``key`` and qs, the search queries of each row of ``table``."""
    return rf"""f AS (SELECT {key}, {_FLAT} AS flat FROM {table}), p AS (SELECT {key}, flat, i, trim(ps[i]) AS p FROM (SELECT {key}, flat, ps, unnest(generate_series(1, len(ps))) AS i FROM (SELECT *, string_split_regex(flat, '[。！？.!?\n]') AS ps FROM f))),
r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {_CL.format('p')} DESC, i) AS k FROM p WHERE {_CL.format('p')} >= 24),
c AS (SELECT f.{key}, f.flat, coalesce(list(p ORDER BY i) FILTER (k <= 2), [f.flat]) AS ps FROM f LEFT JOIN r USING ({key}) GROUP BY f.{key}, f.flat),
q AS (SELECT {key}, flat, [y for y in [array_to_string(string_split_regex(trim(substr(x, 1, 180)), '\s+')[1:24], ' ') for x in ps] if y <> ''] AS qs FROM c),
u AS (SELECT {key}, flat, CASE WHEN len(qs) = 2 AND qs[1] = qs[2] THEN qs[1:1] ELSE qs END AS qs FROM q),
v AS (SELECT {key}, CASE WHEN len(qs) = 1 AND length(flat) > 300 THEN list_concat(qs, [substr(flat, length(flat) // 2 + 1, 180)]) ELSE qs END AS qs FROM u)"""


@query(f"WITH {_fragments_sql('documents', 'doc_id')} SELECT doc_id, len(qs)::INT AS n, array_to_string(qs, '|') AS queries FROM v")
def search_fragments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.search_fragments(F.col("text")).alias("q")).select("doc_id", F.size("q").alias("n"), F.array_join("q", "|").alias("queries"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS chars FROM pages")
def page_title_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.page_title(F.col("html")).alias("title"), F.length(T.without_tags(F.col("html"))).cast("long").alias("chars"))


@query(r"""WITH u AS (SELECT page_id, unnest(['https://x.com/a/status/' || page_id || '?s=20', 'http://Mobile.Twitter.com/b/status/' || page_id || '/photo/1', 'https://x.com/status/9z', url]) AS url FROM pages)
SELECT page_id, url, nullif(CASE WHEN lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) IN ('x.com', 'www.x.com', 'twitter.com', 'www.twitter.com', 'mobile.twitter.com') THEN regexp_extract(url, '^[^?#]*/status/(\d+)(?:[/?#]|$)', 1) END, '') AS status FROM u""")
def status_id_extract(spark, sf_dir):
    urls = F.array(F.concat(F.lit("https://x.com/a/status/"), "page_id", F.lit("?s=20")), F.concat(F.lit("http://Mobile.Twitter.com/b/status/"), "page_id", F.lit("/photo/1")), F.lit("https://x.com/status/9z"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(urls).alias("url")).withColumn("status", T.status_id(F.col("url")))


@query("""SELECT CASE WHEN l_returnflag = 'N' THEN 'unknown' WHEN l_shipdate < o_orderdate THEN 'earlier' WHEN l_shipdate > o_orderdate THEN 'later' ELSE 'same' END AS relation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def temporal_relation(spark, sf_dir):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(iso("l_shipdate"), F.when(F.col("l_returnflag") == "N", "").otherwise("Z")).alias("source"))
    both = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", F.concat(iso("o_orderdate"), F.lit("+00:00")).alias("post")), "o_orderkey")
    return both.groupBy(T.temporal_relation(F.col("source"), F.col("post")).alias("relation")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal / 100 BETWEEN 0 AND 100 THEN c_acctbal / 100 END AS s FROM customer)
SELECT CASE WHEN s IS NULL THEN 'unknown' WHEN s < 40 THEN 'concern' WHEN s < 70 THEN 'mixed' ELSE 'supported' END AS verdict, count(*) AS n FROM s GROUP BY 1""")
def verdicts(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(T.verdict(T.valid_score(F.col("c_acctbal") / 100, 100)).alias("verdict")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- compliance and policy


def fixture_reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The scope, posts that are no reposts, and a completed review of each labelled document."""
    scope = fixture_posts(spark, sf_dir).where("type <> 'repost'").select("id")
    scores = F.explode(F.array(F.struct(F.lit("original_contribution").alias("criterion"), (100.0 * F.col("quality")).alias("score")), F.struct(F.lit("monetization_focus").alias("criterion"), (100.0 - 100.0 * F.col("toxic")).alias("score")), F.struct(F.lit("automation").alias("criterion"), F.lit(100.0).alias("score"))))
    reviews = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit("completed").alias("status"), F.lit("labels").alias("model"), scores.alias("s")).select("id", "status", "model", "s.*")
    return scope, reviews


_CRITERIA = """sc AS (SELECT id FROM posts WHERE type <> 'repost'), lb AS (SELECT * FROM labels WHERE doc_id::VARCHAR IN (SELECT id FROM sc)),
rv AS (SELECT 'original_contribution' AS criterion, 100.0 * quality AS s FROM lb UNION ALL SELECT 'monetization_focus', 100.0 - 100.0 * toxic FROM lb),
cr AS (SELECT c AS criterion, w::DOUBLE AS weight, (SELECT count(*) FROM sc) AS denominator, count(s) AS evaluated, (SELECT count(*) FROM sc) - count(s) AS "unknown", sum(s)::DOUBLE / nullif(count(s), 0) AS average, count(s) / (SELECT count(*) FROM sc) AS coverage
  FROM (VALUES ('original_contribution', 50), ('automation', 20), ('monetization_focus', 10), ('intellectual_property', 20)) v(c, w) LEFT JOIN rv ON criterion = c GROUP BY c, w)"""


@query(f"WITH $POSTS, {_CRITERIA} SELECT * FROM cr")
def criterion_coverage(spark, sf_dir):
    return compliance.criteria(*fixture_reviews(spark, sf_dir))


@query(f"""WITH $POSTS, {_CRITERIA}, t AS (SELECT sum(weight * coverage) AS covered, sum(weight * coverage * average / 100) AS supported FROM cr)
SELECT round(supported / covered * 100, 6) AS score, round(covered, 6) AS covered, round(supported, 6) AS supported, round(100 - covered, 6) AS "unknown", round(supported, 6) AS low, round(least(100, supported + 100 - covered), 6) AS high FROM t""")
def compliance_rollup(spark, sf_dir):
    out = compliance.rollup(compliance.criteria(*fixture_reviews(spark, sf_dir)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("""WITH $POSTS, sc AS (SELECT id FROM posts WHERE type <> 'repost'), g AS (SELECT id, c, labels.doc_id IS NOT NULL AS seen FROM sc CROSS JOIN (VALUES ('original_contribution'), ('automation'), ('monetization_focus'), ('intellectual_property')) v(c) LEFT JOIN labels ON labels.doc_id::VARCHAR = id)
SELECT c AS criterion, CASE WHEN c IN ('automation', 'intellectual_property') THEN 'unverifiable' ELSE 'no_review' END AS reason, count(*) AS posts FROM g WHERE c IN ('automation', 'intellectual_property') OR NOT seen GROUP BY ALL""")
def unknown_reasons(spark, sf_dir):
    return compliance.unknown_reasons(*fixture_reviews(spark, sf_dir))


@query("SELECT 'labels' AS models, 'completed:' || count(DISTINCT doc_id) AS statuses FROM labels")
def review_summary(spark, sf_dir):
    out = compliance.review_summary(fixture_reviews(spark, sf_dir)[1])
    return out.select(F.array_join("models", ",").alias("models"), F.array_join(F.transform("statuses", lambda s: F.concat_ws(":", s["status"], s["n"])), ",").alias("statuses"))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 IN (0, 9) THEN 'completed' ELSE 'failed' END AS status, CASE doc_id % 10 WHEN 0 THEN 'automation:unknown|intellectual_property:unknown|monetization_focus:supported|original_contribution:mixed' WHEN 9 THEN 'automation:unknown|intellectual_property:unknown|monetization_focus:supported|original_contribution:unknown' ELSE '' END AS verdicts FROM documents""")
def validated_reviews(spark, sf_dir):
    """Answers that are sound, and with one fault each, by the document's number."""
    k, fault = F.col("doc_id"), lambda n: F.col("doc_id") % 10 == n
    d = table(spark, sf_dir, "documents").select("doc_id", k.cast("string").alias("id"), F.concat(F.lit("the words of post "), k).alias("text"))
    row = lambda name, score, word, excerpt="words", url="", source="": F.struct(F.lit(name).alias("id"), score.cast("double").alias("score"), word.alias("verdict"), F.when(fault(6), " ").otherwise("so").alias("rationale"), (F.lit(excerpt) if isinstance(excerpt, str) else excerpt).alias("post_excerpt"), (F.lit(url) if isinstance(url, str) else url).alias("source_url"), F.lit(source).alias("source_excerpt"))
    none = F.lit(None).cast("double")
    original = row("original_contribution", F.when(fault(3), 120.0).otherwise(50.0), F.when(fault(4), "supported").otherwise("mixed"), F.when(fault(5), "other words").otherwise("words of post"), F.when(fault(7), "https://none").otherwise("https://s"), "source")
    money = row("monetization_focus", F.when(~fault(8), 90.0), F.when(fault(8), "unknown").otherwise("supported"))
    closed = [row(n, none, F.lit("unknown"), "") for n in compliance.UNVERIFIABLE]
    answers = d.select("id", F.when(fault(1), F.array(original, money, closed[0])).when(fault(2), F.array(original, money, closed[0], closed[0])).otherwise(F.array(original, money, *closed)).alias("criteria"))
    bodies = d.where(k % 10 != 9).select("id", F.lit("https://s").alias("url"), F.lit("what the source says").alias("text"))
    out = compliance.validated(answers, d, bodies)
    told = F.array_join(F.array_sort(F.transform("criteria", lambda c: F.concat_ws(":", c["id"], c["verdict"]))), "|")
    return out.select(F.col("id").cast("long").alias("doc_id"), "status", told.alias("verdicts"))


@query("""WITH $POSTS, sc AS (SELECT id FROM posts WHERE type <> 'repost'), l AS (SELECT doc_id::VARCHAR AS id FROM labels) SELECT 'asked' AS kind, CASE WHEN l.id IS NULL THEN 'not_returned' ELSE 'completed' END AS status, count(*) AS posts FROM sc LEFT JOIN l USING (id) GROUP BY ALL
UNION ALL SELECT 'open', CASE WHEN l.id IS NULL THEN 'not_requested' ELSE 'completed' END, count(*) FROM sc LEFT JOIN l USING (id) GROUP BY ALL""")
def review_statuses(spark, sf_dir):
    scope, reviews = fixture_reviews(spark, sf_dir)
    return compliance.review_statuses(scope, reviews, True).select(F.lit("asked").alias("kind"), "status", "posts").unionByName(compliance.review_statuses(scope, reviews, False).select(F.lit("open").alias("kind"), "status", "posts"))


def fixture_web(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Matches and per-post web results from labels."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    own = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("https://twitter.com/i/status/"), "doc_id")).otherwise(F.concat(F.lit("https://example.org/"), "doc_id"))
    matches = rows.select(F.col("doc_id").cast("string").alias("id"), own.alias("url"), F.when(F.col("toxic") == 1, 0.9).otherwise(0.3).alias("score"), F.when(F.col("quality") == 1, "page_body").otherwise("search_snippet").alias("source_kind"), F.lit("fetched").alias("page_status"), F.when(F.col("doc_id") % 3 == 0, "later").alias("temporal_relation"))
    results = rows.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, "matched").otherwise("no_match").alias("status"), F.lit(1).alias("sources_checked"), F.col("n_chars").alias("original_chars"), F.least("n_chars", F.lit(5000)).alias("checked_chars"), F.lit(False).alias("text_truncated"))
    return matches, results


_WEB = """w AS (SELECT doc_id::VARCHAR AS id, toxic = 1 AND doc_id % 11 <> 0 AS hit, doc_id % 3 = 0 AS later, quality = 1 AS body, n_chars <= 5000 AS whole FROM labels JOIN documents USING (doc_id))"""


@query(f"""WITH $POSTS, $FINDINGS, {_WEB}, o AS (SELECT posts.*, coalesce(hit AND NOT later, false) AS hit, coalesce(hit AND NOT later AND body, false) AS strong, coalesce(whole, false) AS looked, coalesce(text_complete, false) AND length(clean) >= 24 AS whole_text, id IN (SELECT id FROM phr WHERE n >= 3) AS phrase FROM posts LEFT JOIN w USING (id) WHERE type <> 'repost'),
a AS (SELECT count(*) AS posts, count(*) FILTER (whole_text AND looked) AS c1, count(*) FILTER (hit) AS s1, bool_or(strong) AS medium, count(*) FILTER (creation_method <> '') AS c2, count(*) FILTER (creation_method = 'AI generated') AS s2, count(*) FILTER (whole_text) AS c3,
  count(*) FILTER (whole_text AND regexp_matches(text, '(?i)monetiz\\w*|revenue|earnings') AND regexp_matches(text, '(?i)(?:how to|maximi[sz]e|increase|boost).{{0,35}}(?:monetiz\\w*|revenue|earnings)')) AS s3, count(*) FILTER (phrase) AS s5 FROM o),
r AS (SELECT posts, unnest([struct_pack(q := 'original_contribution', c := c1, s := s1, d := CASE WHEN medium THEN 'medium' ELSE 'low' END), struct_pack(q := 'automation', c := c2, s := s2, d := 'medium'), struct_pack(q := 'monetization_focus', c := c3, s := s3, d := 'low'), struct_pack(q := 'intellectual_property', c := 0::BIGINT, s := 0::BIGINT, d := 'low'), struct_pack(q := 'repeated_engagement', c := c3, s := s5, d := 'low')]) AS x FROM a)
SELECT x.q AS requirement, posts, x.c AS assessed, posts - x.c AS "unknown", x.s AS signals, CASE WHEN x.s + x.c > 0 THEN x.s / posts END AS share, CASE WHEN x.s > 0 THEN 'signals_found' WHEN x.c > 0 THEN 'no_detected_signal' ELSE 'unknown' END AS status, CASE WHEN x.s > 0 THEN x.d END AS strength FROM r""".replace("\\\\", "\\"))
def policy_rollup(spark, sf_dir):
    p, found = fixture_findings(spark, sf_dir)
    return compliance.requirements(compliance.signals(p, found, *fixture_web(spark, sf_dir)))


@query(f"""WITH $POSTS, $FINDINGS, $STATUS, {_WEB}, m AS (SELECT count(*) FILTER (hit AND body) AS body_posts, count(*) FILTER (hit AND NOT body) AS snippet_posts, count(*) FILTER (hit AND body AND NOT later) AS body_signals FROM w),
l AS (SELECT count(*) FILTER (status IN ('high_risk', 'review')) AS review_posts FROM stat) SELECT body_posts, snippet_posts, body_signals, review_posts, CASE WHEN body_signals > 0 OR review_posts > 0 THEN 'needs_review' ELSE 'incomplete' END AS conclusion FROM m, l""")
def combined_evidence(spark, sf_dir):
    p, found = fixture_findings(spark, sf_dir)
    one = compliance.body_and_snippets(p, fixture_web(spark, sf_dir)[0]).join(findings.statuses(p, found).agg(F.count_if(F.col("status").isin("high_risk", "review")).alias("review_posts")))
    return one.withColumn("conclusion", compliance.conclusion(F.lit(True), F.lit(10), F.col("review_posts"), F.col("body_signals"), F.lit(1), F.lit(False)))


@query("""SELECT count(*) AS posts, count(*) AS searched, count(*) FILTER (toxic = 1) AS matched, 0::BIGINT AS partial, 0::BIGINT AS failed, count(*) AS sources_checked, true AS complete FROM labels""")
def web_coverage(spark, sf_dir):
    return web.batch_coverage(fixture_web(spark, sf_dir)[1])


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN substr(html, 10, 30) ELSE 'zzz' END AS excerpt, page_id % 2 = 0 OR contains(html, 'zzz') AS authentic FROM pages")
def excerpt_authentication(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    key = F.concat("url", F.lit("#"), "page_id")
    excerpts = p.select("page_id", key.alias("url"), F.when(F.col("page_id") % 2 == 0, F.substring("html", 10, 30)).otherwise("zzz").alias("excerpt"))
    return web.authenticated(excerpts, p.select(key.alias("url"), F.col("html").alias("text"))).select("page_id", "excerpt", "authentic")


_CLEANED = _CL.replace("length(", "(", 1)


@query(rf"""WITH {_fragments_sql('benchmark', 'item_id')},
t AS (SELECT 'q' || item_id || ':' || i AS k, item_id, i, {_CLEANED.format('q')} AS c FROM (SELECT item_id, unnest(generate_series(0, len(qs) - 1)) AS i, unnest(qs) AS q FROM v)),
d AS (SELECT 'd' || doc_id AS k, {_CLEANED.format('substr(text, 1, 100000)')} AS c FROM documents),
g AS (SELECT DISTINCT k, hash(CASE WHEN length(c) >= 4 THEN substr(c, x, 4) ELSE c END) AS g FROM (SELECT k, c, unnest(generate_series(1, greatest(length(c) - 3, 1))) AS x FROM (SELECT k, c FROM t UNION ALL SELECT k, c FROM d) WHERE c <> '')),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
s AS (SELECT a.k, b.k AS page, count(*) / n AS share FROM g a JOIN n USING (k) JOIN g b ON a.g = b.g AND b.k[1] = 'd' WHERE a.k[1] = 'q' GROUP BY a.k, b.k, n),
o AS (SELECT k, page, row_number() OVER (PARTITION BY k ORDER BY share DESC, substr(page, 2)::BIGINT) AS rank FROM s WHERE share >= 0.4),
m AS (SELECT t.item_id AS id, substr(page, 2)::BIGINT AS page_id, min({{'rank': rank, 'i': i}}) AS turn FROM o JOIN t USING (k) WHERE rank <= 5 GROUP BY ALL)
SELECT * FROM (SELECT id, page_id, (row_number() OVER (PARTITION BY id ORDER BY turn))::INT AS place FROM m) WHERE place <= 5""")
def search_sources(spark, sf_dir):
    """Benchmark items as posts, documents as the pages that a search knows."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return web.retrieved(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), pages)


#: Fixed link forms of the address rule: usual and wrong ports, user data, private and odd hosts, other schemes.
_LINKS = ("https://{}.example.org/a", "http://{}.example.org:80/", "https://{}.example.org:8443/", "https://u:p@{}.example.org/", "http://10.0.0.{}/x", "http://127.0.0.1/{}", "https://{}.internal/x", "http://localhost:80/{}", "ftp://{}.example.org/", "http://93.184.216.{}/", "https://{}", "http://[::1]/{}", "http://169.254.1.{}/")
_LINK_PUBLIC = (True, True, False, False, False, False, False, False, False, True, False, False, False)


@query(f"SELECT doc_id, CASE doc_id % {len(_LINKS)} {' '.join(f'WHEN {k} THEN {str(v).lower()}' for k, v in enumerate(_LINK_PUBLIC))} END AS public FROM documents")
def link_rules(spark, sf_dir):
    """Links of every form, numbered by their documents."""
    forms = F.get(F.array(*map(F.lit, _LINKS)), F.pmod("doc_id", F.lit(len(_LINKS))).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", web.public_url(F.replace(forms, F.lit("{}"), F.concat(F.lit(""), (F.col("doc_id") % 200 + 1).cast("string")))).alias("public"))


#: Fixed JSON forms, by whether they are strict.
_JSON = ('{{"a": 1, "b": {t}}}', '{{"a": 1, "a": {t}}}', '[NaN, {t}]', '{{"a": {{"x": 1, "x": 2}}, "b": {t}}}', '[Infinity]', '[{t}, {t}]', '{{"a": {t},}}', '-Infinity', '{t}')
_JSON_STRICT = (True, False, False, False, False, True, False, False, True)


@query(f"SELECT doc_id, CASE doc_id % {len(_JSON)} {' '.join(f'WHEN {k} THEN {str(v).lower()}' for k, v in enumerate(_JSON_STRICT))} END AS strict FROM documents WHERE text IS NOT NULL")
def json_rules(spark, sf_dir):
    """Documents' texts as values in JSON with repeated keys, numbers that are none, and broken ends."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    value = F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    forms = F.get(F.array(*[F.lit(f.format(t="{t}")) for f in _JSON]), F.pmod("doc_id", F.lit(len(_JSON))).cast("int"))
    return d.select("doc_id", web.strict_json(F.replace(forms, F.lit("{t}"), value)).alias("strict"))


# ---------------------------------------------------------------- rows only


@query()
def near_ratio(spark, sf_dir):
    return near.near_duplicates(fixture_posts(spark, sf_dir))


@query()
def compare_text(spark, sf_dir):
    """Benchmark items in the documents that hold most of their grams."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return near.compared_texts(items, docs)


@query()
def html_page_text(spark, sf_dir):
    return web.page_texts(table(spark, sf_dir, "pages").select("page_id", "html"))


@query()
def web_check(spark, sf_dir):
    """Benchmark items as posts, checked against all pages."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("").alias("url"), "text")
    return web.checked(items, table(spark, sf_dir, "pages"))


_GREEDY = """WITH RECURSIVE r AS (SELECT user_id::VARCHAR AS owner, event_id AS request, epoch(ts) AS tm, $N AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT owner, request, k, n <= $MOST AS granted, CASE WHEN n <= $MOST THEN [{'tm': tm, 'n': n}] ELSE [] END AS held FROM r WHERE k = 1
  UNION ALL SELECT owner, request, k, used + n <= $MOST, CASE WHEN used + n <= $MOST THEN list_append(live, {'tm': tm, 'n': n}) ELSE live END FROM (
    SELECT owner, request, k, tm, n, live, coalesce(list_sum([x.n FOR x IN live]), 0) AS used FROM (SELECT r.*, [x FOR x IN s.held IF x.tm > r.tm - 3600] AS live FROM s JOIN r ON r.owner = s.owner AND r.k = s.k + 1)))
SELECT request, granted FROM s"""


@query(_GREEDY.replace("$MOST", "4").replace("$N", "event_id % 3 + 1"))
def greedy_budget(spark, sf_dir):
    at = F.col("ts").cast("timestamp").cast("double")
    requests = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("owner"), F.col("event_id").alias("request"), at.alias("at"), (F.col("event_id") % 3 + 1).alias("n"))
    return budgets.greedy(requests, 4).select("request", "granted")


@query(_GREEDY.replace("$MOST", "2").replace("$N", "1"))
def model_budget(spark, sf_dir):
    """Two model calls an owner and hour, one reserved at a time."""
    at = F.col("ts").cast("timestamp").cast("double")
    return budgets.greedy(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("owner"), F.col("event_id").alias("request"), at.alias("at"), F.lit(1).cast("long").alias("n")), 2).select("request", "granted")


@query(r"SELECT page_id, regexp_matches(url, '^https?://([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z][a-z0-9-]*[a-z0-9](/|$|\?|#)') AND NOT regexp_matches(url, '^https?://[^/]*(localhost|\.local|\.internal)(/|$)') AS public FROM pages".replace("\\\\", "\\"))
def public_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.public_url("url").alias("public"))


@query("SELECT event_id, json_valid(props) AND len(json_keys(props)) = len(list_distinct(json_keys(props))) AS strict FROM events")
def strict_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", web.strict_json("props").alias("strict"))

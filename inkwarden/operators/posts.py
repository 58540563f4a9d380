"""The posts table: schema, windows, identity, eligibility, ranking and paging."""

from __future__ import annotations

import re
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkwarden.functions.text import COMPARABLE, NEAR, clean, moment, status_id
from inkwarden.operators.graph import components

_MEDIA = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "hash", "kind", "hash_origin")]))
_SOURCES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "url", "owner", "notes")]))
_STRINGS, _LONG, _BOOL = T.ArrayType(T.StringType()), T.LongType(), T.BooleanType()
_TYPES = {"thread_order": _LONG, "thread_total": _LONG, "ord": _LONG, "thread_complete": _BOOL, "text_complete": _BOOL, "media": _MEDIA, "sources": _SOURCES, "evidence": _STRINGS, "missing_media": _STRINGS}
SCHEMA = T.StructType([
    T.StructField(n, _TYPES.get(n, T.StringType()))
    for n in "id url text created_at type thread_id thread_order thread_total thread_complete text_complete media sources contribution creation_method evidence notes missing_media reply_to quoted_url ord".split()
])
STATUSES = ("high_risk", "insufficient", "review", "low_signal")


def complete_schema(rows: DataFrame) -> DataFrame:
    """``rows`` with every column of the posts table; those it lacks are null, empty strings or empty arrays."""
    empty = {T.StringType: lambda t: F.lit(""), T.ArrayType: lambda t: F.array().cast(t)}
    fill = lambda f: empty.get(type(f.dataType), lambda t: F.lit(None).cast(t))(f.dataType)
    return rows.select(*[(F.col(f.name).cast(f.dataType) if f.name in rows.columns else fill(f)).alias(f.name) for f in SCHEMA.fields])


# ---------------------------------------------------------------- windows and filters


#: The zone of a blank label, and labels of it and of universal time.
HOME_ZONE = "Asia/Shanghai"
HOME_LABELS = ("Asia/Shanghai", "Asia/Hong_Kong", "Asia/Taipei", "北京时间", "UTC+8", "UTC+08:00")
UNIVERSAL_LABELS = ("UTC", "Etc/UTC", "Z", "UTC+0", "UTC+00:00")


def time_zone(label: str | None) -> str:
    """The zone that a label names, as an offset or a region; ``ValueError`` for one that names none.

    Offsets reach 14 hours either way.
    """
    name = (label or "").strip() or HOME_ZONE
    if name in UNIVERSAL_LABELS:
        return "+00:00"
    if name in HOME_LABELS or HOME_ZONE in name:
        return "+08:00"
    if offset := re.fullmatch(r"UTC([+-])(\d{1,2})(?::([0-5]\d))?", name):
        minutes = 60 * int(offset[2]) + int(offset[3] or 0)
        if minutes <= 14 * 60:
            return f"{offset[1]}{minutes // 60:02d}:{minutes % 60:02d}"
    elif name in available_timezones():
        return name
    raise ValueError(f"{name} is no time zone")


def window_bucket(created_at: Column, start: str | None, end: str | None, zone: str = HOME_ZONE) -> Column:
    """selected, outside or invalid for an inclusive range of local dates.

    A date that cannot be read is invalid only where a bound is given. ``zone`` is
    a label that ``time_zone`` knows.
    """
    zone = time_zone(zone)
    day = F.to_date(F.from_utc_timestamp(moment(created_at, zone), zone))
    low = day < F.lit(start).cast("date") if start else F.lit(False)
    high = day > F.lit(end).cast("date") if end else F.lit(False)
    invalid = day.isNull() & F.lit(bool(start or end))
    return F.when(invalid, "invalid").when(F.coalesce(low | high, F.lit(False)), "outside").otherwise("selected")


def comparable() -> Column:
    """A complete text of its own, long enough to compare."""
    return (F.col("type") != "repost") & F.col("text_complete") & (F.length("clean") >= COMPARABLE)


def with_clean(posts: DataFrame) -> DataFrame:
    return posts.withColumn("clean", clean(F.col("text")))


def ambiguous(posts: DataFrame) -> DataFrame:
    """``posts`` with ``ambiguous``: its id or its url stands in more than one row."""
    by_id, by_url = Window.partitionBy("id"), Window.partitionBy("url")
    return posts.withColumn("ambiguous", (F.count("*").over(by_id) > 1) | ((F.col("url") != "") & (F.count("*").over(by_url) > 1)))


def web_reason() -> Column:
    """Why a post cannot be searched on the web, the first that holds; null for one that can."""
    cases = [
        ("ambiguous_id", F.col("ambiguous")),
        ("repost", F.col("type") == "repost"),
        ("reply", F.col("type") == "reply"),
        ("other_type", ~F.col("type").isin("original", "article", "quote")),
        ("empty_text", F.col("clean") == ""),
        ("incomplete_text", ~F.coalesce(F.col("text_complete"), F.lit(False))),
        ("short_text", F.length("clean") < COMPARABLE),
    ]
    out = F.when(cases[0][1], cases[0][0])
    for name, test in cases[1:]:
        out = out.when(test, name)
    return out


def search(posts: DataFrame, query: str, scope: str = "all", selected: DataFrame | None = None) -> DataFrame:
    """Posts whose full text or id holds ``query``, whatever the case; all, eligible or selected ones."""
    needle = F.lower(F.lit(query.strip()))
    found = posts.where(F.contains(F.lower("text"), needle) | F.contains(F.lower("id"), needle))
    if scope == "eligible":
        return found.where(web_reason().isNull())
    return found.join(selected.select("id").distinct(), "id", "left_semi") if scope == "selected" else found


def page(posts: DataFrame, offset: int, limit: int = 50) -> DataFrame:
    """A page in input order with the total and the next offset (null on the last page)."""
    limit = min(limit, 50)
    total = posts.agg(F.count("*").alias("total"))
    following = F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("long"))
    return posts.orderBy("ord").offset(offset).limit(limit).join(F.broadcast(total)).withColumn("next_offset", following)


def validate_selection(posts: DataFrame, chosen: DataFrame, size: int = 10) -> DataFrame:
    """One row: chosen, distinct_posts, eligible and valid. ``chosen.value`` is an id or a status link."""
    wanted = chosen.select(F.coalesce(status_id(F.col("value")), F.col("value")).alias("id"))
    able = posts.where(web_reason().isNull()).select("id").distinct().withColumn("able", F.lit(1))
    out = wanted.join(able, "id", "left").agg(F.count("*").alias("chosen"), F.countDistinct("id").alias("distinct_posts"), F.coalesce(F.sum("able"), F.lit(0)).alias("eligible"))
    return out.withColumn("valid", (F.col("chosen") == size) & (F.col("distinct_posts") == size) & (F.col("eligible") == size))


def batch_plan(posts: DataFrame, done: DataFrame, offset: int, limit: int) -> DataFrame:
    """The next posts in input order from ``offset`` on that are not done."""
    return posts.where(F.col("ord") >= offset).join(done.select("id").distinct(), "id", "left_anti").orderBy("ord").limit(limit)


# ---------------------------------------------------------------- identity


def first_wins(posts: DataFrame) -> DataFrame:
    """Repeated records dropped, conflicting ones kept under a numbered id.

    A record is a repeat when the record before it of the same identity (url, or
    id without one) has the same text. Another text under a known identity or id
    is kept, as ``id__ord``.
    """
    identity = F.when(F.col("url") != "", F.col("url")).otherwise(F.col("id"))
    by = Window.partitionBy("_identity").orderBy("ord")
    seen = posts.withColumn("_identity", identity).withColumns({"_last": F.lag("text").over(by), "_nth": F.row_number().over(by)})
    kept = seen.where((F.col("_nth") == 1) | ~F.col("text").eqNullSafe(F.col("_last")))
    again = (F.col("_nth") > 1) | (F.row_number().over(Window.partitionBy("id").orderBy("ord")) > 1)
    return kept.withColumn("id", F.when(again, F.concat("id", F.lit("__"), "ord")).otherwise(F.col("id"))).drop("_identity", "_last", "_nth")


def ordered_distinct(rows: DataFrame, value: str) -> DataFrame:
    """Each value once, by its first place."""
    return rows.groupBy(value).agg(F.min("ord").alias("ord"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``new`` over ``old``; a result that was given up never replaces one that is there."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col("status") == "abandoned", 1).otherwise(0), F.desc("_new"), F.desc("ord")))
    return both.withColumn("_k", rank).where("_k = 1").drop("_k", "_new")


def candidate_lookup(posts: DataFrame, wanted: DataFrame, most: int = 10) -> DataFrame:
    """The posts that ``wanted`` (value, ord) names by id or url, each once, the first ``most``."""
    keys = posts.select(F.col("id"), F.explode(F.array_distinct(F.filter(F.array("id", "url"), lambda v: v != ""))).alias("value"))
    return wanted.join(keys, "value").groupBy("id").agg(F.min("ord").alias("ord")).orderBy("ord").limit(most)


# ---------------------------------------------------------------- ranking


def thread_entry(posts: DataFrame) -> DataFrame:
    """thread_id and id of the first member by order; without an order last, ties by input."""
    key = F.struct(F.col("thread_order").isNull().alias("n"), F.col("thread_order").alias("o"), F.col("ord").alias("i"))
    return posts.where("thread_id <> ''").groupBy("thread_id").agg(F.min_by("id", key).alias("entry_id"))


def candidates(posts: DataFrame, most: int = 10) -> DataFrame:
    """The proposed posts with their rank: eligible, one of each clean text, best supported first.

    ``posts`` has status and clean. Threads propose their entry only.
    """
    entries = thread_entry(posts)
    able = posts.join(entries, "thread_id", "left").where(
        F.col("type").isin("original", "article", "quote") & (F.col("status") == "low_signal") & (F.length("clean") >= NEAR) & ((F.col("thread_id") == "") | (F.col("entry_id") == F.col("id")))
    )
    support = [F.desc(F.col("contribution") != ""), F.desc(F.size("evidence") > 0), F.desc(F.size("sources") > 0), F.desc(F.least(F.length("clean"), F.lit(2000)))]
    # the best of each text first, so that the ranking sort keeps only its top rows
    one = able.withColumn("_k", F.row_number().over(Window.partitionBy("clean").orderBy(*support, "ord"))).where("_k = 1")
    top = one.orderBy(*support, "ord").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*support, "ord"))).select("rank", "id", "url", "text")


def bounded(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group, each with its group's exact ``total``."""
    group = Window.partitionBy(*by)
    return rows.withColumns({"place": F.row_number().over(group.orderBy(*order)), "total": F.count("*").over(group)}).where(F.col("place") <= most)


#: Hits that a task sorts, about.
HELD = 1 << 18


def interleaved(results: DataFrame, most: int = 5, held: int = HELD) -> DataFrame:
    """The hits of ranked result lists (query_no, rank, url) in turn, each url at its first place, the first ``most`` of a post.

    Posts are dealt once, to as many tasks as their hits ask for, so that what a task
    sorts does not grow with the table.
    """
    dealt = results.repartition(max(1, -(-results.count() // held)), "id")
    first = dealt.groupBy("id", "url").agg(F.min(F.struct("rank", "query_no")).alias("at"))
    turn = F.row_number().over(Window.partitionBy("id").orderBy("at", "url"))
    return first.withColumn("place", turn).where(F.col("place") <= most).select("id", "url", "place")


def ordered_matches(matches: DataFrame, most: int = 3) -> DataFrame:
    """A post's matches, page bodies before snippets and then by score, the first ``most`` with the total."""
    return bounded(matches, ["id"], [F.desc(F.col("source_kind") == "page_body"), F.desc("score"), "url"], most)


def examples(posts: DataFrame, most: int = 12) -> DataFrame:
    """Sample posts by severity and input order, with the head of their texts."""
    severity = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return posts.orderBy(severity, "ord").limit(most).select("id", "status", F.substring("text", 1, 240).alias("excerpt"))


def reply_groups(edges: DataFrame) -> DataFrame:
    """node and root (the group's smallest node) of reply edges (node, parent; a null parent: none).

    Parents that are no node of the archive, and a node's own id, count as none;
    cycles are groups like any other.
    """
    nodes = edges.select("node").distinct()
    real = edges.join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi").where("parent <> node")
    linked = components(real.select(F.greatest("node", "parent").alias("a"), F.least("node", "parent").alias("b")))
    return nodes.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def locked_selection(chosen: DataFrame, locked: DataFrame) -> DataFrame:
    """``locked`` (id, place) once it has rows, else ``chosen``; another choice than the locked one fails.

    A selection that was analysed is fixed for its archive: the same ids in the same order may be asked for again.
    """
    both = chosen.select(F.col("place"), F.col("id").alias("asked")).join(locked.select("place", F.col("id").alias("held")), "place", "full")
    seen = both.agg(F.count("held").alias("n"), F.count_if(~F.col("asked").eqNullSafe(F.col("held"))).alias("other"))
    free = both.join(F.broadcast(seen))  # one row
    same = (F.col("n") == 0) | (F.col("other") == 0)
    return free.select(F.when(same, F.coalesce("held", "asked")).otherwise(F.raise_error(F.lit("the selection is locked")).cast("string")).alias("id"), "place")

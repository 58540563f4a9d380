"""Rules over posts: findings by post, level and code, and the status that follows.

``findings`` is the union of one SELECT per rule, each a filter, a window or an
aggregate joined back. Evidence lists are bounded; their totals are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwarden.functions.text import COMPARABLE, bound, clean, contained_shares
from inkwarden.operators.near import PARTIAL, WHOLE
from inkwarden.operators.posts import STATUSES
from inkwarden.session import stage

PEERS, MEANINGFUL = 8, 35
#: Fixed value: explicit requests for interaction, as clean text.
PHRASES = ("点赞转发关注", "关注并转发", "转发并关注", "点赞加关注", "互关互赞", "互赞互转", "likeandrepost", "followandrepost", "followandretweet")


def _finding(rows: DataFrame, level: str | None, code: str, total: Column | None = None) -> DataFrame:
    return rows.select("id", F.lit(level).cast("string").alias("level"), F.lit(code).alias("code"), (total if total is not None else F.lit(None)).cast("long").alias("total"))


def exact_groups(posts: DataFrame) -> DataFrame:
    """Members of groups with the same clean text: id, members and up to eight ``peers``, the first by input.

    ``posts`` has clean. Only digests move; a group's sample is aggregated before it
    is joined back, so a group of any size costs its members one row each.
    """
    return _exact_groups(posts.select("id", "ord", "type", F.length("clean").alias("n_clean"), F.sha2("clean", 256).alias("key")))


def _exact_groups(narrow: DataFrame) -> DataFrame:
    # the first nine by input order of each text: partial top-k per task, not a whole group in one row
    place = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    keyed = narrow.where((F.col("n_clean") >= COMPARABLE) & (F.col("type") != "repost")).select("id", "ord", "key")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    heads = keyed.withColumn("k", place).where(F.col("k") <= PEERS + 1).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("head"))
    out = keyed.join(sizes.join(heads, "key"), "key")
    peers = F.slice(F.transform(F.filter("head", lambda p: p["id"] != F.col("id")), lambda p: p["id"]), 1, PEERS)
    return out.select("id", "members", peers.alias("peers"))


def same_media(posts: DataFrame) -> DataFrame:
    """id, hash and posts of media files that two posts or more share, reposts included."""
    files = posts.select("id", F.explode("media").alias("m")).where("m.hash <> ''").select("id", F.col("m.hash").alias("hash")).distinct()
    shared = files.groupBy("hash").agg(F.count("*").alias("posts")).where("posts > 1")
    return files.join(shared, "hash").select("id", "hash", "posts")


def threads(posts: DataFrame) -> DataFrame:
    """thread_id, members and whether the thread is missing parts, inconsistent or unknown, by its declared numbers.

    Zero orders and totals count as undeclared.
    """
    order, total = (F.when(F.col(c) > 0, F.col(c)) for c in ("thread_order", "thread_total"))
    found = posts.where("thread_id <> ''").groupBy("thread_id").agg(
        F.count("*").alias("members"),
        F.countDistinct(total).alias("totals"),
        F.max(total).alias("total"),
        F.count(order).alias("orders"),
        F.countDistinct(order).alias("distinct_orders"),
        F.max(order).alias("last"),
        F.bool_or(F.coalesce(~F.col("thread_complete"), F.lit(False))).alias("declared_missing"),
        F.bool_and(F.coalesce(F.col("thread_complete"), F.lit(False))).alias("declared_complete"),
    )
    present = F.when(F.col("orders") > 0, F.col("distinct_orders")).otherwise(F.col("members"))
    return found.select(
        "thread_id",
        "members",
        ((F.coalesce("total", "members") > present) | F.col("declared_missing")).alias("missing"),
        ((F.col("totals") > 1) | (F.col("orders") != F.col("distinct_orders")) | F.coalesce(F.col("last") > F.col("total"), F.lit(False))).alias("inconsistent"),
        ((F.col("totals") == 0) & ~F.col("declared_complete")).alias("unknown"),
    )


def _held(phrases: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.col("clean"), p))


def repeated_phrases(posts: DataFrame, phrases: tuple[str, ...] = PHRASES, least: int = 3) -> DataFrame:
    """id, phrase and posts of phrases that ``least`` posts or more hold. ``posts`` has clean."""
    return _repeated(posts.select("id", _held(phrases).alias("held")), least)


def _repeated(narrow: DataFrame, least: int = 3) -> DataFrame:
    hits = narrow.select("id", F.explode("held").alias("phrase")).distinct()
    often = hits.groupBy("phrase").agg(F.count("*").alias("posts")).where(F.col("posts") >= least)
    return hits.join(often, "phrase").select("id", "phrase", "posts")


def _source_codes() -> Column:
    """Array of (level, code, overlap), one or two for each source of a row that has clean, contribution, sources and what ``_compared`` adds."""

    def judged(s: Column, text: Column, share: Column) -> Column:
        short = F.least(F.length("clean"), F.length(text)) < COMPARABLE
        return bound(F.when((text != "") & ~short, F.when(F.col("clean") == text, 1.0).otherwise(share)), lambda o: coded(s, text, short, o))

    def coded(s: Column, text: Column, short: Column, overlap: Column) -> Column:
        meaningful, own = F.length(clean(F.col("contribution"))) >= MEANINGFUL, s["owner"] == "self"
        told = lambda level, code: F.struct(F.lit(level).cast("string").alias("level"), F.lit(code).alias("code"), overlap.alias("overlap"))
        return (
            F.when((text == "") & (s["url"] != ""), F.array(told("review", "source_link_unchecked")))
            .when(text == "", F.array(told("review", "source_missing")))
            .when(short, F.array(told(None, "source_short")))
            .when((overlap >= WHOLE) & own, F.array(told("review", "self_crosspost_claim")))
            .when((overlap >= WHOLE) & meaningful, F.array(told("review", "source_overlap_with_contribution")))
            .when(overlap >= WHOLE, F.array(told("high_risk", "source_overlap_no_contribution")))
            .when(overlap >= PARTIAL, F.array(told("review", "source_partial_overlap")))
            .when(own | meaningful, F.array(told(None, "source_no_high_overlap")))
            .otherwise(F.array(told(None, "source_no_high_overlap"), told("review", "source_contribution_unexplained")))
        )

    return F.flatten(F.transform("sources", lambda s, i: judged(s, F.get("_cleaned", i), F.get("_shares", i))))


def _compared(posts: DataFrame) -> DataFrame:
    """``posts`` with the clean texts of their sources and, where both are long enough and differ, the share of the post's grams in each."""
    cleaned = posts.withColumn("_cleaned", F.transform("sources", lambda s: clean(s["text"])))
    asked = F.transform("_cleaned", lambda c: F.when((F.length(c) >= COMPARABLE) & (c != F.col("clean")), c))
    able = (F.length("clean") >= COMPARABLE) & F.exists(asked, lambda c: c.isNotNull())
    return cleaned.withColumn("_shares", contained_shares(F.when(able, F.col("clean")), F.when(able, asked)))


def source_codes(posts: DataFrame) -> DataFrame:
    """id, level, code and overlap for each source that a post names. ``posts`` has clean."""
    return _compared(posts.where(F.size("sources") > 0)).select("id", F.explode(_source_codes()).alias("c")).select("id", "c.level", "c.code", "c.overlap")


def findings(posts: DataFrame, near: DataFrame | None = None, phrases: tuple[str, ...] = PHRASES) -> DataFrame:
    """id, level (null: informs only), code and total of every rule that a post meets.

    ``posts`` has clean; ``near`` has id and other of near-duplicate pairs. Texts are
    read once, into a narrow table with the codes of all rules that see one post
    alone; the others join its digests, media, threads and phrases. A post counts its
    near-duplicates in full; which eight are shown is for ``near_reasons``.
    """
    repost, told = F.col("type") == "repost", lambda test, level, code: F.when(test, F.array(F.struct(F.lit(level).cast("string").alias("level"), F.lit(code).alias("code"))))
    alone = [
        told(repost, "review", "repost_record"),
        told(~repost & (F.col("clean") == ""), "insufficient", "missing_text"),
        told(~F.coalesce(F.col("text_complete"), repost), "insufficient", "text_incomplete"),
        told(F.size("missing_media") > 0, "insufficient", "media_missing"),
        F.transform(F.filter("media", lambda m: m["hash"] == ""), lambda _: F.struct(F.lit("insufficient").alias("level"), F.lit("media_reference_only").alias("code"))),
        told((F.size("media") > 0) & F.forall("media", lambda m: m["hash"] != ""), "review", "media_content_unchecked"),
        F.transform(_source_codes(), lambda c: F.struct(c["level"].alias("level"), c["code"].alias("code"))),
        told((F.col("type") == "quote") & (F.size("sources") == 0), "review", "quote_source_missing"),
        told(F.col("creation_method") != "", None, "creation_method_declared"),
        told(F.size("evidence") > 0, None, "evidence_reference"),
    ]
    none = F.array().cast("array<struct<level:string,code:string>>")
    codes = F.flatten(F.array(*[F.coalesce(a, none) for a in alone]))
    narrow = stage(_compared(posts).select("id", "ord", "type", "media", "thread_id", "thread_order", "thread_total", "thread_complete", F.length("clean").alias("n_clean"), F.sha2("clean", 256).alias("key"), _held(phrases).alias("held"), codes.alias("codes")), "narrow-posts")
    rules = [
        narrow.select("id", F.explode("codes").alias("c")).select("id", "c.level", "c.code", F.lit(None).cast("long").alias("total")),
        _finding(_exact_groups(narrow), "high_risk", "internal_exact", F.col("members") - 1),
        _finding(same_media(narrow), "review", "media_same_hash", F.col("posts") - 1),
        _finding(narrow.join(threads(narrow).where("missing OR inconsistent OR unknown"), "thread_id"), "insufficient", "thread_incomplete", F.col("members")),
        _finding(_repeated(narrow), "review", "repeated_engagement_phrase", F.col("posts")),
    ]
    if near is not None:
        rules.append(_finding(_sides(near).groupBy("id").agg(F.count("*").alias("pairs")), "review", "internal_near", F.col("pairs")))
    found = stage(reduce(DataFrame.unionByName, rules), "findings")
    clear = narrow.join(found.select("id").distinct(), "id", "left_anti")
    return found.unionByName(_finding(clear, None, "no_supplied_text_match"))


def _sides(near: DataFrame) -> DataFrame:
    return near.select("id", "other", "similarity").union(near.select(F.col("other").alias("id"), F.col("id").alias("other"), "similarity"))


def near_reasons(near: DataFrame, most: int = PEERS) -> DataFrame:
    """id, other, similarity, place and total: the ``most`` closest near-duplicates of each post, of equals the first by id."""
    sides = _sides(near)
    totals = sides.groupBy("id").agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return sides.withColumn("place", place).where(F.col("place") <= most).join(totals, "id").select("id", "other", "similarity", "place", "total")


def statuses(posts: DataFrame, found: DataFrame) -> DataFrame:
    """``posts`` with the status of its gravest finding."""
    level = found.where("level IS NOT NULL").groupBy("id").agg(F.min(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("level"))).alias("_n"))
    return posts.join(level, "id", "left").withColumn("status", F.coalesce(F.get(F.array(*map(F.lit, STATUSES)), (F.col("_n") - 1).cast("int")), F.lit("low_signal"))).drop("_n")


def status_histogram(with_status: DataFrame) -> DataFrame:
    """All four statuses with their posts, zeros included."""
    every = with_status.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counted = with_status.groupBy("status").agg(F.count("*").alias("posts"))
    return every.join(counted, "status", "left").select("status", F.coalesce("posts", F.lit(0)).alias("posts"))


def code_counts(found: DataFrame) -> DataFrame:
    """Posts by code, each post once."""
    return found.groupBy("code").agg(F.countDistinct("id").alias("posts"))


def nonduplicate(posts: DataFrame, found: DataFrame) -> DataFrame:
    """One row: comparable posts, those without an internal duplicate, and the share, null of none."""
    dup = found.where(F.col("code").isin("internal_exact", "internal_near")).select("id").distinct().withColumn("dup", F.lit(1))
    able = posts.where((F.col("type") != "repost") & F.coalesce("text_complete", F.lit(False)) & (F.length("clean") >= COMPARABLE))
    out = able.join(dup, "id", "left").agg(F.count("*").alias("denominator"), F.count_if(F.col("dup").isNull()).alias("numerator"))
    return out.withColumn("share", F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")))


def coverage(posts: DataFrame, expected: int | None, invalid_dates: int = 0) -> DataFrame:
    """One row of counts over the posts in scope, and their share of the declared total; null where that is unknown."""
    out = posts.agg(
        F.count("*").alias("analyzed"),
        F.count_if(F.col("clean") != "").alias("with_text"),
        F.count_if((F.col("clean") != "") & F.coalesce("text_complete", F.lit(False))).alias("complete_text"),
        F.coalesce(F.sum(F.size("media")), F.lit(0)).alias("media_references"),
        F.coalesce(F.sum(F.size(F.filter("media", lambda m: m["hash"] != ""))), F.lit(0)).alias("hashed_media"),
    )
    known = F.lit(expected).cast("long")
    return out.withColumns({
        "coverage": F.when((known > 0) & (F.col("analyzed") <= known) & F.lit(invalid_dates == 0), F.col("analyzed") / known),
        "media_coverage": F.when(F.col("media_references") > 0, F.col("hashed_media") / F.col("media_references")),
    })


def account_conclusion(with_status: DataFrame) -> DataFrame:
    """One row: posts, those with a finding to act on, and what that says of the account."""
    out = with_status.agg(F.count("*").alias("posts"), F.count_if(F.col("status") != "low_signal").alias("to_act_on"))
    return out.withColumn("conclusion", F.when(F.col("posts") == 0, "no_material").when(F.col("to_act_on") > 0, "needs_handling").otherwise("no_clear_risk"))


def coverage_notes(posts: Column, invalid: Column, outside: Column, expected: Column, complete: Column, missing: Column) -> Column:
    """What limits a result, in order: dates that cannot be read, posts outside the range, more posts than declared, a scope not declared complete, and what is declared missing."""
    notes = [
        F.when(invalid > 0, F.concat(F.lit("invalid_dates:"), invalid.cast("string"))),
        F.when(outside > 0, F.concat(F.lit("outside_range:"), outside.cast("string"))),
        F.when(posts > expected, F.lit("more_than_declared")),
        F.when(~F.coalesce(complete, F.lit(False)), F.lit("not_declared_complete")),
        F.when(F.coalesce(missing, F.lit("")) != "", F.concat(F.lit("known_missing:"), missing)),
    ]
    return F.filter(F.array(*notes), lambda n: n.isNotNull())


#: What a result over a whole archive names as its reasons, in order, and how much of a post its examples show.
ARCHIVE_REASONS = ("internal_exact", "internal_near", "repost_record", "quote_source_missing", "text_incomplete", "missing_text", "media_reference_only", "media_same_hash", "media_content_unchecked", "repeated_engagement_phrase")
EXAMPLES, EXAMPLE_CHARS, EXAMPLE_REASONS = 12, 240, 4


def archive_result(posts: DataFrame, found: DataFrame) -> DataFrame:
    """One row over an archive of any size: counts, shares, reasons with the posts that they hold for, and the gravest posts as examples.

    Findings become one row a post with its codes, which is written; every count is one
    aggregate over it, and the examples are the first of a partial top-k. Without a
    reason, ``no_internal_match`` holds for all comparable posts. Shares are null of none.
    """
    codes = found.groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    narrow = statuses(posts, found).join(codes, "id", "left").select(
        "id", "ord", "url", "type", "status", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), F.substring("text", 1, EXAMPLE_CHARS).alias("text"),
        F.size("media").alias("media"), F.size(F.filter("media", lambda m: m["hash"] != "")).alias("hashed"),
        ((F.col("type") != "repost") & F.coalesce("text_complete", F.lit(False)) & (F.length("clean") >= COMPARABLE)).alias("able"),
    )
    rows = stage(narrow, "archive-posts")
    has = lambda code: F.array_contains("codes", code)
    counted = rows.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("type").isin(*kinds)).alias(name) for name, kinds in (("posts", ("original", "article")), ("replies", ("reply",)), ("reposts", ("repost",)), ("quotes", ("quote",)))],
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.count_if("able").alias("nonduplicate_denominator"),
        F.count_if(F.col("able") & ~has("internal_exact") & ~has("internal_near")).alias("nonduplicate_numerator"),
        F.count_if((F.col("type") != "repost") & ~F.col("able")).alias("comparison_excluded"),
        F.coalesce(F.sum("media"), F.lit(0)).alias("media_references"),
        F.coalesce(F.sum("hashed"), F.lit(0)).alias("hashed_media"),
        *[F.count_if(has(c)).alias(f"_{c}") for c in ARCHIVE_REASONS],
    )
    told = F.filter(F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"_{c}").alias("posts")) for c in ARCHIVE_REASONS]), lambda r: r["posts"] > 0)
    none = F.array(F.struct(F.lit("no_internal_match").alias("code"), F.col("nonduplicate_denominator").alias("posts")))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.round(100 * F.col(part) / F.col(whole), 1))
    summed = counted.withColumns({
        "nonduplicate_percent": share("nonduplicate_numerator", "nonduplicate_denominator"),
        "media_completeness_percent": share("hashed_media", "media_references"),
        "reasons": F.when(F.size(told) > 0, told).otherwise(none),
    })
    grave = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    first = rows.orderBy(grave, "ord").limit(EXAMPLES).select(F.struct(grave.alias("grave"), "ord", "id", "url", "status", "text", F.slice("codes", 1, EXAMPLE_REASONS).alias("codes")).alias("e"))
    examples = first.agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e["id"].alias("id"), e["url"].alias("url"), e["status"].alias("status"), e["text"].alias("text"), e["codes"].alias("codes"))).alias("examples"))
    return summed.drop(*[f"_{c}" for c in ARCHIVE_REASONS]).crossJoin(examples)  # one row each

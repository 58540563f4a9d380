"""Records to the posts table: aliases, unknown values, types, media, sources and long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.operators.posts import complete_schema, first_wins
from inkwarden.sources.readers import UNKNOWN, Limits

#: The names that a field may have, in order of precedence.
ALIASES = {
    "id": ("id", "id_str", "post_id", "tweet_id", "帖子标识", "帖子编号", "编号"),
    "url": ("url", "link", "post_url", "tweet_url", "帖子链接", "链接"),
    "text": ("text", "full_text", "content", "body", "正文", "帖子原文", "帖子正文", "原文"),
    "created_at": ("created_at", "date", "timestamp", "发布时间", "时间", "日期"),
    "type": ("type", "post_type", "类型", "帖子类型"),
    "thread_id": ("thread_id", "conversation_id", "所属线程", "线程", "线程编号"),
    "thread_order": ("thread_order", "线程顺序"),
    "thread_total": ("thread_total", "线程总数"),
    "thread_complete": ("thread_complete", "线程是否完整"),
    "text_complete": ("text_complete", "正文是否完整", "正文或长文是否完整"),
    "contribution": ("contribution", "original_contribution", "本人新增的分析、观点、报道或创作", "原创贡献", "本人新增贡献"),
    "creation_method": ("creation_method", "创作方式"),
    "evidence": ("evidence", "证据", "证据文件名"),
    "notes": ("notes", "备注", "本人补充说明"),
    "source_url": ("source_url", "source_link", "来源链接", "来源链接或出处"),
    "source_text": ("source_text", "来源原文", "来源正文"),
    "source_owner": ("source_owner", "素材归属"),
    "media": ("media", "媒体", "媒体文件", "图片文件", "视频文件"),
}
#: Labels of post types and of owners.
TYPES = {
    "original": ("original", "主帖", "原创", "post", "tweet"), "reply": ("reply", "回复"), "quote": ("quote", "引用帖", "引用"),
    "repost": ("repost", "retweet", "普通转帖", "转帖", "转发"), "article": ("article", "长文"),
}
OWNERS = {"self": ("self", "本人", "本人制作", "本人跨平台"), "other": ("other", "他人", "他人来源", "third_party"), "mixed": ("mixed", "混合素材")}
YES, NO = ("是", "true", "yes", "1", "完整", "全量"), ("否", "false", "no", "0", "不完整")
NO_MEDIA = ("无媒体", "有媒体")
KNOWN = frozenset(n for names in ALIASES.values() for n in names)
MEDIA_TYPE = "array<struct<name:string,hash:string,kind:string,hash_origin:string>>"
SOURCE_TYPE = "array<struct<text:string,url:string,owner:string,notes:string>>"


def at(record: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, path, kind)


def field(record: str, key: str, kind: str = "string") -> Column:
    """The first alias of a field that is there and not null. Objects and lists as strings are JSON."""
    return F.coalesce(*[at(record, f"$['{n}']", kind) for n in ALIASES.get(key, (key,))])


def string(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def known(value: Column) -> Column:
    """The trimmed string, or an empty one for a word that means unknown."""
    text = string(value)
    return F.when(F.lower(text).isin(*UNKNOWN), "").otherwise(text)


def tri_state(value: Column) -> Column:
    text = F.lower(string(value))
    return F.when(text.isin(*YES), True).when(text.isin(*NO), False)


def whole_number(value: Column) -> Column:
    n = string(value).try_cast("long")
    return F.when(n >= 0, n)


def labelled(value: Column, labels: dict[str, tuple[str, ...]], default: Column) -> Column:
    text = F.lower(string(value))
    out = F.when(F.lit(False), F.lit(""))
    for name, words in labels.items():
        out = out.when(text.isin(*words), name)
    return out.otherwise(default)


def truthy(record: str, *paths: str) -> Column:
    found = [F.coalesce(at(record, p), F.lit("")) for p in paths]
    out = F.lit(False)
    for value in found:
        out = out | ~value.isin("", "false", "0", "{}", "[]")
    return out


def post_type(record: str) -> Column:
    """By label; without a known one by the record's own signs."""
    signs = (
        F.when(truthy(record, "$.retweeted_status") | F.coalesce(at(record, "$.full_text"), at(record, "$.text"), F.lit("")).startswith("RT @"), "repost")
        .when(truthy(record, "$.in_reply_to_status_id_str", "$.in_reply_to_status_id"), "reply")
        .when(truthy(record, "$.is_quote_status", "$.quoted_status_id_str", "$.quoted_status_id"), "quote")
        .otherwise("original")
    )
    return labelled(field(record, "type"), TYPES, signs)


def archive_type(record: str, text: Column) -> Column:
    """By the record's signs only: repost, then reply, then quote, else original."""
    return (
        F.when(truthy(record, "$.retweeted_status", "$.retweeted_status_id_str") | text.rlike(r"^RT\s+@"), "repost")
        .when(truthy(record, "$.in_reply_to_status_id_str", "$.in_reply_to_status_id"), "reply")
        .when(truthy(record, "$.is_quote_status", "$.quoted_status_id_str", "$.quoted_status_id", "$.quoted_status_permalink"), "quote")
        .otherwise("original")
    )


def items(record: str, key: str) -> Column:
    """A list field: a list as it is, a string that reads as one parsed, any other value as its only item."""
    plain = F.coalesce(*[at(record, f"$['{n}']", "variant") for n in ALIASES.get(key, (key,))])
    text = F.trim(plain.try_cast("string"))
    listed = F.when(F.schema_of_variant(plain).startswith("ARRAY"), F.try_variant_get(plain, "$", "array<variant>"))
    parsed = F.when(text.startswith("["), F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"))
    none = F.array().cast("array<variant>")
    return F.when(plain.isNull() | (text == ""), none).otherwise(F.coalesce(listed, parsed, F.array(plain)))


def strings(record: str, key: str) -> Column:
    return F.transform(items(record, key), lambda v: F.try_variant_get(v, "$", "string"))


def media(record: str) -> Column:
    """Media by name, hash and kind; a hash that is none is dropped, and names in one string are split."""

    def of(v: Column) -> Column:
        get = lambda *paths: F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])
        digest = F.lower(string(get("$.hash", "$.sha256")))
        digest = F.when(digest.rlike("^[a-f0-9]{64}$"), digest).otherwise("")
        kind = F.coalesce(get("$.kind", "$.type"), F.lit("unknown"))
        kind = F.when(kind == "photo", "image").when(kind.isin("image", "video", "animated_gif"), kind).otherwise("unknown")
        one = F.struct(string(get("$.name", "$.filename", "$.media_url_https")).alias("name"), digest.alias("hash"), kind.alias("kind"), F.coalesce(get("$.hash_origin"), F.when(digest != "", "submitted").otherwise("")).alias("hash_origin"))
        plain = F.filter(F.transform(F.split(F.try_variant_get(v, "$", "string"), "[;；\n]"), lambda n: F.trim(n)), lambda n: ~F.lower(n).isin(*UNKNOWN, "") & ~n.isin(*NO_MEDIA))
        named = F.transform(plain, lambda n: F.struct(n.alias("name"), F.lit("").alias("hash"), F.lit("unknown").alias("kind"), F.lit("").alias("hash_origin")))
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(one)).otherwise(named)

    return F.flatten(F.transform(items(record, "media"), of)).cast(MEDIA_TYPE)


def sources(record: str) -> Column:
    """Sources listed, and one from the flat fields."""

    def of(v: Column) -> Column:
        get = lambda *paths: F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])
        full = F.struct(string(get("$.text", "$.source_text")).alias("text"), string(get("$.url", "$.link")).alias("url"), labelled(get("$.owner", "$.ownership"), OWNERS, F.lit("unknown")).alias("owner"), string(get("$.notes")).alias("notes"))
        bare = F.struct(F.lit("").alias("text"), string(F.try_variant_get(v, "$", "string")).alias("url"), F.lit("unknown").alias("owner"), F.lit("").alias("notes"))
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), full).otherwise(bare)

    flat_text, flat_url = known(field(record, "source_text")), known(field(record, "source_url"))
    flat = F.struct(flat_text.alias("text"), flat_url.alias("url"), labelled(field(record, "source_owner"), OWNERS, F.lit("unknown")).alias("owner"), F.lit("").alias("notes"))
    return F.concat(F.transform(items(record, "sources"), of), F.when((flat_text != "") | (flat_url != ""), F.array(flat)).otherwise(F.array().cast(SOURCE_TYPE))).cast(SOURCE_TYPE)


def normalize(records: DataFrame, limits: Limits = Limits(), archive: bool = False) -> DataFrame:
    """The posts table of ``records`` (record, ord), repeats merged. Records over a limit fail the whole input.

    Archives keep texts that look like unknown values.
    """
    text = string(field("record", "text")) if archive else known(field("record", "text"))
    post_id = F.when(string(field("record", "id")) != "", string(field("record", "id"))).otherwise(F.format_string("P%04d", F.col("ord")))
    url = known(field("record", "url"))
    url = F.when((url == "") & F.col("id").rlike(r"^\d{8,}$"), F.concat(F.lit("https://x.com/i/status/"), "id")).otherwise(url)
    given = field("record", "text_complete").isNotNull()
    rows = records.select("ord", "record", post_id.alias("id"), text.alias("text")).select(
        "ord", "id", "text", url.alias("url"), known(field("record", "created_at")).alias("created_at"), post_type("record").alias("type"),
        known(field("record", "thread_id")).alias("thread_id"), whole_number(field("record", "thread_order")).alias("thread_order"),
        whole_number(field("record", "thread_total")).alias("thread_total"), tri_state(field("record", "thread_complete")).alias("thread_complete"),
        F.when(given, tri_state(field("record", "text_complete"))).when(F.col("text") != "", True).alias("text_complete"),
        media("record").alias("media"), sources("record").alias("sources"), known(field("record", "contribution")).alias("contribution"),
        known(field("record", "creation_method")).alias("creation_method"), strings("record", "evidence").alias("evidence"), known(field("record", "notes")).alias("notes"),
        strings("record", "missing_media").alias("missing_media"), known(F.coalesce(at("record", "$.reply_to"), at("record", "$.in_reply_to_status_id_str"))).alias("reply_to"),
        known(F.coalesce(at("record", "$.quoted_url"), at("record", "$.quoted_status_permalink"))).alias("quoted_url"),
    )
    return first_wins(complete_schema(within(rows, limits)))


def over_limit(limits: Limits, posts: Column, longest: Column, total: Column | None = None) -> Column:
    """Whether so many posts, the longest text of so many characters and all together of ``total``, are refused."""
    out = F.lit(False)
    if limits.total_chars is not None and total is not None:
        out = out | (total > limits.total_chars)
    if limits.posts is not None:
        out = out | (posts > limits.posts)
    return out if limits.text_chars is None else out | (longest > limits.text_chars)


def within(rows: DataFrame, limits: Limits) -> DataFrame:
    """``rows``, or a failure where one is over a limit."""
    if limits.text_chars is not None:
        rows = rows.where(F.assert_true(F.length("text") <= limits.text_chars, F.lit("a text is over the limit")).isNull())
    whole = [(limits.posts, F.count("*"), "more posts than the limit"), (limits.total_chars, F.coalesce(F.sum(F.length("text")), F.lit(0)), "the texts together are over the limit")]
    for most, measured, fault in whole:
        if most is not None:
            one = rows.agg(F.assert_true(measured <= most, F.lit(fault)).alias("_ok"))
            rows = rows.join(F.broadcast(one)).where("_ok IS NULL").drop("_ok")
    return rows


# ---------------------------------------------------------------- archives


def long_text(record: str) -> tuple[Column, Column]:
    """The fullest text that a record holds, and whether it is complete (null where unknown)."""
    notes = [f"$.{n}{rest}" for n in ("note_tweet", "noteTweet") for rest in (".text", ".note_tweet_results.result.text", ".noteTweetResults.result.text")]
    whole = F.coalesce(*[at(record, p) for p in (*notes, "$.extended_tweet.full_text")])
    short = F.coalesce(at(record, "$.full_text"), at(record, "$.text"), F.lit(""))
    links = F.coalesce(F.try_variant_get(record, "$.entities.urls", "array<variant>"), F.array().cast("array<variant>"))
    article = F.exists(links, lambda u: F.coalesce(F.try_variant_get(u, "$.expanded_url", "string"), F.lit("")).rlike(r"https?://(?:www\.)?(?:x|twitter)\.com/i/article/"))
    cut = F.coalesce(at(record, "$.truncated", "boolean"), F.lit(False)) | truthy(record, "$.note_tweet_id", "$.note_tweet_id_str", "$.note_tweet", "$.noteTweet", "$.is_longform") | article
    return F.coalesce(whole, short), F.when(whole.isNotNull(), True).when(cut, False).when(short != "", True)


def _media_base(url: Column) -> Column:
    """The file name in a link's path, percent-decoded; empty where there is none."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    parts = F.filter(F.split(plain, "/"), lambda p: ~p.isin("", "."))
    last = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))
    return F.when(last.isin("..") | F.contains(last, F.lit("\\")), "").otherwise(last)


def _kind_of(v: Column) -> Column:
    """OBJECT, ARRAY or another word for what a variant holds; null for an absent one."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def archive_media(record: str, post_id: Column) -> Column:
    """Media references by the names that their files may have in the archive; repeated references once.

    A reference without a file name is named by how many references stand before it.
    Media that are no list, or a reference that is no object, fail the whole input.
    """
    of_entities = lambda name: F.try_variant_get(record, f"$.{name}", "variant")
    holder = F.when(_kind_of(of_entities("extended_entities")) == "OBJECT", of_entities("extended_entities")).otherwise(of_entities("entities"))
    given = F.when(_kind_of(holder) == "OBJECT", F.try_variant_get(holder, "$.media", "variant"))
    listed = F.try_variant_get(given, "$", "array<variant>")
    none = F.array().cast("array<variant>")
    refs = F.when(given.isNull(), none).when(_kind_of(given) == "ARRAY", listed).otherwise(F.raise_error(F.lit("an archive record's media are no list")).cast("array<variant>"))

    def urls_of(v: Column, kind: Column) -> Column:
        variants = F.coalesce(F.try_variant_get(v, "$.video_info.variants", "array<variant>"), none)
        link = lambda x: F.coalesce(F.try_variant_get(x, "$.url", "string"), F.lit(""))
        films = F.transform(F.filter(variants, lambda x: (F.try_variant_get(x, "$.content_type", "string") == "video/mp4") | F.regexp_replace(link(x), r"\?.*$", "").endswith(".mp4")), link)
        still = F.array(F.coalesce(F.try_variant_get(v, "$.media_url_https", "string"), F.try_variant_get(v, "$.media_url", "string"), F.lit("")))
        return F.when(kind.isin("video", "animated_gif") & (F.size(films) > 0), films).otherwise(still)

    def named(v: Column) -> Column:
        kind = F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("unknown"))
        bases = F.filter(F.transform(urls_of(v, kind), _media_base), lambda b: b != "")
        names = F.array_distinct(F.transform(bases, lambda b: F.concat(post_id, F.lit("-"), b)))
        told = F.struct(names.alias("names"), F.when(kind == "photo", "image").otherwise(kind).alias("kind"))
        return F.when(_kind_of(v) == "OBJECT", told).otherwise(F.raise_error(F.lit("an archive record's media reference is no object")).cast("struct<names:array<string>,kind:string>"))

    kept = "array<struct<names:array<string>,kind:string>>"

    def added(found: Column, m: Column) -> Column:
        names = F.when(F.size(m["names"]) > 0, m["names"]).otherwise(F.array(F.concat(post_id, F.lit("-media-"), (F.size(found) + 1).cast("string"))))
        one = F.array(F.struct(names.alias("names"), m["kind"].alias("kind"))).cast(kept)
        return F.when(F.exists(found, lambda o: o["names"] == names), found).otherwise(F.concat(found, one))

    return F.aggregate(F.transform(refs, named), F.array().cast(kept), added)


def known_missing(record: str) -> Column:
    """What a project's scope says is missing: a list joined, or the text itself."""
    return F.array_join(strings(record, "known_missing"), "；")


def archive_posts(records: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """The posts table of archive records; ``hashes`` has name and hash of the media files that were found."""
    text, complete = long_text("record")
    post_id = string(F.coalesce(at("record", "$.id_str"), at("record", "$.id")))
    rows = records.select("ord", "record", F.when(post_id != "", post_id).otherwise(F.raise_error(F.lit("an archive record has no id")).cast("string")).alias("id"), text.alias("text"), complete.alias("text_complete"))
    rows = rows.select("ord", "id", F.trim("text").alias("text"), "text_complete", archive_type("record", F.col("text")).alias("type"), F.concat(F.lit("https://x.com/i/status/"), "id").alias("url"),
                       F.coalesce(at("record", "$.created_at"), F.lit("")).alias("created_at"), string(F.coalesce(at("record", "$.in_reply_to_status_id_str"), at("record", "$.in_reply_to_status_id"))).alias("reply_to"), archive_media("record", F.col("id")).alias("refs"))
    bare = F.transform("refs", lambda r: F.struct(r["names"][0].alias("name"), F.lit("").alias("hash"), r["kind"].alias("kind"), F.lit("").alias("hash_origin")))
    if hashes is None:
        return first_wins(complete_schema(rows.withColumn("media", bare)))
    # the first of a reference's names that has a hash wins
    names = rows.select("ord", F.posexplode("refs").alias("place", "r")).select("ord", "place", "r.kind", F.posexplode("r.names").alias("nth", "name"))
    valid = hashes.where(F.col("hash").rlike("^[a-fA-F0-9]{64}$")).groupBy("name").agg(F.lower(F.max("hash")).alias("hash"))
    best = names.join(valid, "name", "left").groupBy("ord", "place", "kind").agg(F.min_by("name", "nth").alias("plain"), F.min(F.when(F.col("hash").isNotNull(), F.struct("nth", "name", "hash"))).alias("hit"))
    item = F.struct(F.coalesce("hit.name", "plain").alias("name"), F.coalesce("hit.hash", F.lit("")).alias("hash"), F.col("kind"), F.when(F.col("hit").isNotNull(), "local_file").otherwise("").alias("hash_origin"))
    linked = best.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("place", item.alias("m")))).alias("l"))
    out = rows.join(linked, "ord", "left").withColumn("media", F.coalesce(F.transform("l", lambda x: x["m"]), bare))
    return first_wins(complete_schema(out))

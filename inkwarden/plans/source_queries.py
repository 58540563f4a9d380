"""Queries over the readers and the normalisation, each next to SQL that must give the same rows.

Files and records are made from ``documents``: every row becomes a record whose
fields bear one of their names, with values of one of their forms, by its number.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwarden.functions import text
from inkwarden.operators import findings, posts, web
from inkwarden.plans.queries import fixture_status, query, table
from inkwarden.sources import normalize, readers
from inkwarden.session import fresh_path
from inkwarden.streaming import budgets

def k() -> Column:
    return F.col("doc_id")


def pick(by: int, *values) -> Column:
    """The value at ``doc_id`` modulo ``by``; columns or literals."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, v in enumerate(values):
        out = out.when(by and k() % by == i, v if isinstance(v, Column) else F.lit(v))
    return out


def records(spark: SparkSession, sf_dir: str, **fields: Column) -> DataFrame:
    """doc_id, ord and record: the fields that are not null, as JSON."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (k() + 1).alias("ord"), F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("j")).select("doc_id", "ord", F.parse_json("j").alias("record"))


def listed(c: Column) -> Column:
    return F.array_join(c, "|")


# ---------------------------------------------------------------- files

_TEXT_ROWS = "SELECT doc_id::VARCHAR AS id, md5(coalesce(trim(text), '')) AS text FROM documents"


def _read(texts: DataFrame, kind: str) -> DataFrame:
    out = readers.ordered(readers.records_of(texts, kind))
    return out.select(normalize.field("record", "id").alias("id"), F.md5(F.trim(F.coalesce(normalize.field("record", "text"), F.lit("")))).alias("text"))


def _files(spark: SparkSession, sf_dir: str, item: Column, name: Column) -> DataFrame:
    """file and items: documents of ten consecutive numbers in a file."""
    d = table(spark, sf_dir, "documents").select(F.floor(k() / 10).alias("no"), "doc_id", item.alias("item"))
    return d.groupBy("no").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"]).alias("items")).select(name.alias("file"), "no", "items")


def _item() -> Column:
    return F.to_json(F.struct(k().cast("string").alias("id_str"), F.col("text").alias("full_text")))


@query(_TEXT_ROWS)
def json_files(spark, sf_dir):
    """Lists, objects with posts, records or tweets, and wrapped records."""
    files = _files(spark, sf_dir, F.when(k() % 3 == 0, F.concat(F.lit('{"tweet":'), _item(), F.lit("}"))).when(k() % 3 == 1, F.concat(F.lit('{"post":'), _item(), F.lit("}"))).otherwise(_item()), F.concat(F.lit("f"), F.col("no"), F.lit(".json")))
    body = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    key = F.get(F.array(*map(F.lit, ("posts", "records", "tweets"))), (F.col("no") % 4).cast("int"))
    return _read(files.select("file", F.when(key.isNull(), body).otherwise(F.concat(F.lit('{"'), key, F.lit('":'), body, F.lit("}"))).alias("text")), "json")


@query(_TEXT_ROWS)
def archive_files(spark, sf_dir):
    """Assignments of tweets and posts, with and without a part in the name, a semicolon and space around them."""
    files = _files(spark, sf_dir, F.concat(F.lit('{"tweet":'), _item(), F.lit("}")), F.concat(F.lit("data/tweets-part"), F.col("no"), F.lit(".js")))
    head = F.concat(F.when(F.col("no") % 2 == 0, " window.YTD.tweets").otherwise("window.YTD.post_part3"), F.lit(".part"), F.col("no"), F.lit(" = "))
    return _read(files.select("file", F.concat(head, F.lit("["), F.array_join("items", ",\n"), F.lit("]"), F.when(F.col("no") % 3 == 0, " ;\n").otherwise("")).alias("text")), "js")


@query("SELECT doc_id::VARCHAR AS id, md5(coalesce(trim(text), '')) AS text FROM documents")
def delimited_files(spark, sf_dir):
    """Files parted by commas, tabs and semicolons, with quoted line ends and quotes, under names in two languages."""
    cut = F.get(F.array(*map(F.lit, (",", "\t", ";"))), (F.floor(k() / 10) % 3).cast("int"))
    cell = F.concat(F.lit('"'), F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    files = _files(spark, sf_dir, F.concat(k().cast("string"), cut, F.lit('"x"'), cut, cell), F.concat(F.lit("f"), F.col("no"), F.lit(".csv")))
    sign = F.get(F.array(*map(F.lit, (",", "\t", ";"))), (F.col("no") % 3).cast("int"))
    header = F.when(F.col("no") % 2 == 0, F.concat(F.lit("编号"), sign, F.lit("备注"), sign, F.lit("正文"))).otherwise(F.concat(F.lit("id"), sign, F.lit("notes"), sign, F.lit("text")))
    return _read(files.select("file", F.concat(header, F.lit("\r\n"), F.array_join("items", "\r\n"), F.lit("\r\n")).alias("text")), "csv")


@query("SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents")
def decoded_texts(spark, sf_dir):
    """UTF-16 in both orders by its mark, UTF-8 with and without one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.unhex(F.lit("EFBBBF"))
    content = F.when(k() % 4 == 0, F.encode(text, "UTF-16")).when(k() % 4 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(k() % 4 == 2, F.concat(mark, F.encode(text, "UTF-8"))).otherwise(F.encode(text, "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(readers.decoded(content)).alias("text"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text, doc_id // 50 AS archive FROM documents")
def zip_archives(spark, sf_dir):
    """Archives of fifty documents each, written to the shared folder: two post files, a private one and a picture."""
    base = fresh_path(spark, "archives").removeprefix("file:")

    def write(batches):
        import os
        import zipfile

        os.makedirs(os.path.dirname(base), exist_ok=True)
        for rows in batches:
            for row in rows.to_pylist():
                path = f"{base}-{row['archive']}.zip"
                with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
                    for part in (0, 1):
                        z.writestr(f"data/tweets-part{part}.js", f"window.YTD.tweets.part{part} = [{','.join(x['json'] for x in row['items'] if x['doc_id'] % 2 == part)}]")
                    z.writestr("data/direct-messages.js", "never read")
                    z.writestr("media/p.png", path)
                yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    item = F.to_json(F.struct(F.struct(k().cast("string").alias("id_str"), F.coalesce("text", F.lit("")).alias("full_text")).alias("tweet")))
    files = table(spark, sf_dir, "documents").groupBy(F.floor(k() / 50).alias("archive")).agg(F.collect_list(F.struct("doc_id", item.alias("json"))).alias("items"))
    paths = sorted(r["path"] for r in files.mapInArrow(write, "path string").collect())  # a name an archive
    posts_ = readers.zip_members(spark, paths).where("kind = 'post'")
    found = readers.records_of(posts_.select(F.concat_ws("#", "file", "member").alias("file"), F.decode("content", "UTF-8").alias("text")), "js")
    archive = F.regexp_extract("file", r"-(\d+)\.zip#", 1).cast("long")
    rows = found.select(F.coalesce(normalize.at("record", "$.id_str"), normalize.at("record", "$.tweet.id_str")).cast("long").alias("doc_id"), F.md5(F.coalesce(normalize.at("record", "$.full_text"), normalize.at("record", "$.tweet.full_text"))).alias("text"), archive.alias("archive"))
    return rows


_PART_NAMES = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'data/tweets.js' WHEN 1 THEN 'data/tweets-part' || doc_id || '.js' WHEN 2 THEN 'posts_Part' || doc_id % 7 || '.JSON' ELSE 'part9/posts.json' END AS file FROM documents"


def _part_names(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", pick(4, "data/tweets.js", F.concat(F.lit("data/tweets-part"), k(), F.lit(".js")), F.concat(F.lit("posts_Part"), k() % 7, F.lit(".JSON")), "part9/posts.json").alias("file"))


@query(f"WITH n AS ({_PART_NAMES}), p AS (SELECT *, CASE doc_id % 4 WHEN 1 THEN doc_id WHEN 2 THEN doc_id % 7 ELSE 0 END::INT AS part FROM n) SELECT doc_id, part, count(*) OVER (ORDER BY part, file, doc_id ROWS UNBOUNDED PRECEDING) AS ord FROM p")
def part_order(spark, sf_dir):
    """One record in a file: the order of parts by number, then name; equal names by document."""
    rows = _part_names(spark, sf_dir).withColumn("part", readers.part_number(F.col("file")))
    named = rows.groupBy("file").agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).select("file", F.posexplode("ids").alias("row_no", "doc_id"))
    return readers.ordered(named).join(rows.select("doc_id", "part"), "doc_id").select("doc_id", "part", "ord")


@query(f"""WITH n AS ({_PART_NAMES}), g AS (SELECT doc_id // 100 AS grp, CASE doc_id % 4 WHEN 1 THEN doc_id WHEN 2 THEN doc_id % 7 ELSE 0 END AS part FROM n UNION ALL SELECT -1, doc_id FROM documents UNION ALL SELECT -2, doc_id + 1 FROM documents)
SELECT grp, min(part) <> 0 OR count(DISTINCT part) <> max(part) + 1 AS gap FROM g GROUP BY grp""")
def part_gaps(spark, sf_dir):
    """Whether the parts of a group are other than 0 to their largest."""
    whole = lambda grp, n: table(spark, sf_dir, "documents").select(F.lit(grp).cast("long").alias("grp"), F.concat(F.lit("tweets-part"), n, F.lit(".js")).alias("file"))
    named = _part_names(spark, sf_dir).select(F.floor(k() / 100).alias("grp"), "file").unionByName(whole(-1, k())).unionByName(whole(-2, k() + 1))
    return readers.part_gaps(named, "grp")


_PATHS = ["tweets.js", "data/tweets-part3.js", "data\\posts_part2.json", "x/tweets.js", "/data/tweets.js", "data/../posts.js", "c:tweets.js", "account/posts.json", "data/like.js", "my-DM-list/tweets.csv", "contacts/records.json", "a/Project.JSON", "提交表.md", "私信/posts.csv", "data/direct messages/posts.json", "Admin/posts.csv"]
_PATH_SQL = ", ".join(f"'{p}'" for p in _PATHS)


@query(rf"""WITH p AS (SELECT doc_id, [{_PATH_SQL}][(doc_id % {len(_PATHS)} + 1)::INT] AS path FROM documents), s AS (SELECT *, replace(path, '\', '/') AS q, regexp_extract(replace(path, '\', '/'), '[^/]*$') AS name FROM p),
c AS (SELECT *, NOT starts_with(q, '/') AND NOT regexp_matches(q, '(^|/)\.\.(/|$)') AND NOT regexp_matches(q, '^[A-Za-z]:') AS safe,
  regexp_matches(q, '(?i)direct[-_ ]?messages?|(^|/|-|_)dm(-|_|/|$)|contacts?|address[-_ ]?book|account|私信|通讯录') AS private FROM s)
SELECT doc_id, safe, private, NOT private AND regexp_full_match(name, '(?i)tweets?([-_]part\d+)?\.(js|json|csv)|(posts|records|project)\.json|posts\.csv|提交表\.md') AS public,
  safe AND (NOT contains(q, '/') OR regexp_matches(q, '(^|/)data/')) AND regexp_full_match(name, '(?i)(tweets?|posts?)([-_]part\d+)?\.(js|json)') AS archive FROM c""")
def path_rules(spark, sf_dir):
    path = F.get(F.array(*map(F.lit, _PATHS)), (k() % len(_PATHS)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", readers.safe_path(path).alias("safe"), readers.private_path(path).alias("private"), readers.public_path(path).alias("public"), readers.archive_path(path).alias("archive"))


@query("SELECT count(*) > 150 AS refused, sum(length(text)) > 1000000 AS too_much, count(*) AS posts, max(length(text)) AS longest, sum(length(text))::BIGINT AS total FROM documents")
def input_limits(spark, sf_dir):
    """Whether limits on posts and on all their texts refuse the input as a whole, next to what they are held against."""
    rows = records(spark, sf_dir, id=k().cast("string"), text=F.col("text"))
    texts = rows.select(F.coalesce(normalize.field("record", "text"), F.lit("")).alias("text"))
    found = texts.agg(F.count("*").alias("posts"), F.max(F.length("text")).cast("long").alias("longest"), F.sum(F.length("text")).alias("total"))
    refused = lambda limits: normalize.over_limit(limits, posts=F.col("posts"), longest=F.col("longest"), total=F.col("total"))
    return found.select(refused(readers.Limits(posts=150)).alias("refused"), refused(readers.Limits(total_chars=1_000_000)).alias("too_much"), "posts", "longest", "total")


# ---------------------------------------------------------------- fields


@query("""WITH p AS (SELECT doc_id, doc_id + 1 AS ord, text, doc_id % 11 = 5 AS anonymous, CASE WHEN doc_id % 2 = 0 THEN (10000000 + doc_id)::VARCHAR ELSE 'p' || doc_id END AS own FROM documents),
i AS (SELECT *, CASE WHEN anonymous THEN format('P{:04d}', ord) ELSE own END AS id, CASE WHEN lower(trim(coalesce(text, ''))) IN ('未知', '不确定', '不适用', '无', 'none', 'null', 'unknown', 'n/a') THEN '' ELSE trim(coalesce(text, '')) END AS body FROM p)
SELECT id, md5(body) AS text, CASE WHEN doc_id % 7 = 3 THEN 'https://e.org/' || doc_id WHEN NOT anonymous AND doc_id % 2 = 0 THEN 'https://x.com/i/status/' || own ELSE '' END AS url,
  ['original', 'repost', 'reply', 'quote', 'article', 'original', 'original'][(doc_id % 7 + 1)::INT] AS type, [2, 0, NULL, NULL, NULL][(doc_id % 5 + 1)::INT]::BIGINT AS thread_order, ['T1', '', '', ''][(doc_id % 4 + 1)::INT] AS thread_id,
  [true, false, true, false, NULL][(doc_id % 5 + 1)::INT] AS thread_complete, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN CASE WHEN body <> '' THEN true END END AS text_complete,
  ['手写', '', ''][(doc_id % 3 + 1)::INT] AS creation_method, ['', 'so', 'unknown thing'][(doc_id % 3 + 1)::INT] AS notes FROM i""")
def normalised_posts(spark, sf_dir):
    """Names, unknown words, yes and no, numbers, made ids and links, and whether a text is complete."""
    own = F.when(k() % 11 != 5, F.when(k() % 2 == 0, (10_000_000 + k()).cast("string")).otherwise(F.concat(F.lit("p"), k())))
    rows = records(
        spark, sf_dir, id_str=F.when(k() % 3 == 0, F.concat(F.lit(" "), own, F.lit(" "))), 帖子编号=F.when(k() % 3 == 1, own), tweet_id=F.when(k() % 3 == 2, own), full_text=F.when(k() % 2 == 0, F.col("text")), 正文=F.when(k() % 2 == 1, F.col("text")),
        link=F.when(k() % 7 == 3, F.concat(F.lit("https://e.org/"), k())), 类型=pick(7, "主帖", "Retweet", "回复", "引用", "长文", "?", "tweet"), 线程顺序=pick(5, "2", "0", "-1", "x"), 所属线程=pick(4, "T1", "未知", "N/A", ""),
        线程是否完整=pick(5, "是", "FALSE", "1", "不完整", "?"), text_complete=pick(4, "完整", "0", None, "maybe"), 创作方式=pick(3, " 手写 ", "unknown", "无"), 备注=pick(3, "NULL", "so ", "unknown thing"),
    )
    out = normalize.normalize(rows.select("ord", "record"))
    return out.select("id", F.md5("text").alias("text"), "url", "type", "thread_order", "thread_id", "thread_complete", "text_complete", "creation_method", "notes")


@query("""WITH s AS (SELECT doc_id, doc_id % 5 = 0 AS retweeted, doc_id % 3 = 0 AS answers, doc_id % 2 = 0 AS quotes, doc_id % 7 = 0 AS marked FROM documents)
SELECT doc_id, CASE WHEN doc_id % 13 = 4 THEN 'article' WHEN retweeted OR marked THEN 'repost' WHEN answers THEN 'reply' WHEN quotes THEN 'quote' ELSE 'original' END AS type,
  CASE WHEN retweeted OR marked THEN 'repost' WHEN answers THEN 'reply' WHEN quotes THEN 'quote' ELSE 'original' END AS archived FROM s""")
def type_signs(spark, sf_dir):
    """Types by label and by a record's own signs; an archive's by the signs alone."""
    rows = records(
        spark, sf_dir, type=pick(13, None, None, None, None, "长文", "?"), retweeted_status=F.when(k() % 5 == 0, F.struct(F.lit(1).alias("id"))), in_reply_to_status_id_str=F.when(k() % 3 == 0, "77").otherwise(""),
        is_quote_status=F.when(k() % 2 == 0, True).otherwise(False), full_text=F.when(k() % 7 == 0, "RT @a: b").otherwise("b RT @a"),
    )
    return rows.select("doc_id", normalize.post_type("record").alias("type"), normalize.archive_type("record", normalize.at("record", "$.full_text")).alias("archived"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a.jpg|b' || doc_id || '.png|c d.gif' WHEN 1 THEN 'x.mp4|y.jpg' WHEN 2 THEN 'o.jpg|p.gif|q' WHEN 3 THEN 'j' || doc_id || '.jpg|k.jpg' ELSE '' END AS names,
  CASE WHEN doc_id % 5 = 2 THEN sha256(doc_id::VARCHAR) || '||' ELSE repeat('|', [2, 1, 0, 1, 0][(doc_id % 5 + 1)::INT]::INT) END AS hashes,
  CASE doc_id % 5 WHEN 0 THEN 'unknown|unknown|unknown' WHEN 2 THEN 'image|animated_gif|unknown' WHEN 4 THEN '' ELSE 'unknown|unknown' END AS kinds, CASE WHEN doc_id % 5 = 2 THEN 'submitted||' ELSE repeat('|', [2, 1, 0, 1, 0][(doc_id % 5 + 1)::INT]::INT) END AS origins,
  CASE doc_id % 3 WHEN 0 THEN 'e1|e2' WHEN 1 THEN 'only ' || doc_id ELSE '' END AS evidence FROM documents""")
def list_fields(spark, sf_dir):
    """Lists as lists, as JSON in a string, as names in a string and as one value; media by name, hash and kind."""
    digest = F.upper(F.sha2(k().cast("string"), 256))
    item = lambda name, kind, **more: F.struct(F.lit(name).alias("name"), kind.alias("type"), *[v.alias(k) for k, v in more.items()])
    rows = records(
        spark, sf_dir, 媒体=F.when(k() % 5 == 0, F.concat(F.lit("a.jpg；b"), k(), F.lit(".png;无\n c d.gif ；有媒体"))), 媒体文件=F.when(k() % 5 == 1, F.array(F.lit("x.mp4"), F.lit("y.jpg"))),
        media=F.when(k() % 5 == 2, F.array(item("o.jpg", F.lit("photo"), sha256=digest), item("p.gif", F.lit("animated_gif"), sha256=F.lit("beef")), item("q", F.lit("thing"), sha256=F.lit(None).cast("string")))),
        图片文件=F.when(k() % 5 == 3, F.concat(F.lit(' ["j'), k(), F.lit('.jpg", "k.jpg"]'))), evidence=pick(3, '["e1","e2"]', F.concat(F.lit("only "), k()), ""),
    )
    m = rows.select("doc_id", normalize.media("record").alias("m"), normalize.strings("record", "evidence").alias("e"))
    part = lambda name: listed(F.transform("m", lambda x: x[name]))
    return m.select("doc_id", part("name").alias("names"), part("hash").alias("hashes"), part("kind").alias("kinds"), part("hash_origin").alias("origins"), listed(F.col("e")).alias("evidence"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'T' || doc_id || '|u' WHEN 1 THEN '' WHEN 2 THEN 'flat' ELSE '' END AS texts, CASE doc_id % 4 WHEN 0 THEN 'https://s/' || doc_id || '|' WHEN 1 THEN 'https://bare' WHEN 2 THEN '' ELSE '' END AS urls,
  CASE doc_id % 4 WHEN 0 THEN 'self|other' WHEN 1 THEN 'unknown' WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'mixed' ELSE 'unknown' END ELSE '' END AS owners FROM documents""")
def source_lists(spark, sf_dir):
    """Sources as objects, as bare links and as flat fields; owners by label."""
    one = lambda text, url, owner: F.struct(text.alias("source_text"), url.alias("link"), F.lit(owner).alias("ownership"))
    nothing = F.lit(None).cast("string")
    rows = records(
        spark, sf_dir, sources=F.when(k() % 4 == 0, F.to_json(F.array(one(F.concat(F.lit("T"), k()), F.concat(F.lit("https://s/"), k()), "本人制作"), one(F.lit("u"), nothing, "third_party")))).when(k() % 4 == 1, "https://bare"),
        来源原文=F.when(k() % 4 == 2, "flat").when(k() % 4 == 3, "未知"), 素材归属=F.when(k() % 3 == 0, "混合素材").otherwise("somebody"), source_url=F.when(k() % 4 == 3, "n/a"),
    )
    s = rows.select("doc_id", normalize.sources("record").alias("s"))
    part = lambda name: listed(F.transform("s", lambda x: x[name]))
    return s.select("doc_id", part("text").alias("texts"), part("url").alias("urls"), part("owner").alias("owners"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, substr(coalesce(text, ''), 1, 20) AS cut FROM documents)
SELECT doc_id, md5(CASE WHEN doc_id % 6 IN (0, 1, 2) THEN text ELSE cut END) AS text, CASE WHEN doc_id % 6 IN (0, 1, 2) THEN true WHEN doc_id % 6 IN (3, 4) THEN false WHEN cut <> '' THEN true END AS complete FROM t""")
def long_texts(spark, sf_dir):
    """The fullest text of an archive's record, and whether it is whole."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.struct(text.alias("text"))
    nested = F.struct(F.struct(F.struct(text.alias("text")).alias("result")).alias("noteTweetResults"))
    linked = F.struct(F.array(F.struct(F.lit("https://www.x.com/i/article/9").alias("expanded_url"))).alias("urls"))
    rows = records(
        spark, sf_dir, full_text=F.substring(text, 1, 20), note_tweet=F.when(k() % 6 == 0, own), noteTweet=F.when(k() % 6 == 1, nested), extended_tweet=F.when(k() % 6 == 2, F.struct(text.alias("full_text"))),
        truncated=F.when(k() % 6 == 3, True), entities=F.when(k() % 6 == 4, linked),
    )
    found, complete = normalize.long_text("record")
    return rows.select("doc_id", F.md5(found).alias("text"), complete.alias("complete"))


@query("""SELECT doc_id::VARCHAR AS id, CASE doc_id % 5 WHEN 0 THEN [doc_id || '-a b.jpg:image', doc_id || '-c.png:image'] WHEN 1 THEN [doc_id || '-lo.mp4+' || doc_id || '-hi.mp4:video'] WHEN 2 THEN [doc_id || '-t.jpg:image', doc_id || '-media-2:image', doc_id || '-media-3:unknown']
  WHEN 3 THEN [doc_id || '-still.jpg:animated_gif'] ELSE [] END AS names FROM documents""")
def archive_media(spark, sf_dir):
    """References by the names of their files: decoded, films before stills, repeats once, nameless ones numbered."""
    film = lambda url, kind: F.struct(F.lit(kind).alias("content_type"), F.lit(url).alias("url"))
    nothing = F.lit(None).cast("string")
    ref = lambda kind, still=nothing, films=None: F.struct(kind.alias("type"), still.alias("media_url_https"), F.struct((films if films is not None else F.lit(None).cast("array<struct<content_type:string,url:string>>")).alias("variants")).alias("video_info"))
    photo, t = F.lit("photo"), F.lit("https://p.org/m/t.jpg")
    films = F.array(film("https://v.org/a/l.m3u8", "application/x-mpegURL"), film("https://v.org/a/lo.mp4?tag=1", "video/mp4"), film("https://v.org/a/hi.mp4?x=1", "other"))
    media = (
        F.when(k() % 5 == 0, F.array(ref(photo, F.lit("https://p.org/m/a%20b.jpg?x=1")), ref(photo, F.lit("https://p.org/m/c.png"))))
        .when(k() % 5 == 1, F.array(ref(F.lit("video"), t, films)))
        .when(k() % 5 == 2, F.array(ref(photo, t), ref(photo, t), ref(photo, F.lit("https://p.org")), ref(nothing)))
        .when(k() % 5 == 3, F.array(ref(F.lit("animated_gif"), F.lit("https://p.org/x/still.jpg"))))
    )
    rows = records(spark, sf_dir, id_str=k().cast("string"), full_text=F.lit("x"), extended_entities=F.when(k() % 2 == 0, F.struct(media.alias("media"))), entities=F.struct(media.alias("media")))
    m = rows.select(k().cast("string").alias("id"), normalize.archive_media("record", k().cast("string")).alias("m"))
    return m.select("id", F.transform("m", lambda x: F.concat(F.array_join(x["names"], "+"), F.lit(":"), x["kind"])).alias("names"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a' || doc_id || '；b' WHEN 1 THEN 'some months' WHEN 2 THEN 'x；y' ELSE '' END AS missing FROM documents")
def known_missing(spark, sf_dir):
    """What a scope says is missing: a list, a text, a list in a string, nothing."""
    rows = records(spark, sf_dir, known_missing=F.when(k() % 4 == 0, F.to_json(F.array(F.concat(F.lit("a"), k()), F.lit("b")))).when(k() % 4 == 1, "some months").when(k() % 4 == 2, '["x","y"]'))
    return rows.select("doc_id", normalize.known_missing("record").alias("missing"))


# ---------------------------------------------------------------- joins


@query("""WITH m AS (SELECT doc_id, 'm' || CASE WHEN doc_id % 6 = 0 THEN 0 ELSE doc_id END || '.jpg' AS name FROM documents), n AS (SELECT name, count(*) AS c, min(doc_id) AS doc_id FROM m GROUP BY name)
SELECT m.doc_id::VARCHAR AS id, m.name, CASE WHEN n.c = 1 AND m.doc_id % 5 <> 0 THEN sha256(m.doc_id::VARCHAR) ELSE '' END AS hash FROM m JOIN n USING (name)""")
def media_links(spark, sf_dir):
    """Media get the hash of the one archive member that bears their name; members of equal names give none."""
    name = F.concat(F.lit("m"), F.when(k() % 6 == 0, 0).otherwise(k()), F.lit(".jpg"))
    d = table(spark, sf_dir, "documents")
    media = F.array(F.struct(F.concat(F.lit("x/"), name).alias("name"), F.lit("").alias("hash"), F.lit("image").alias("kind"), F.lit("").alias("hash_origin")))
    shown = d.select(k().cast("string").alias("id"), media.alias("media"))
    members = d.where(((k() % 5 != 0) | (k() % 6 == 0)) & ~((k() % 6 == 0) & (k() == 0))).select(F.concat(F.lit("media\\"), k(), F.lit("/"), name).alias("member"), F.sha2(k().cast("string"), 256).alias("sha256"))
    members = members.unionByName(d.where(k() == 0).select(F.lit("other/m0.jpg").alias("member"), F.sha2(F.lit("0"), 256).alias("sha256")))
    return readers.link_media(shown, members).select("id", F.regexp_replace(F.col("media")[0]["name"], "^x/", "").alias("name"), F.col("media")[0]["hash"].alias("hash"))


@query("""SELECT doc_id::VARCHAR AS id, doc_id || CASE doc_id % 4 WHEN 1 THEN '-hi.mp4' ELSE '-lo.mp4' END AS name, CASE doc_id % 4 WHEN 0 THEN md5(doc_id::VARCHAR) || md5(doc_id::VARCHAR) WHEN 1 THEN sha256(doc_id::VARCHAR) WHEN 2 THEN md5(doc_id::VARCHAR) || md5(doc_id::VARCHAR) ELSE '' END AS hash FROM documents""")
def alternate_media(spark, sf_dir):
    """The first of a reference's names that has a valid hash wins."""
    films = F.array(*[F.struct(F.lit("video/mp4").alias("content_type"), F.lit(f"https://v.org/{n}.mp4").alias("url")) for n in ("lo", "hi")])
    rows = records(spark, sf_dir, id_str=k().cast("string"), full_text=F.lit("x"), extended_entities=F.struct(F.array(F.struct(F.lit("video").alias("type"), F.struct(films.alias("variants")).alias("video_info"))).alias("media")))
    d = table(spark, sf_dir, "documents")
    lo = d.select(F.concat(k(), F.lit("-lo.mp4")).alias("name"), F.when(k() % 2 == 0, F.upper(F.repeat(F.md5(k().cast("string")), 2))).otherwise("none").alias("hash"))
    hi = d.where((k() % 4).isin(1, 2)).select(F.concat(k(), F.lit("-hi.mp4")).alias("name"), F.sha2(k().cast("string"), 256).alias("hash"))
    out = normalize.archive_posts(rows.select("ord", "record"), lo.unionByName(hi))
    return out.select("id", F.col("media")[0]["name"].alias("name"), F.col("media")[0]["hash"].alias("hash"))


@query("""SELECT CASE WHEN doc_id % 3 = 0 THEN 'own' || doc_id ELSE 'P' || doc_id END AS id, 'https://x.org/' || doc_id AS url, 'body of ' || doc_id AS text, 'reply' AS type, CASE WHEN doc_id % 5 = 0 THEN 't' || doc_id ELSE '' END AS thread_id, CASE WHEN doc_id % 5 = 0 THEN 2 END::BIGINT AS thread_order,
  CASE doc_id % 4 WHEN 3 THEN '' ELSE 'source ' || doc_id END AS sources, CASE doc_id % 4 WHEN 3 THEN '' ELSE 'new' END AS contribution FROM documents""")
def form_files(spark, sf_dir):
    """A form for each document: its post, and a source record that names the post by number, link or own id."""
    n = k().cast("string")
    own = F.when(k() % 3 == 0, F.concat(F.lit("- 帖子标识（如能取得）：own"), n, F.lit("\n"))).otherwise("")
    thread = F.when(k() % 5 == 0, F.concat(F.lit("- 所属线程及顺序：t"), n, F.lit("，第 2 条，共 3 条\n"))).otherwise("- 所属线程及顺序：不适用\n")
    post = F.concat(F.lit("#### P"), n, F.lit("\n"), own, F.lit("- 帖子链接：https://x.org/"), n, F.lit("\n- 类型：回复\n"), thread, F.lit("**帖子原文：**\nbody of "), n, F.lit("\n\n"))
    target = F.when(k() % 4 == 0, F.concat(F.lit("P"), n)).when(k() % 4 == 1, F.concat(F.lit("https://x.org/"), n)).when((k() % 4 == 2) & (k() % 3 == 0), F.concat(F.lit("own"), n)).when(k() % 4 == 2, F.concat(F.lit("P"), n)).otherwise("nobody")
    source = F.concat(F.lit("### 来源记录 S1\n- 对应帖子链接或编号："), target, F.lit("\n- 本人新增的分析、观点、报道或创作：new\n**来源原文（用于文字对比，可选）：**\nsource "), n, F.lit("\n"))
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), n, F.lit(".md")).alias("file"), F.concat(post, source).alias("text"))
    out = normalize.normalize(readers.ordered(readers.records_of(texts, "md")))
    return out.select("id", "url", "text", "type", "thread_id", "thread_order", listed(F.transform("sources", lambda s: s["text"])).alias("sources"), "contribution")


@query("""SELECT 'f' || doc_id || '.md' AS file, place::INT AS place, 'https://x.com/u' || doc_id || '/status/' || (doc_id * 10 + place) AS url FROM documents, range(3) r(place) WHERE place < doc_id % 4""")
def form_candidates(spark, sf_dir):
    """Up to three candidates a form, between links that are none and links of other parts."""
    n = k().cast("string")
    links = F.array_join(F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), 1, (k() % 4).cast("int")), lambda p: F.concat(F.lit("1. https://x.com/u"), n, F.lit("/status/"), (k() * 10 + p).cast("string"), F.lit(" and https://e.org/status/1"))), "\n")
    text = F.concat(F.lit("## 一、\nhttps://x.com/other/status/1\n## 二、申请候选\n"), links, F.lit("\n## 三、\nhttps://x.com/other/status/2\n"))
    return readers.form_candidates(table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), n, F.lit(".md")).alias("file"), text.alias("text")))


@query("""SELECT 'f' || doc_id || '.md' AS file, CASE WHEN doc_id % 5 = 0 THEN 'blank_form' ELSE 'source_unmatched' END AS fault, CASE WHEN doc_id % 5 <> 0 THEN 'https://x.org/none' || doc_id END AS target FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 1""")
def form_faults(spark, sf_dir):
    """Forms without a post that is filled in, and source records that name no post."""
    n = k().cast("string")
    body = F.when(k() % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("- 帖子链接：https://x.org/"), n, F.lit("\n")))
    target = F.concat(F.when(k() % 3 == 1, F.lit("https://x.org/none")).otherwise("https://x.org/"), n)
    text = F.concat(F.lit("#### P1\n"), body, F.lit("### 来源记录 S1\n- 对应帖子链接或编号："), target, F.lit("\n"))
    return readers.form_faults(table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), n, F.lit(".md")).alias("file"), text.alias("text")))


@query("""WITH p AS (SELECT doc_id, doc_id::VARCHAR AS id, length(text) AS chars FROM documents WHERE doc_id % 3 <> 2)
SELECT id, CASE WHEN doc_id % 4 = 0 THEN 'matched' WHEN doc_id % 6 < 3 THEN 'failed' ELSE 'waiting' END AS status, CASE WHEN doc_id % 4 <> 0 AND doc_id % 6 < 3 THEN 'batch_response_unknown,cancelled' ELSE '' END AS issues, chars AS original_chars FROM p""")
def abandoned_batches(spark, sf_dir):
    """Planned posts: those with a result, those of a batch that was given up, and those still to send."""
    planned = table(spark, sf_dir, "documents").where(k() % 3 != 2).select(k().cast("string").alias("id"), F.length("text").cast("long").alias("original_chars"), F.lit(False).alias("text_truncated"))
    number = F.col("id").cast("long")
    done = planned.where(number % 4 == 0).select("id", F.lit("matched").alias("status"), "original_chars")
    lost = budgets.abandoned(done, planned, table(spark, sf_dir, "documents").where(k() % 6 < 3).select(k().cast("string").alias("id")), "cancelled")
    every = done.withColumn("issues", F.lit("")).unionByName(lost.select("id", "status", "original_chars", F.array_join("issues", ",").alias("issues")))
    left = budgets.remaining(planned, every)
    return every.unionByName(left.select("id", F.lit("waiting").alias("status"), "original_chars", F.lit("").alias("issues")))


# ---------------------------------------------------------------- findings that need media, sources, threads and evidence


def rich_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of a fixed text, with media, sources, threads and evidence by their numbers."""
    body = F.concat(F.lit("the words of post "), k(), F.lit(" which stand alone here"))
    image = lambda digest: F.struct(F.lit("a").alias("name"), digest.alias("hash"), F.lit("image").alias("kind"), F.lit("").alias("hash_origin"))
    media = F.when(k() % 4 == 0, F.array(image(F.sha2((k() % 100).cast("string"), 256)))).when(k() % 4 == 1, F.array(image(F.lit("")), image(F.lit("")))).otherwise(F.array().cast(normalize.MEDIA_TYPE))
    source = lambda text, url, owner: F.array(F.struct(text.alias("text"), F.lit(url).alias("url"), F.lit(owner).alias("owner"), F.lit("").alias("notes")))
    far = F.lit("quite other letters: 0123456789 0123456789 zzzz yyyy xxxx")
    sources = (
        F.when(k() % 9 == 0, source(F.lit(""), "u", "other")).when(k() % 9 == 1, source(F.lit(""), "", "other")).when(k() % 9 == 2, source(F.lit("short"), "", "other")).when(k() % 9 == 3, source(body, "", "self")).when(k() % 9 == 4, source(body, "", "other"))
        .when(k() % 9 == 5, source(far, "", "other")).when(k() % 9 == 6, source(far, "", "self")).when(k() % 9 == 7, source(F.concat(body, F.lit(" 98765432109876543210")), "", "other")).otherwise(F.array().cast(normalize.SOURCE_TYPE))
    )
    rows = table(spark, sf_dir, "documents").select(
        k().cast("string").alias("id"), k().alias("ord"), F.when(k() % 31 == 0, "").otherwise(body).alias("text"), F.lit("original").alias("type"), F.lit(True).alias("text_complete"), media.alias("media"), sources.alias("sources"),
        F.when(k() % 2 == 0, "an account of what is new in this post, at some length").otherwise("").alias("contribution"),
        F.when(k() % 10 < 3, F.concat(F.lit("t"), F.floor(k() / 10))).otherwise("").alias("thread_id"), F.when(k() % 10 < 3, k() % 10 + 1).alias("thread_order"), F.when(k() % 10 < 3, F.when(F.floor(k() / 10) % 2 == 0, 3).otherwise(4)).cast("long").alias("thread_total"),
        F.when(k() % 6 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("evidence"), F.when(k() % 8 == 0, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")).alias("missing_media"),
    )
    return posts.with_clean(posts.complete_schema(rows))


_RICH = """rich AS (SELECT doc_id AS k, 'thewordsofpost' || doc_id || 'whichstandalonehere' AS body, doc_id % 31 = 0 AS empty, doc_id % 2 = 0 AS told FROM documents),
g AS (SELECT DISTINCT k, substr(body, i, 4) AS g FROM (SELECT k, body, unnest(generate_series(1, length(body) - 3)) AS i FROM rich)), sg AS (SELECT DISTINCT k, substr(s, i, 4) AS g FROM (SELECT k, body || '98765432109876543210' AS s, unnest(generate_series(1, length(body) + 17)) AS i FROM rich)),
ov AS (SELECT g.k, count(sg.g) / count(*) AS o FROM g LEFT JOIN sg ON g.k = sg.k AND g.g = sg.g GROUP BY g.k), m AS (SELECT k % 100 AS h, count(*) AS n FROM rich WHERE k % 4 = 0 GROUP BY 1),
th AS (SELECT k // 10 AS t, count(*) AS n, CASE WHEN (k // 10) % 2 = 0 THEN 3 ELSE 4 END AS total FROM rich WHERE k % 10 < 3 GROUP BY k // 10),
c AS (SELECT k, 'missing_text' AS code FROM rich WHERE empty UNION ALL SELECT k, 'media_missing' FROM rich WHERE k % 8 = 0 UNION ALL SELECT k, 'media_reference_only' FROM rich WHERE k % 4 = 1
  UNION ALL SELECT k, 'media_content_unchecked' FROM rich WHERE k % 4 = 0 UNION ALL SELECT k, 'media_same_hash' FROM rich JOIN m ON k % 4 = 0 AND k % 100 = h AND n > 1 UNION ALL SELECT k, 'evidence_reference' FROM rich WHERE k % 6 = 0
  UNION ALL SELECT k, 'thread_incomplete' FROM rich JOIN th ON k % 10 < 3 AND k // 10 = t WHERE n < total
  UNION ALL SELECT k, CASE k % 9 WHEN 0 THEN 'source_link_unchecked' ELSE 'source_missing' END FROM rich WHERE k % 9 IN (0, 1) UNION ALL SELECT k, 'source_short' FROM rich WHERE k % 9 = 2 OR (empty AND k % 9 BETWEEN 3 AND 7)
  UNION ALL SELECT k, CASE WHEN k % 9 = 3 THEN 'self_crosspost_claim' WHEN told THEN 'source_overlap_with_contribution' ELSE 'source_overlap_no_contribution' END FROM rich JOIN ov USING (k) WHERE NOT empty AND k % 9 IN (3, 4, 7) AND (k % 9 < 7 OR o >= 0.88)
  UNION ALL SELECT k, 'source_no_high_overlap' FROM rich WHERE NOT empty AND k % 9 IN (5, 6) UNION ALL SELECT k, 'source_contribution_unexplained' FROM rich WHERE NOT empty AND k % 9 = 5 AND NOT told)"""


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), 'https?://\S+', '', 'g'), '[^\p{L}\p{N}]+', '', 'g') AS c,
  regexp_replace(regexp_replace(replace(lower(substr(coalesce(text, ''), 1, length(text) * (doc_id % 5 + 1) // 5)), 'ß', 'ss'), 'https?://\S+', '', 'g'), '[^\p{L}\p{N}]+', '', 'g') AS s FROM documents),
g AS (SELECT DISTINCT doc_id, side, hash(substr(x, i, 4)) AS g FROM (SELECT doc_id, side, x, unnest(generate_series(1, length(x) - 3)) AS i FROM (SELECT doc_id, 0 AS side, c AS x FROM t UNION ALL SELECT doc_id, 1, s FROM t))),
o AS (SELECT doc_id, count(*) FILTER (n = 2) / nullif(count(*) FILTER (mine), 0) AS share FROM (SELECT doc_id, g, count(*) AS n, bool_or(side = 0) AS mine FROM g GROUP BY ALL) GROUP BY doc_id),
v AS (SELECT doc_id, CASE WHEN s = '' THEN 'source_missing' WHEN least(length(c), length(s)) < 24 THEN 'source_short' WHEN c = s OR share >= 0.88 THEN 'source_overlap_no_contribution' WHEN share >= 0.5 THEN 'source_partial_overlap' ELSE 'source_no_high_overlap' END AS code FROM t LEFT JOIN o USING (doc_id))
SELECT doc_id::VARCHAR AS id, code, CASE code WHEN 'source_missing' THEN 'review' WHEN 'source_overlap_no_contribution' THEN 'high_risk' WHEN 'source_partial_overlap' THEN 'review' END AS level FROM v
UNION ALL SELECT doc_id::VARCHAR, 'source_contribution_unexplained', 'review' FROM v WHERE code = 'source_no_high_overlap'""")
def source_overlaps(spark, sf_dir):
    """Each document with its own first fifths as the text of its source."""
    d = table(spark, sf_dir, "documents")
    part = F.expr("substring(coalesce(text, ''), 1, cast(length(text) * (doc_id % 5 + 1) div 5 as int))")
    source = F.array(F.struct(part.alias("text"), F.lit("").alias("url"), F.lit("other").alias("owner"), F.lit("").alias("notes")))
    rows = d.select(k().cast("string").alias("id"), k().alias("ord"), "text", source.alias("sources"), F.lit("").alias("contribution"))
    return findings.source_codes(posts.with_clean(posts.complete_schema(rows))).select("id", "code", "level")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 3, 4) THEN (doc_id % 101)::DOUBLE END AS score, CASE WHEN doc_id % 7 IN (0, 3, 4) THEN CASE WHEN doc_id % 101 < 40 THEN 'concern' WHEN doc_id % 101 < 70 THEN 'mixed' ELSE 'supported' END ELSE 'unknown' END AS verdict FROM documents""")
def score_validity(spark, sf_dir):
    """Scores in range, and missing ones, NaN, infinities and numbers out of range, which stay unknown."""
    score = (k() % 101).cast("double")
    odd = {1: F.lit(None).cast("double"), 2: F.lit(float("nan")), 5: -score - 1, 6: F.when(k() % 2 == 0, F.lit(float("inf"))).otherwise(score + 101)}
    given = F.when(F.lit(False), score)
    for at, value in odd.items():
        given = given.when(k() % 7 == at, value)
    valid = text.valid_score(given.otherwise(score), 100)
    return table(spark, sf_dir, "documents").select("doc_id", valid.alias("score"), text.verdict(valid).alias("verdict"))


@query(f"WITH {_RICH} SELECT code, count(DISTINCT k) AS posts FROM c GROUP BY code UNION ALL SELECT 'no_supplied_text_match', count(*) FROM rich WHERE k NOT IN (SELECT k FROM c) HAVING count(*) > 0")
def evidence_codes(spark, sf_dir):
    return findings.code_counts(findings.findings(rich_posts(spark, sf_dir)))


@query("SELECT count(*) AS analyzed, count(*) FILTER (doc_id % 4 = 0) + 2 * count(*) FILTER (doc_id % 4 = 1) AS media_references, count(*) FILTER (doc_id % 4 = 0) AS hashed_media, count(*) FILTER (doc_id % 4 = 0) / (count(*) FILTER (doc_id % 4 = 0) + 2 * count(*) FILTER (doc_id % 4 = 1)) AS media_coverage FROM documents")
def media_coverage(spark, sf_dir):
    return findings.coverage(rich_posts(spark, sf_dir), None).select("analyzed", "media_references", "hashed_media", "media_coverage")


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN doc_id - 3 ELSE doc_id END AS id, CASE WHEN doc_id % 10 = 5 THEN doc_id - 1 ELSE doc_id END AS url FROM documents)
SELECT doc_id, count(*) OVER (PARTITION BY id) > 1 OR (doc_id % 10 <> 7 AND count(*) OVER (PARTITION BY CASE WHEN doc_id % 10 <> 7 THEN url END) > 1) AS ambiguous FROM p""")
def ambiguous_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k() % 10 == 3, k() - 3).otherwise(k()).cast("string").alias("id"), F.when(k() % 10 == 7, "").when(k() % 10 == 5, (k() - 1).cast("string")).otherwise(k().cast("string")).alias("url"))
    return posts.ambiguous(rows).select("doc_id", "ambiguous")


@query("WITH $POSTS, $FINDINGS, $STATUS SELECT count(*) AS posts, count(*) FILTER (status <> 'low_signal') AS to_act_on, CASE WHEN count(*) = 0 THEN 'no_material' WHEN count(*) FILTER (status <> 'low_signal') > 0 THEN 'needs_handling' ELSE 'no_clear_risk' END AS conclusion FROM stat")
def account_conclusion(spark, sf_dir):
    return findings.account_conclusion(fixture_status(spark, sf_dir))


@query("""SELECT doc_id, [n FOR n IN [CASE WHEN doc_id % 3 > 0 THEN 'invalid_dates:' || doc_id % 3 END, CASE WHEN doc_id % 5 > 3 THEN 'outside_range:' || (doc_id % 5 - 3) END, CASE WHEN doc_id > 500 THEN 'more_than_declared' END, CASE WHEN doc_id % 2 = 0 THEN 'not_declared_complete' END, CASE WHEN doc_id % 7 = 0 THEN 'known_missing:may' END] IF n IS NOT NULL] AS notes FROM documents""")
def coverage_notes(spark, sf_dir):
    notes = findings.coverage_notes(k(), k() % 3, F.greatest(k() % 5 - 3, F.lit(0)), F.lit(500), F.when(k() % 2 == 1, True), F.when(k() % 7 == 0, "may"))
    return table(spark, sf_dir, "documents").select("doc_id", notes.alias("notes"))


@query("""SELECT doc_id, '@a' || doc_id AS account, CASE WHEN doc_id % 2 = 0 THEN 'UTC' ELSE '' END AS timezone, '是' AS complete, doc_id::VARCHAR AS total_expected, CASE doc_id % 3 WHEN 0 THEN 'May；June' WHEN 1 THEN 'June' ELSE '' END AS known_missing,
  CASE WHEN doc_id % 4 > 0 THEN '2026-01-02' ELSE '' END AS "start", CASE WHEN doc_id % 4 > 0 THEN '2026-03-04' ELSE '' END AS "end" FROM documents""")
def form_scopes(spark, sf_dir):
    n = k().cast("string")
    line = lambda label, value: F.concat(F.lit(f"- {label}："), value, F.lit("\n"))
    missing = F.concat(line("已知缺失", F.when(k() % 3 == 0, "May").otherwise("无")), line("缺失详情", F.when(k() % 3 < 2, "June").otherwise("未知")))
    head = F.concat(F.lit("# form\n## 一、\n"), line("账号", F.concat(F.lit("@a"), n)), F.when(k() % 2 == 0, line("时区", F.lit("UTC"))).otherwise(""), line("是否包含该期间全部本人发帖", F.lit("是")), line("已知该期间帖子总数", n), missing, line("时间范围（含首尾）", F.when(k() % 4 > 0, "2026-01-02 to 2026-03-04").otherwise("2026-01-02")))
    texts = table(spark, sf_dir, "documents").select(n.alias("file"), F.concat(head, F.lit("## 二、\n- 账号：@wrong\n")).alias("text"))
    return readers.form_scopes(texts).select(F.col("file").cast("long").alias("doc_id"), "account", "timezone", "complete", "total_expected", "known_missing", "start", "end")


@query("""WITH f AS (SELECT 'id_too_long' AS fault, doc_id % 7 = 0 AS hit FROM documents UNION ALL SELECT 'id_missing', doc_id % 11 = 3 AND doc_id % 7 <> 0 FROM documents UNION ALL SELECT 'text_missing', text IS NULL FROM documents
UNION ALL SELECT 'text_too_long', length(text) > 50000 FROM documents UNION ALL SELECT 'url_too_long', doc_id % 5 = 0 FROM documents)
SELECT fault, count(*) AS rows FROM f WHERE hit GROUP BY fault UNION ALL SELECT 'id_repeats', 1 FROM documents WHERE doc_id % 11 = 3 AND doc_id % 7 <> 0 HAVING count(*) > 1 UNION ALL SELECT 'posts_out_of_range', 1 FROM documents HAVING count(*) NOT BETWEEN 1 AND 10""")
def request_faults(spark, sf_dir):
    own = F.when(k() % 7 == 0, F.concat(F.repeat(F.lit("x"), F.lit(200)), k())).when(k() % 11 == 3, "").otherwise(k().cast("string"))
    rows = table(spark, sf_dir, "documents").select(own.alias("id"), "text", F.when(k() % 5 == 0, F.repeat(F.lit("u"), F.lit(2049))).otherwise("u").alias("url"))
    return web.request_faults(rows)


@query("SELECT item_id::VARCHAR AS id, row_number() OVER (ORDER BY item_id) AS place FROM benchmark ORDER BY item_id LIMIT 10")
def locked_selection(spark, sf_dir):
    """The same ten asked for again: once free, then locked."""
    ten = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(10)
    chosen = ten.select(F.col("item_id").cast("string").alias("id"), F.row_number().over(Window.orderBy("item_id")).cast("long").alias("place"))
    return posts.locked_selection(chosen, posts.locked_selection(chosen, chosen.limit(0)))

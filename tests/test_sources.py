"""Readers and normalisation, archives, pages, streams and the entry module."""

import csv
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from inkwarden.operators import posts, report, web
from inkwarden.sources import normalize, readers
from inkwarden.streaming import budgets


def records(spark, rows):
    return spark.createDataFrame([(i + 1, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows)], "ord long, j string").select("ord", F.parse_json("j").alias("record"))


def one(spark, row):
    return normalize.normalize(records(spark, [row])).first()


def test_aliases_and_unknown_values(spark):
    r = one(spark, {"帖子编号": " 12345678 ", "正文": "未知", "类型": "引用帖", "线程顺序": "2", "thread_total": -1, "线程是否完整": "是", "媒体": "a.jpg；b.png;无", "来源链接": "u", "素材归属": "本人", "证据": '["x"]'})
    assert (r["id"], r["text"], r["type"], r["thread_order"], r["thread_total"], r["thread_complete"]) == ("12345678", "", "quote", 2, None, True)
    assert r["url"].endswith("/status/12345678") and [m["name"] for m in r["media"]] == ["a.jpg", "b.png"] and r["evidence"] == ["x"]
    assert [s.asDict() for s in r["sources"]] == [{"text": "", "url": "u", "owner": "self", "notes": ""}]
    assert r["text_complete"] is None and one(spark, {"text": "t"})["text_complete"] is True and one(spark, {"text": "t", "text_complete": "不完整"})["text_complete"] is False
    assert one(spark, {"text": "t"})["id"] == "P0001"


@pytest.mark.parametrize(("row", "kind"), [({"text": "RT @a b"}, "repost"), ({"in_reply_to_status_id": 5}, "reply"), ({"is_quote_status": True}, "quote"), ({"is_quote_status": False, "type": "?"}, "original"), ({"post_type": "Retweet"}, "repost")])
def test_types(spark, row, kind):
    assert one(spark, row)["type"] == kind


def test_media_hashes(spark):
    r = one(spark, {"media": [{"name": "a", "sha256": "AB" * 32, "type": "photo"}, {"filename": "b", "hash": "zz"}]})
    assert [(m["name"], m["hash"], m["kind"], m["hash_origin"]) for m in r["media"]] == [("a", "ab" * 32, "image", "submitted"), ("b", "", "unknown", "")]


def test_json_round_trip(spark):
    first = normalize.normalize(records(spark, [{"id": "1", "text": "t", "sources": [{"text": "s", "owner": "other"}], "media": ["m.jpg"], "evidence": ["e"], "thread_order": 3}, {"id": "2", "text": "u", "type": "reply"}]))
    again = normalize.normalize(report.project_json(first).select("ord", F.parse_json("json").alias("record")))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_limits_fail_as_a_whole(spark):
    with pytest.raises(Exception, match="over the limit"):
        normalize.normalize(records(spark, [{"text": "x" * 11}]), readers.Limits(text_chars=10)).collect()
    with pytest.raises(Exception, match="more posts"):
        normalize.normalize(records(spark, [{"text": "a"}, {"text": "b"}]), readers.Limits(posts=1)).collect()
    with pytest.raises(Exception, match="together"):
        normalize.normalize(records(spark, [{"text": "abc"}, {"text": "bcd"}]), readers.Limits(total_chars=5)).collect()
    assert normalize.normalize(records(spark, [{"text": "abc"}, {"text": "bcd"}]), readers.Limits(total_chars=6)).count() == 2


def test_files(spark, tmp_path):
    cases = {
        "a.json": '﻿{"posts": [{"tweet": {"id": "1", "text": "a"}}, {"id": "2", "text": "b"}]}'.encode(),
        "tweets-part1.js": "window.YTD.tweets.part1 = [{\"tweet\": {\"id_str\": \"3\", \"full_text\": \"c\"}}] ;\n".encode("utf-16"),
        "c.csv": '﻿编号,正文\r\n4,"d\ne"\r\n'.encode(),
        "d.tsv": b"id\ttext\n5\tf, g\n",
    }
    want = {"a.json": {"1": "a", "2": "b"}, "tweets-part1.js": {"3": "c"}, "c.csv": {"4": "d\ne"}, "d.tsv": {"5": "f, g"}}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
        got = normalize.normalize(readers.read_records(spark, str(tmp_path / name))).collect()
        assert {r["id"]: r["text"] for r in got} == want[name], name
    for name, data in {"x.csv": b"id,text\n1,a,b\n", "y.csv": b"foo,bar\n1,2\n", "z.js": b"alert(1)", "w.json": b'{"a": 1}'}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception):
            readers.read_records(spark, str(tmp_path / name)).collect()
    with pytest.raises(ValueError):
        readers.read_records(spark, "a.exe")


FORM = """#### P001
- 帖子链接：https://x.com/a/status/1
- 类型：主帖
- 所属线程及顺序：T1，第 2 条，共 3 条
- 图片文件：a.jpg；b.jpg
**帖子原文：**
第一段
第二段

**本人补充说明（可选）：**
说明

#### P002
**帖子原文：**
在这里粘贴完整原文

### 来源记录 S001
- 对应帖子链接或编号：P001
- 来源链接或出处：https://s
- 素材归属：他人
- 本人新增的分析、观点、报道或创作：新观点
- 创作方式：手写
**来源原文（用于文字对比，可选）：**
来源文字
"""


def test_form(spark, tmp_path):
    (tmp_path / "提交表.md").write_text(FORM)
    (r,) = normalize.normalize(readers.read_records(spark, str(tmp_path / "提交表.md"))).collect()
    assert (r["id"], r["text"], r["thread_id"], r["thread_order"], r["thread_total"], r["notes"]) == ("P001", "第一段\n第二段", "T1", 2, 3, "说明")
    assert r["sources"][0].asDict() == {"text": "来源文字", "url": "https://s", "owner": "other", "notes": ""} and r["contribution"] == "新观点" and r["creation_method"] == "手写"
    assert [m["name"] for m in r["media"]] == ["a.jpg", "b.jpg"]


def test_zip(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data/tweets.js", 'window.YTD.tweets.part0 = [{"tweet": {"id_str": "1", "full_text": "a"}}]')
        z.writestr("data/tweets-part1.js", 'window.YTD.tweets.part1 = [{"tweet": {"id_str": "2", "full_text": "b"}}]')
        z.writestr("data/direct-messages.js", "secret")
        z.writestr("media/p.jpg", b"picture")
        z.writestr("x/q.jpg", b"1")
        z.writestr("y/q.jpg", b"2")
    got = normalize.normalize(readers.read_records(spark, str(path)))
    assert [(r["id"], r["ord"]) for r in got.orderBy("ord").collect()] == [("1", 1), ("2", 2)]
    members = readers.zip_members(spark, [str(path)])
    assert "data/direct-messages.js" not in {r["member"] for r in members.select("member").collect()}
    with_media = got.withColumn("media", F.from_json(F.lit('[{"name":"p.jpg","hash":"","kind":"image","hash_origin":""},{"name":"q.jpg","hash":"","kind":"image","hash_origin":""}]'), normalize.MEDIA_TYPE))
    media = readers.link_media(with_media, members).first()["media"]
    assert [m["hash"] for m in media] == [hashlib.sha256(b"picture").hexdigest(), ""]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../tweets.js", "x")
    with pytest.raises(Exception, match="unsafe"):
        readers.zip_members(spark, [str(tmp_path / "b.zip")]).collect()


def test_paths(spark):
    names = ["data/tweets.js", "tweets.js", "x/tweets.js", "/data/tweets.js", "data/../tweets.js", "c:tweets.js", "data/posts_part2.json", "data\\tweets-part3.js", "account/posts.json", "data/like.js"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select(readers.archive_path(F.col("p")).alias("a"), readers.public_path(F.col("p")).alias("b"), readers.part_number(F.col("p")).alias("n")).collect()
    assert [r["a"] for r in rows] == [True, True, False, False, False, False, True, True, False, False]
    assert rows[8]["b"] is False and rows[1]["b"] is True and [r["n"] for r in rows[6:8]] == [2, 3]
    gap = lambda *f: readers.part_gap(spark.createDataFrame([(x,) for x in f], "file string")).first()["gap"]
    assert not gap("tweets.js", "tweets-part1.js") and gap("tweets.js", "tweets-part2.js") and gap("tweets-part1.js")


def test_archives(spark):
    rows = [
        {"id_str": "1", "full_text": "short", "note_tweet": {"note_tweet_results": {"result": {"text": "the whole text"}}}},
        {"id_str": "2", "full_text": "cut", "truncated": True, "in_reply_to_status_id_str": "1"},
        {"id_str": "3", "full_text": "see", "entities": {"urls": [{"expanded_url": "https://x.com/i/article/9"}]}, "is_quote_status": True},
        {"id_str": "4", "full_text": "RT @a: b"},
        {"id_str": "5", "full_text": "film", "extended_entities": {"media": [{"type": "video", "media_url_https": "https://p/i/t.jpg", "video_info": {"variants": [{"content_type": "application/x-mpegURL", "url": "https://v/l.m3u8"}, {"content_type": "video/mp4", "url": "https://v/a/lo.mp4?tag=1"}, {"content_type": "video/mp4", "url": "https://v/a/hi.mp4"}]}}, {"type": "photo", "media_url_https": "https://p/i/t.jpg"}, {"type": "photo", "media_url_https": "https://p/i/t.jpg"}]}},
        {"id_str": "5", "full_text": "film"},
    ]
    hashes = spark.createDataFrame([("5-hi.mp4", "CD" * 32), ("5-t.jpg", "bad")], "name string, hash string")
    got = {r["id"]: r for r in normalize.archive_posts(records(spark, rows), hashes).collect()}
    assert set(got) == {"1", "2", "3", "4", "5"}
    assert (got["1"]["text"], got["1"]["text_complete"], got["2"]["text_complete"], got["3"]["text_complete"], got["4"]["text_complete"]) == ("the whole text", True, False, False, True)
    assert [got[i]["type"] for i in "1234"] == ["original", "reply", "quote", "repost"]
    assert [(m["name"], m["hash"][:2], m["kind"]) for m in got["5"]["media"]] == [("5-hi.mp4", "cd", "video"), ("5-t.jpg", "", "image")]
    with pytest.raises(Exception, match="no id"):
        normalize.archive_posts(records(spark, [{"full_text": "x"}])).collect()


# ---------------------------------------------------------------- web

PAGE = """<html><head><title> The <b>title </title><script type="application/ld+json">{"@graph": [{"x": 1}, {"datePublished": "2026-01-02T00:00:00Z"}]}</script></head>
<body><nav>menu</nav><article><h1>Head</h1><p>Body  text &amp; more</p><p>second</p></article><footer>foot</footer></body></html>"""


def test_page_text():
    text, title, date, cut = web.parse_page(PAGE)
    assert text.split() == ["Head", "Body", "text", "&", "more", "second"] and title == "The title" and date == "2026-01-02T00:00:00Z" and not cut
    assert web.parse_page('<meta property="article:published_time" content="D">x')[2] == "D" and web.parse_page(None) == ("", "", None, False)
    assert len(web.parse_page("<p>" + "x" * 200_000)[0]) == web.PAGE_CHARS and web.parse_page("<p>" + "x" * 200_000)[3]
    deep = {"datePublished": "z"}
    for _ in range(9):
        deep = {"a": deep}
    assert web.stated_date(deep) is None and web.stated_date(deep["a"]) == "z"


@pytest.mark.parametrize(("url", "ok"), [("https://example.com/a", True), ("http://example.com:80/", True), ("http://example.com:8080/", False), ("https://u:p@example.com/", False), ("ftp://example.com/", False), ("http://127.0.0.1/", False), ("http://10.1.2.3/", False), ("http://[::1]/", False), ("http://8.8.8.8/", True), ("http://localhost/", False), ("http://a.internal/", False), ("http://0x7f.1/", False), ("http://münchen.de/", True), ("http://x/", False), (None, False), ("http://[", False)])
def test_public_urls(url, ok):
    assert web.public_url_value(url) is ok


def test_strict_json(spark):
    assert [web.strict_json_value(t) for t in ('{"a": 1}', '{"a": 1, "a": 2}', "NaN", "[1,", None)] == [True, False, False, False, False]


def test_web_check(spark):
    text = "A sentence of the post that is long enough to be found on a page, word for word."
    docs = spark.createDataFrame([("1", "", text, True), ("2", "", "short", True), ("3", "", "Nothing of this stands on any page, whichever one may look at here.", True), ("4", "https://x.com/a/status/4", text + " fourth", True)], "id string, url string, text string, text_complete boolean")
    pages = spark.createDataFrame([(1, "https://a.org/1", f"<p>intro</p><p>{text}</p>"), (2, "https://x.com/b/status/4", f"<p>{text} fourth</p>")], "page_id long, url string, html string")
    got = {r["id"]: r for r in web.checked(docs, pages).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"1": "matched", "2": "skipped", "3": "no_match", "4": "matched"}
    assert got["1"]["max_similarity"] == 1.0 and got["4"]["match_urls"] == ["https://a.org/1"] and got["1"]["matched"] == 2
    cover = web.batch_coverage(web.checked(docs, pages)).first()
    assert (cover["posts"], cover["searched"], cover["matched"], cover["complete"]) == (4, 3, 2, False)
    gate = web.review_gate(docs, spark.createDataFrame([("1", i, "u", "t" * 7000) for i in range(5)], "id string, ord int, url string, text string"))
    rows = {r["id"]: r["sources"] for r in gate.collect()}
    assert set(rows) == {"1", "3", "4"} and len(rows["1"]) == 3 and len(rows["1"][0]["text"]) == 6000
    quoted = web.authenticated(spark.createDataFrame([("1", "u", "word for"), ("1", "v", "word for"), ("1", "u", "")], "id string, url string, excerpt string"), spark.createDataFrame([("u", text)], "url string, text string"))
    assert sorted(r["authentic"] for r in quoted.collect()) == [False, False, True]


# ---------------------------------------------------------------- streams


def test_greedy_budget_refuses_whole_requests(spark):
    rows = [("a", 1, 0.0, 3), ("a", 2, 10.0, 2), ("a", 3, 20.0, 1), ("a", 4, 3600.0, 3), ("a", 5, 3610.0, 1), ("b", 6, 5.0, 5), ("b", 7, 6.0, 4)]
    requests = spark.createDataFrame(rows, "owner string, request long, at double, n long")
    assert {r["request"]: r["granted"] for r in budgets.greedy(requests, 4).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: True}


def test_budget_stream_carries_state(spark, tmp_path):
    schema = "owner string, request long, at double, n long"
    for i, rows in enumerate([[("a", 1, 0.0, 3)], [("a", 2, 10.0, 2), ("a", 3, 20.0, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = budgets.greedy_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 4)
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination(120)
    assert {r["request"]: r["granted"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: True, 2: False, 3: True}


def test_upserts_by_batch(spark, tmp_path):
    schema = "id string, status string, ord long"
    apply = budgets.upserting(f"{tmp_path}/t")
    apply(spark.createDataFrame([("1", "matched", 1), ("2", "partial", 2)], schema), 0)
    apply(spark.createDataFrame([("1", "abandoned", 3), ("2", "no_match", 4), ("3", "abandoned", 5)], schema), 1)
    apply(spark.createDataFrame([("2", "failed", 9)], schema), 1)  # the same batch again
    assert {r["id"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/t/v1").collect()} == {"1": "matched", "2": "no_match", "3": "abandoned"}


def test_entry_without_the_training_data_operators():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys, importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n in ('inkwarden.llm', 'corpus_pipeline') else f(n, *a); import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n[:2] == 'op' or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_snippets_and_failed_searches(spark):
    text = "A sentence of the post that is long enough to be found on a page, word for word."
    docs = spark.createDataFrame([("1", "", text, True), ("2", "", text + " two", False)], "id string, url string, text string, searched boolean")
    pages = spark.createDataFrame([(1, "https://a.org/1", None, f"<b>{text}</b>"), (2, "http://127.0.0.1/x", None, text), (3, "https://b.org/", f"<p>{text}</p>", "other")], "page_id long, url string, html string, snippet string")
    got = {r["id"]: r for r in web.checked(docs, pages).collect()}
    assert (got["1"]["status"], got["1"]["sources_checked"], got["1"]["matched"]) == ("matched", 1, 2)
    assert got["1"]["match_urls"] == ["https://b.org/", "https://a.org/1"] and got["2"]["status"] == "failed"


def test_a_locked_selection_stays(spark):
    ten = lambda first: spark.createDataFrame([(str(first + i), i + 1) for i in range(10)], "id string, place long")
    free = posts.locked_selection(ten(0), ten(0).limit(0))
    assert sorted(r["id"] for r in free.collect()) == [str(i) for i in range(10)]
    assert posts.locked_selection(ten(0), ten(0)).count() == 10
    with pytest.raises(Exception, match="locked"):
        posts.locked_selection(ten(1), ten(0)).collect()


def test_zip_members_of_one_name_fail(spark, tmp_path):
    import warnings

    with warnings.catch_warnings(), zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        warnings.simplefilter("ignore")
        for _ in range(2):
            z.writestr("data/tweets.js", "window.YTD.tweets.part0 = []")
    with pytest.raises(Exception, match="one name"):
        readers.zip_members(spark, [str(tmp_path / "a.zip")]).collect()


@pytest.mark.parametrize("sign", [",", "\t", ";"])
def test_table_with_signs_and_quotes_in_its_texts(sign):
    """Every place of the first 8 KB holds a quoted comma, tab, semicolon or doubled quote in some file."""
    known = frozenset({"id", "text", "notes"})
    for shift in range(11):
        texts = [("x" * shift + ', "a",\t"";\r\n;') * 3 + "'" * k for k in range(200)]
        body = "".join(sign.join([str(k), '"n"', '"' + t.replace('"', '""') + '"']) + "\r\n" for k, t in enumerate(texts))
        rows = list(readers.parse_csv(sign.join(["id", "notes", "text"]) + "\r\n" + body, known))
        assert rows == [{"id": str(k), "notes": "n", "text": t} for k, t in enumerate(texts)]
    assert list(readers.parse_csv('"id"\n"a,b;c"\n', known)) == [{"id": "a,b;c"}]
    with pytest.raises(ValueError):
        list(readers.parse_csv("nothing,known\n1,2\n", known))
    with pytest.raises(csv.Error):
        list(readers.parse_csv(f'id{sign}text\n1{sign}"unclosed', known))


def test_form_candidates_and_faults(spark):
    form = "## 一、\nhttps://x.com/a/status/9\n## 二、申请候选\n- https://twitter.com/a/status/1 https://www.x.com/b/status/2\n- https://e.org/status/3\n## 三、\nhttps://x.com/a/status/8"
    texts = spark.createDataFrame([("a", form), ("b", "#### P1\n- 帖子链接：https://x.org/1\n### 来源记录 S1\n- 对应帖子链接或编号：P2\n### 来源记录 S2\n- 对应帖子链接或编号：P1\n"), ("c", None)], "file string, text string")
    assert [(r["file"], r["place"], r["url"]) for r in readers.form_candidates(texts).orderBy("place").collect()] == [("a", 0, "https://twitter.com/a/status/1"), ("a", 1, "https://www.x.com/b/status/2")]
    assert sorted((r["file"], r["fault"], r["target"]) for r in readers.form_faults(texts).collect()) == [("a", "blank_form", None), ("b", "source_unmatched", "P2"), ("c", "blank_form", None)]


def test_a_hot_owner_streams_by(spark):
    rows = [("hot", i, float(i * 7 % 40_000), 1 + i % 2) for i in range(3000)] + [(f"o{i % 5}", 10_000 + i, float(i), 1) for i in range(100)]
    got = {r["request"]: r["granted"] for r in budgets.greedy(spark.createDataFrame(rows, "owner string, request long, at double, n long"), 6).collect()}
    want, held = {}, {}
    for owner, request, at, n in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        held.setdefault(owner, budgets.Budget(6))
        want[request] = held[owner].reserve(at, n)
    assert got == want


def test_batches_that_are_given_up_keep_what_arrived(spark):
    planned = spark.createDataFrame([(str(i), 100 + i, i == 2) for i in range(6)], "id string, original_chars long, text_truncated boolean")
    results = spark.createDataFrame([("1", "matched")], "id string, status string")
    batch = spark.createDataFrame([("1",), ("2",), ("2",), ("9",)], "id string")
    lost = budgets.abandoned(results, planned, batch, "response_unknown").collect()
    assert [(r["id"], r["status"], r["issues"], r["text_truncated"], r["max_similarity"]) for r in lost] == [("2", "failed", ["batch_response_unknown", "response_unknown"], True, None)]
    left = budgets.remaining(planned, results.select("id").union(batch.where("id = '2'")))
    assert {r["id"] for r in left.collect()} == {"0", "3", "4", "5"}
    with pytest.raises(ValueError):
        budgets.abandoned(results, planned, batch, "bored")


def test_stopped_and_repeated_batches_give_one_result(spark, tmp_path):
    apply = budgets.upserting(f"{tmp_path}/t")
    part = lambda *rows: spark.createDataFrame(list(rows), "id string, status string, ord long")
    apply(part(("a", "matched", 1)), 0)
    (tmp_path / "t" / "v1").mkdir()  # a batch that was stopped: a folder without its mark
    (tmp_path / "t" / "v1" / "part-0.parquet").write_bytes(b"half a file")
    for _ in range(2):
        apply(part(("b", "failed", 2), ("a", "abandoned", 3)), 1)
    apply(part(("c", "matched", 4)), 2)
    apply(part(("b", "matched", 5)), 3)
    got = {(r["id"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/t/v3").collect()}
    assert got == {("a", "matched"), ("b", "matched"), ("c", "matched")}
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v2", "v3"]


def test_archive_beyond_four_gigabytes(spark, tmp_path):
    """A sparse file whose members lie behind 5 GB of nothing, with 64-bit places."""
    path = tmp_path / "far.zip"
    with open(path, "wb") as file:
        file.truncate(5 << 30)
        file.seek(5 << 30)
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("data/tweets.js", 'window.YTD.tweets.part0 = [{"tweet": {"id_str": "1", "full_text": "far"}}]')
            z.writestr("media/p.jpg", b"picture" * 1000)
    rows = {r["member"]: r for r in readers.zip_members(spark, [str(path)]).collect()}
    assert b"far" in bytes(rows["data/tweets.js"]["content"]) and rows["media/p.jpg"]["sha256"] == hashlib.sha256(b"picture" * 1000).hexdigest()
    assert readers.zip_members(spark, [str(path)]).rdd.getNumPartitions() == 2
    raw = bytearray((end := path.open("rb")).seek(5 << 30) and end.read())
    at = raw.rindex(b"PK\x06\x07")  # the locator of the 64-bit directory
    with open(path, "r+b") as file:
        file.seek((5 << 30) + at + 8)
        file.write(b"\x00" * 8)
    with pytest.raises(Exception, match="locator"):
        readers.zip_members(spark, [str(path)]).collect()


@pytest.mark.parametrize("place", [8, 14, 18, 22, 30])  # method, checksum, packed and plain size, name
def test_headers_that_differ_from_the_directory_fail(spark, tmp_path, place):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("data/tweets.js", "window.YTD.tweets.part0 = []")
    raw = bytearray(path.read_bytes())
    raw[place] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception, match="own header|File name|Bad CRC"):
        readers.zip_members(spark, [str(path)]).collect()


def test_small_zips_share_a_task(spark, tmp_path):
    paths = []
    for k in range(70):
        paths.append(str(tmp_path / f"{k}.zip"))
        with zipfile.ZipFile(paths[-1], "w") as z:
            z.writestr("data/tweets.js", f"post {k}")
            z.writestr("media/p.png", b"x")
    found = readers.zip_members(spark, paths)
    assert found.rdd.getNumPartitions() == 2
    rows = found.collect()
    assert len(rows) == 140 and {bytes(r["content"]) for r in rows if r["kind"] == "post"} == {f"post {k}".encode() for k in range(70)}
    assert {r["file"] for r in rows if r["sha256"]} == set(paths)


def test_pages_of_a_batch_are_parsed_by_parts(spark):
    pages = spark.createDataFrame([(k, PAGE.replace("second", f"second {k}") if k % 9 else None, f"u{k}") for k in range(150)], "page_id int, html string, url string").coalesce(1)
    read = web.page_texts(pages)
    assert "ArrowEvalPython" not in read._jdf.queryExecution().optimizedPlan().toString()
    assert read.columns == ["page_id", "url", "text", "title", "published_at", "text_truncated"]
    assert [tuple(r) for r in read.orderBy("page_id").collect()] == [(r["page_id"], r["url"], *web.parse_page(r["html"])) for r in pages.orderBy("page_id").collect()]
    assert web.page_texts(pages.limit(0)).count() == 0


def test_records_are_parsed_once_to_be_numbered(spark):
    texts = [("tweets-part1.js", 'window.YTD.tweets.part1 = [{"tweet": {"id_str": "c", "full_text": "z"}}] \n;\t\n'), ("tweets.js", ' window.YTD.tweets.part0 = [{"id_str": "a", "full_text": "x;"}, {"id_str": "b"}];')]
    found = readers.ordered(readers.records_of(spark.createDataFrame(texts, "file string, text string"), "js"))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.select("ord", F.try_variant_get("record", "$.id_str", "string").alias("id"), F.try_variant_get("record", "$.full_text", "string").alias("text")).orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [(1, "a", "x;"), (2, "b", None), (3, "c", "z")]

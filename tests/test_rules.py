"""Rules, statuses, ranking, compliance and policy on hand-made posts."""

import pytest
from pyspark.sql import functions as F

from inkwarden.operators import compliance, findings, near, posts, report

LONG = "这是一段足够长的原创正文，用来检查账号内的重复与来源重合，内容包括观点、分析与背景说明。"


def make(spark, rows):
    """Posts from dicts; what a dict lacks is empty, text_complete is true."""
    import json

    full = [json.dumps({"id": str(i + 1), "type": "original", "text_complete": True, "ord": i + 1, "url": ""} | r) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(x,) for x in full], "j string").select(F.from_json("j", posts.SCHEMA).alias("p")).select("p.*")
    fill = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType) if f.dataType.typeName() == "array" else F.lit("")) for f in posts.SCHEMA.fields if f.dataType.typeName() in ("array", "string")}
    return posts.with_clean(df.withColumns(fill))


def status(spark, rows, near_pairs=None):
    p = make(spark, rows)
    out = findings.statuses(p, findings.findings(p, near_pairs))
    return {r["id"]: r["status"] for r in out.collect()}


def test_exact_copies_differ_by_link_and_stops(spark):
    rows = [{"text": LONG}, {"text": LONG.replace("，", "") + " https://t.co/x"}, {"text": LONG, "type": "repost"}]
    assert status(spark, rows) == {"1": "high_risk", "2": "high_risk", "3": "review"}
    assert posts.candidates(findings.statuses(make(spark, rows), findings.findings(make(spark, rows)))).count() == 0


def test_many_copies_have_exact_totals_and_few_peers(spark):
    p = make(spark, [{"text": LONG}] * 501)
    rows = findings.exact_groups(p).collect()
    assert len(rows) == 501 and all(r["members"] == 501 and len(r["peers"]) == 8 and r["id"] not in r["peers"] for r in rows)


def test_near_duplicates(spark):
    other = LONG.replace("背景说明", "背景资料") + "补充"
    p = make(spark, [{"text": LONG * 2}, {"text": LONG + other}, {"text": "完全不同的另一段文字，讨论天气、音乐与旅行，也足够长，不会与其他内容相似，因为字句都不一样。"}])
    pairs = near.near_duplicates(p)
    got = pairs.collect()
    assert len(got) == 1 and (got[0]["id"], got[0]["other"]) == ("2", "1") and got[0]["similarity"] >= 0.84
    out = findings.statuses(p, findings.findings(p, pairs))
    assert {r["id"]: r["status"] for r in out.collect()} == {"1": "review", "2": "review", "3": "low_signal"}


def _varied(seed, alphabet="abcde", lengths=(60,), copies=3, rate=0.02):
    import random

    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))) for _ in range(12)]
    texts = base + ["".join(c if rng.random() > rate else rng.choice("vwxyz") for c in t) for t in base * copies]
    return texts + [t[: int(len(t) * 0.8)] for t in base]


def _grams(text):
    return {text[i : i + 4] for i in range(len(text) - 3)}


def _pairs(texts):
    """Earlier and later text of every pair of distinct texts, and their Jaccard similarity."""
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    return {(str(i + 1), str(k + 1)): (a, b, len(_grams(a) & _grams(b)) / len(_grams(a) | _grams(b))) for a, i in first.items() for b, k in first.items() if i > k}


@pytest.mark.parametrize("seed", [5, 6])
def test_signatures_lose_no_pair(spark, seed):
    texts = _varied(seed, lengths=(50, 60, 120, 300))
    p = make(spark, [{"text": t} for t in texts])
    for threshold in (0.4, 0.6, 0.84):
        got = {(r["id"], r["other"]): r["similarity"] for r in near.near_pairs(p, threshold).collect()}
        assert got == {k: pytest.approx(j) for k, (_, _, j) in _pairs(texts).items() if j >= threshold}


def test_blocks_of_maps_lose_no_pair_and_leave_few(spark):
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    texts = ["".join(rng.sample(words, 300)) for _ in range(40)]  # half their grams are common to all
    texts += [t[:900] + "".join(rng.sample(words, 10)) + t[960:] for t in texts[:10]]
    base = near._grammed(make(spark, [{"text": t} for t in texts]))
    want = {k for k, (_, _, j) in _pairs(texts).items() if j >= 0.84}
    assert len(want) >= 10
    for block in (3, 4096):
        pairs = near.candidate_pairs(base, 0.84, "n", 0.84, 6 * near.differing(0.84), block)
        met = {(str(r["later"]), str(r["earlier"])) for r in pairs.collect()}
        assert met >= want and len(met) < 3 * len(want)
        for least in (4, 4096):
            got = [(r["id"], r["other"]) for r in near.compared(pairs, base, 0.84, least=least).collect()]
            assert len(got) == len(want) and set(got) == want


def test_pieces_of_similar_sets_agree():
    import math

    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40, 333, 2000):
        for threshold in (0.5, 0.84):
            grams = rng.integers(0, 1 << 62, size=2 * n, dtype=np.int64)
            most = math.floor((1 - threshold) / (1 + threshold) * 2 * n + 1e-9) // 2  # so many leave one side and as many the other
            a, b = grams[:n], grams[most : n + most]
            assert len(a) - most >= threshold * (n + most) - 1e-9
            assert set(near.signatures(a, threshold)) & set(near.signatures(b, threshold))
            short = grams[: math.ceil(threshold * n)]  # a subset, as small as the threshold allows
            assert set(near.signatures(a, threshold)) & set(near.signatures(short, threshold))


def test_short_texts_of_one_language_are_no_candidates(spark):
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 6))) for _ in range(90)]
    texts = ["".join(rng.choices(words, [1 / (k + 1) for k in range(90)], k=460 + 40 * (i % 4))) for i in range(40)]
    texts += [t[:600] + "".join(rng.choices(words, k=30)) + t[700:] for t in texts[:8]]
    texts += ["".join(chr(ord(c) + 12) for c in t) for t in texts[:20]]  # another language
    base = near._grammed(make(spark, [{"text": t} for t in texts])).where(F.col("len") <= near.RATIO_LENGTH)
    near_ones = {k for k, (_, _, j) in _pairs(texts).items() if j >= 0.4}
    for block in (16, 4096):
        met = {(str(r["later"]), str(r["earlier"])) for r in near.candidate_pairs(base, 0.4, "len", 0.7, 6.4, block).collect()}
        assert met >= {k for k in near_ones if min(len(texts[int(x) - 1]) for x in k) >= 0.7 * max(len(texts[int(x) - 1]) for x in k)}
        assert len(met) < 2 * len(near_ones)


def test_halved_maps_leave_what_whole_ones_do(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    common = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(common, 400, replace=False), rng.integers(0, 1 << 62, 300).astype(np.uint64)]) for _ in range(60)]
    sets += [np.r_[s[40:], rng.integers(0, 1 << 62, 40).astype(np.uint64)] for s in sets[:10]]
    maps, n = np.stack([near.parity_map(s, 8192) for s in sets]), np.array([len(s) for s in sets])
    most = near.differing(0.4) * n
    apart = np.bitwise_count(maps[:, None] ^ maps[None]).sum(axis=2, dtype=np.int64)
    want = set(zip(*(x.tolist() for x in np.nonzero(apart <= most[:, None] + most[None])), strict=True))
    for look in (0, 1 << 40):  # the most halved, and none
        monkeypatch.setattr(near, "LOOK", look)
        x, y = near._near_tile((maps, maps), (most, most), {})
        assert set(zip(x.tolist(), y.tolist(), strict=True)) == want
    assert len(want) >= len(sets) + 20


@pytest.mark.parametrize("block", [4, 4096])
def test_ratio_in_blocks_against_brute_force(spark, block):
    import difflib

    texts = _varied(8, alphabet="abcdefghij", lengths=(50, 70, 100, 400), rate=0.06)
    p = make(spark, [{"text": t} for t in texts])
    want = {}
    for key, (a, b, j) in _pairs(texts).items():
        ratio = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        if j >= 0.4 and min(len(a), len(b)) >= 0.7 * max(len(a), len(b)) and ratio >= 0.84:
            want[key] = pytest.approx(max(j, ratio))
    got = {(r["id"], r["other"]): r["similarity"] for r in near.ratio_pairs(near._grammed(p), block).collect()}
    assert got == want and any(j < 0.84 for k, (_, _, j) in _pairs(texts).items() if k in want)


@pytest.mark.parametrize("sent", [0, 1 << 21])
def test_containment_by_both_ways(spark, sent):
    texts = _varied(9, lengths=(40, 90))
    posts_ = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(98, None), (99, "short")], "id int, text string")
    sources = spark.createDataFrame([(i, t + u) for i, (t, u) in enumerate(zip(texts, reversed(texts), strict=True))] + [(98, None), (99, "")], "source_id int, text string")
    got = {(r["id"], r["source_id"]): r["overlap"] for r in near.contained(posts_, sources, sent).collect()}
    shares = {(i, k): len(_grams(t) & _grams(s)) / len(_grams(t)) for i, t in enumerate(texts) for k, s in enumerate(a + b for a, b in zip(texts, reversed(texts), strict=True))}
    assert got == {k: pytest.approx(v) for k, v in shares.items() if v >= 0.5}
    assert near.contained(posts_.limit(0), sources, sent).count() == 0


def test_source_overlap_makes_no_lists_of_grams(spark):
    """Lists of strings, one a character, took most of the time."""
    from inkwarden.functions import text as T

    p = make(spark, [{"text": LONG, "sources": [{"text": LONG[:30], "url": "", "owner": "other"}, {"text": "", "url": "u", "owner": "other"}, {"text": LONG, "url": "", "owner": "self"}]}])
    codes = findings.source_codes(p)
    assert "array_intersect" not in codes._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["code"]: r["overlap"] for r in codes.collect()}
    mine, its = _grams(T.clean_value(LONG)), _grams(T.clean_value(LONG[:30]))
    assert rows == {"source_partial_overlap": len(mine & its) / len(mine), "source_link_unchecked": None, "self_crosspost_claim": 1.0}


@pytest.mark.parametrize("sent", [0, 1 << 21])
def test_comparison_by_both_ways(spark, sent):
    from inkwarden.functions import text as T

    mixed = "".join(LONG[i : i + 7] + LONG[i + 3 : i + 7] for i in range(0, len(LONG), 4))  # its grams, without a long run
    posts_ = spark.createDataFrame([("a", LONG), ("b", LONG[8:]), ("c", None), ("d", "short")], "id string, text string")
    texts = {1: "x" * 30 + LONG + "y" * 30, 2: mixed, 3: None, 4: LONG[:43] + "，" + LONG[43:]}
    sources = spark.createDataFrame(list(texts.items()), "source_id int, text string")
    got = {(r["id"], r["source_id"]): (r["score"], r["matched_chars"], r["post_excerpt"], r["source_excerpt"]) for r in near.compared_texts(posts_, sources, sent=sent).collect()}
    none = (None,) * 4
    assert got == {(i, k): tuple((T.compare_values(t, texts[k]) or dict.fromkeys("abcd")).values()) for i, t in (("a", LONG), ("b", LONG[8:])) for k in (1, 2, 4)}
    assert got["a", 2] == none and got["a", 1][0] == 1.0 and near.compared_texts(posts_.limit(0), sources, sent=sent).count() == 0


def test_grams_of_sources_stay_in_one_step(spark):
    posts_ = spark.createDataFrame([(1, LONG)], "id int, text string")
    sources = spark.createDataFrame([(k, LONG + str(k)) for k in range(600)] + [(600, "")], "source_id int, text string")
    hits = near.contained(posts_, sources)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r["source_id"], r["overlap"]) for r in hits.collect()) == [(k, 1.0) for k in range(600)]


@pytest.mark.parametrize(
    ("post", "codes"),
    [
        ({"sources": [{"text": LONG, "url": "u", "owner": "other"}]}, {"source_overlap_no_contribution": "high_risk"}),
        ({"sources": [{"text": LONG, "url": "u", "owner": "self"}]}, {"self_crosspost_claim": "review"}),
        ({"sources": [{"text": LONG, "url": "u", "owner": "other"}], "contribution": LONG}, {"source_overlap_with_contribution": "review"}),
        ({"sources": [{"text": LONG[:30] + "另外半段文字与来源没有关系", "url": "u", "owner": "other"}]}, None),
        ({"sources": [{"text": "", "url": "u", "owner": "other"}]}, {"source_link_unchecked": "review"}),
        ({"sources": [{"text": "", "url": "", "owner": "other"}]}, {"source_missing": "review"}),
        ({"sources": [{"text": "短", "url": "", "owner": "other"}]}, {"source_short": None}),
        ({"sources": [{"text": "another text that has nothing at all in common", "url": "", "owner": "other"}]}, {"source_no_high_overlap": None, "source_contribution_unexplained": "review"}),
        ({"sources": [{"text": "another text that has nothing at all in common", "url": "", "owner": "self"}]}, {"source_no_high_overlap": None}),
        ({"type": "quote"}, {"quote_source_missing": "review"}),
        ({"text_complete": None}, {"text_incomplete": "insufficient"}),
        ({"text": ""}, {"missing_text": "insufficient"}),
        ({"missing_media": ["a.jpg"]}, {"media_missing": "insufficient"}),
        ({"media": [{"name": "a", "hash": "", "kind": "image", "hash_origin": ""}]}, {"media_reference_only": "insufficient"}),
        ({"media": [{"name": "a", "hash": "0" * 64, "kind": "image", "hash_origin": ""}]}, {"media_content_unchecked": "review"}),
        ({"creation_method": "by hand", "evidence": ["e"]}, {"creation_method_declared": None, "evidence_reference": None}),
        ({}, {"no_supplied_text_match": None}),
    ],
)
def test_codes(spark, post, codes):
    found = {r["code"]: r["level"] for r in findings.findings(make(spark, [{"text": LONG} | post])).collect()}
    if codes is not None:
        assert found == codes
    else:
        assert set(found) <= {"source_partial_overlap", "source_no_high_overlap", "source_contribution_unexplained"}


def test_threads(spark):
    part = lambda i, n, complete=None: {"text": f"{LONG}{i}", "thread_id": "t", "thread_order": i, "thread_total": n, "thread_complete": complete}
    missing = lambda rows: [r["missing"] or r["inconsistent"] or r["unknown"] for r in findings.threads(make(spark, rows)).collect()]
    assert missing([part(1, 3), part(3, 3)]) == [True]
    assert missing([part(1, 2), part(2, 2)]) == [False]
    assert missing([part(1, 2), part(1, 2)]) == [True]
    assert missing([part(1, 2, False), part(2, 2)]) == [True]
    assert missing([part(0, 0), part(0, 0)]) == [True]
    assert missing([part(0, 0, True), part(0, 0, True)]) == [False]
    entry = posts.thread_entry(make(spark, [part(None, 2), part(2, 2), part(1, 2)])).first()
    assert entry["entry_id"] == "3"


def test_media_and_phrases(spark):
    file = {"name": "a", "hash": "ab" * 32, "kind": "image", "hash_origin": ""}
    rows = [{"text": f"{LONG}{i} 点赞，转发，关注", "media": [file] if i < 2 else []} for i in range(3)]
    p = make(spark, rows)
    assert {r["id"] for r in findings.same_media(p).collect()} == {"1", "2"}
    assert findings.repeated_phrases(p).count() == 3 and findings.repeated_phrases(p.where("id <> '3'")).count() == 0


def test_window(spark):
    rows = [("2026-07-08T16:30:00Z",), ("2026-10-06T15:59:00Z",), ("2026-10-06T16:00:00Z",), ("when",)]
    got = [r[0] for r in spark.createDataFrame(rows, "d string").select(posts.window_bucket(F.col("d"), "2026-07-09", "2026-10-06")).collect()]
    assert got == ["selected", "selected", "outside", "invalid"]
    assert [r[0] for r in spark.createDataFrame(rows[3:], "d string").select(posts.window_bucket(F.col("d"), None, None)).collect()] == ["selected"]


def test_candidates(spark):
    rows = [{"text": f"{LONG}{'补充' * i}", "contribution": "x" if i == 7 else ""} for i in range(13)] + [{"text": LONG + "回复内容", "type": "reply"}, {"text": LONG, "type": "repost"}]
    p = make(spark, rows)
    out = posts.candidates(findings.statuses(p, findings.findings(p))).orderBy("rank").collect()
    assert len(out) == 10 and out[0]["id"] == "8" and out[1]["id"] == "13" and [r["rank"] for r in out] == list(range(1, 11))


def test_first_wins(spark):
    rows = [("a", "", "x"), ("a", "", "x"), ("a", "", "y"), ("a", "", "x"), ("b", "", "x"), ("c", "u", "1"), ("d", "u", "2")]
    p = spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "id string, url string, text string, ord long")
    assert [r["id"] for r in posts.first_wins(p).orderBy("ord").collect()] == ["a", "a__3", "a__4", "b", "c", "d__7"]


def test_interleaving_and_matches(spark):
    hits = [("p", 1, 1, "a"), ("p", 1, 2, "b"), ("p", 1, 3, "c"), ("p", 2, 1, "a"), ("p", 2, 2, "d"), ("p", 2, 3, "b")]
    df = spark.createDataFrame(hits, "id string, query_no int, rank int, url string")
    assert [r["url"] for r in posts.interleaved(df).orderBy("place").collect()] == ["a", "b", "d", "c"]
    matches = spark.createDataFrame([("p", "s", 0.9, "search_snippet"), ("p", "b", 0.5, "page_body"), ("p", "c", 0.7, "page_body"), ("p", "z", 0.1, "search_snippet")], "id string, url string, score double, source_kind string")
    assert [(r["url"], r["total"]) for r in posts.ordered_matches(matches).orderBy("place").collect()] == [("c", 4), ("b", 4), ("s", 4)]


def test_hits_are_dealt_by_their_number(spark):
    import re

    rows = [(k % 40, f"u{k * 7 % 11}", k // 40 % 6, k % 3) for k in range(2000)]
    df = spark.createDataFrame(rows, "id int, url string, rank int, query_no int")
    want = {}
    for i in range(40):
        first = {}
        for _, url, rank, query in sorted((r for r in rows if r[0] == i), key=lambda r: (r[2], r[3], r[1])):
            first.setdefault(url, (rank, query, url))
        want |= {(i, url): place for place, url in enumerate(sorted(first, key=first.get)[:5], 1)}
    for held in (100, 1 << 20):
        found = posts.interleaved(df, held=held)
        assert {(r["id"], r["url"]): r["place"] for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(id#\w+, url", plan) and (held > 100 or re.search(r"hashpartitioning\(id#\w+, 20\)", plan))


def test_reply_groups_with_a_cycle_and_a_long_chain(spark):
    edges = [(i, i - 1 if i else None) for i in range(150)] + [(1000, 1001), (1001, 1000), (2000, 9999), (3000, 3000)]
    roots = {r["node"]: r["root"] for r in posts.reply_groups(spark.createDataFrame(edges, "node long, parent long")).collect()}
    assert all(roots[i] == 0 for i in range(150)) and roots[1001] == roots[1000] == 1000 and roots[2000] == 2000 and roots[3000] == 3000


def test_paging_selection_and_plans(spark):
    p = posts.ambiguous(make(spark, [{"text": f"{LONG} number {i}"} for i in range(12)] + [{"text": "short"}]))
    page = posts.page(p, 5, 4).collect()
    assert [r["id"] for r in page] == ["6", "7", "8", "9"] and page[0]["total"] == 13 and page[0]["next_offset"] == 9
    assert posts.page(p, 10, 50).first()["next_offset"] is None
    chosen = lambda ids: spark.createDataFrame([(i,) for i in ids], "value string")
    assert posts.validate_selection(p, chosen([str(i) for i in range(1, 11)])).first()["valid"]
    assert not posts.validate_selection(p, chosen([str(i) for i in range(4, 14)])).first()["valid"]
    assert not posts.validate_selection(p, chosen(["1"] * 10)).first()["valid"]
    assert [r["id"] for r in posts.search(p, "NUMBER 3").collect()] == ["4"]
    assert {r[0] for r in p.where("id = '13'").select(posts.web_reason()).collect()} == {"short_text"}


def test_compliance_values(spark):
    scope = spark.createDataFrame([(str(i),) for i in range(10)], "id string")
    schema = "id string, criterion string, score double, status string, model string"
    reviews = spark.createDataFrame([("0", "original_contribution", 80.0, "completed", "m"), ("0", "monetization_focus", 100.0, "completed", "m"), ("0", "automation", 100.0, "completed", "m"), ("1", "original_contribution", 101.0, "completed", "m"), ("2", "original_contribution", 50.0, "failed", "m")], schema)
    r = compliance.rollup(compliance.criteria(scope, reviews)).first()
    assert [round(r[k], 2) for k in ("score", "covered", "supported", "unknown", "low", "high")] == [83.33, 6, 5, 94, 5, 99]
    empty = compliance.rollup(compliance.criteria(scope, reviews.limit(0))).first()
    assert empty["score"] is None and (empty["low"], empty["high"]) == (0, 100)
    reasons = {(r["criterion"], r["reason"]): r["posts"] for r in compliance.unknown_reasons(scope, reviews).collect()}
    assert reasons["original_contribution", "no_review"] == 7 and reasons["original_contribution", "failed"] == 1 and reasons["original_contribution", "insufficient_evidence"] == 1 and reasons["automation", "unverifiable"] == 10
    with pytest.raises(ValueError):
        compliance.validate_weights({"original_contribution": 100})


def test_automation_and_earning(spark):
    methods = [("AI generated", True), ("not AI generated", False), ("没有自动生成", False), ("自动发布", True), ("human written", False), ("not: automated posting, but ai-generated", True), ("", False)]
    rows = spark.createDataFrame(methods, "m string, want boolean").select("want", compliance.automation_declared(F.col("m")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    texts = [("how to increase your revenue fast", True), ("revenue was up", False), ("如何提升收益", True)]
    rows = spark.createDataFrame(texts, "t string, want boolean").select("want", compliance.advises_on_earning(F.col("t")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_requirements_keep_unknown_apart(spark):
    p = make(spark, [{"text": LONG, "creation_method": "not AI generated"}, {"text": LONG + "再补", "creation_method": "AI generated"}, {"text": LONG, "type": "repost"}])
    none = spark.createDataFrame([], "id string, url string, score double, source_kind string, page_status string, temporal_relation string")
    web = spark.createDataFrame([], "id string, status string, sources_checked long, original_chars long, checked_chars long, text_truncated boolean")
    rows = {r["requirement"]: r for r in compliance.requirements(compliance.signals(p, findings.findings(p), none, web)).collect()}
    assert (rows["automation"]["signals"], rows["automation"]["assessed"], rows["automation"]["share"]) == (1, 2, 0.5)
    assert rows["original_contribution"]["status"] == "unknown" and rows["original_contribution"]["share"] is None
    assert rows["intellectual_property"]["assessed"] == 0 and rows["monetization_focus"]["status"] == "no_detected_signal"


def test_reports(spark):
    p = make(spark, [{"text": LONG}, {"text": "<script>", "url": "u"}])
    with_status = findings.statuses(p, findings.findings(p))
    parts = findings.status_histogram(with_status), findings.coverage(p, None), compliance.rollup(compliance.criteria(p.select("id"), spark.createDataFrame([], "id string, criterion string, score double, status string"))).select("score", "covered"), posts.candidates(with_status)
    text = report.markdown("T & U", *parts)
    assert "- low_signal: " in text and "- coverage: unknown" in text and "- score: pending" in text and "> 这是" in text
    page = report.as_html("T & U", *parts)
    assert "T &amp; U" in page and "<script>" not in page


def test_time_zones():
    from inkwarden.operators import posts

    assert [posts.time_zone(x) for x in (None, " ", "北京时间", "UTC", "UTC+8", "UTC-3:30", "UTC+14", "Europe/Paris")] == ["+08:00", "+08:00", "+08:00", "+00:00", "+08:00", "-03:30", "+14:00", "Europe/Paris"]
    for bad in ("UTC+15", "UTC+14:30", "UTC+2:75", "nowhere"):
        with pytest.raises(ValueError):
            posts.time_zone(bad)


def test_near_reasons_show_the_closest(spark):
    from inkwarden.operators import findings

    near = spark.createDataFrame([("0", str(i), 0.84 + i / 100) for i in range(1, 13)], "id string, other string, similarity double")
    rows = findings.near_reasons(near).where("id = '0'").orderBy("place").collect()
    assert [r["other"] for r in rows] == [str(i) for i in range(12, 4, -1)] and {r["total"] for r in rows} == {12}


def test_media_that_are_none_fail(spark):
    import json

    from pyspark.sql import functions as F

    from inkwarden.sources import normalize

    for media in ({"media": "x"}, {"media": ["x"]}):
        rows = spark.createDataFrame([(1, json.dumps({"id_str": "1", "full_text": "t", "entities": media}))], "ord long, j string").select("ord", F.parse_json("j").alias("record"))
        with pytest.raises(Exception, match="media"):
            normalize.archive_posts(rows).collect()


def test_grams_of_long_texts(spark):
    """Every block boundary, against plain slices."""
    from pyspark.sql import functions as F

    from inkwarden.functions import text as T

    texts = ["", "abc", "abcd", *("".join(chr(97 + (i * i + n) % 26) for i in range(n)) for n in (511, 512, 513, 514, 515, 516, 1023, 1027, 80_000)), "𝒜bcé" * 300]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").select("k", T.grams(F.col("t")).alias("g")).collect()
    for r in rows:
        t = texts[r["k"]]
        want = list(dict.fromkeys(t[i : i + 4] for i in range(len(t) - 3))) if len(t) >= 4 else [t] * bool(t)
        assert r["g"] == want


def test_archive_result_counts_and_examples(spark):
    near_copy = LONG.replace("背景说明", "背景资料")
    rows = [{"text": LONG}, {"text": LONG}, {"text": LONG + near_copy}, {"text": LONG, "type": "repost"}, {"text": "短"}, {"text": "", "type": "quote"}]
    rows += [{"text": f"第{i}条完全不同的文字，" + "".join(chr(0x4E00 + (i * 37 + k * k) % 5000) for k in range(40))} for i in range(20)]
    p = make(spark, rows)
    pairs = spark.createDataFrame([("3", "1", 0.9)], "id string, other string, similarity double")
    r = findings.archive_result(p, findings.findings(p, pairs)).first()
    assert (r["total"], r["posts"], r["reposts"], r["quotes"]) == (26, 24, 1, 1)
    assert (r["nonduplicate_denominator"], r["nonduplicate_numerator"], r["comparison_excluded"], r["nonduplicate_percent"]) == (23, 20, 2, 87.0)
    assert [tuple(x) for x in r["reasons"]] == [("internal_exact", 2), ("internal_near", 2), ("repost_record", 1), ("quote_source_missing", 1), ("missing_text", 1)]
    assert len(r["examples"]) == 12 and [e["id"] for e in r["examples"][:5]] == ["1", "2", "6", "3", "4"] and r["media_completeness_percent"] is None
    clear = make(spark, rows[6:])
    assert [tuple(x) for x in findings.archive_result(clear, findings.findings(clear)).first()["reasons"]] == [("no_internal_match", 20)]
    empty = findings.archive_result(p.limit(0), findings.findings(p.limit(0))).first()
    assert empty["total"] == 0 and empty["nonduplicate_percent"] is None and empty["examples"] == []


@pytest.mark.parametrize("sent", [0, 1 << 21])
def test_search_against_exhaustive_ranking(spark, sent):
    import random

    from inkwarden.functions import text as T
    from inkwarden.operators import web

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(9))
    items = [". ".join(sentence() for _ in range(4)) + "." for _ in range(8)]
    pages = [" ".join(sentence() for _ in range(rng.randint(2, 60))) for _ in range(40)]
    for i, text in enumerate(items):  # a page with half an item word for word, the rest of other words
        pages[i] = pages[i][:200] + " " + text[: len(text) // 2 + 20] + " " + pages[i][:100]
    posts_ = spark.createDataFrame(list(enumerate(items)), "id int, text string")
    held = spark.createDataFrame(list(enumerate(pages)), "page_id int, text string")
    fragments = {r["id"]: r["q"] for r in posts_.select("id", T.search_fragments(F.col("text")).alias("q")).collect()}
    want = {}
    for i, queries in fragments.items():
        ranked = []
        for k, q in enumerate(queries):
            g = _grams(T.clean_value(q))
            shares = sorted((-len(g & _grams(T.clean_value(p))) / len(g), j) for j, p in enumerate(pages))
            ranked += [(rank, k, j) for rank, (s, j) in enumerate(x for x in shares if x[0] <= -0.4) if rank < 5]
        order = []
        for _, _, j in sorted(ranked):
            if j not in order:
                order.append(j)
        want |= {(i, j): k + 1 for k, j in enumerate(order[:5])}
    got = {(r["id"], r["page_id"]): r["place"] for r in web.retrieved(posts_, held, sent=sent).collect()}
    assert got == want
    held_whole = [i for i in range(8) if any(q in pages[i] for q in fragments[i])]
    assert len(held_whole) > 3 and all((i, i) in got for i in held_whole)

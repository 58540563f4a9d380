"""Quality rules, mixing, line dedup and URL filters on odd rows and against brute force."""

import re
from collections import Counter

import pytest

from inkwarden.llm import line_dedup, mixing, quality_rules, url_filters
from tests.llm.conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_counts(odd):
    rows = quality_rules.judged(odd).collect()
    assert len(rows) == len(ROWS)
    want = Counter()
    for doc_id, text, *_ in ROWS:
        w = WORD.findall(text or "")
        windows = Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want[doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed] += 1
    assert Counter((r["doc_id"], *(r[c] for c in quality_rules.BASE), r["base_failed"]) for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_quality_fences_follow_the_group(spark):
    plain = [(i, " ".join(f"word{(i * 7 + k) % 900}" for k in range(80)), "en", "a") for i in range(60)]
    noisy = [(100 + i, " ".join(f"wo#rd$*{(i * 7 + k) % 900}" for k in range(80)), "en", "a") for i in range(5)]
    code = [(200 + i, " ".join(f"wo#rd$*{(i * 7 + k) % 900}" for k in range(80)), "en", "code") for i in range(60)]
    docs = spark.createDataFrame(plain + noisy + code, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality_rules.filtered(docs).select("doc_id").collect()}
    assert kept == {d[0] for d in plain + code}
    assert quality_rules.filtered(docs).columns == docs.columns


def test_histogram_buckets_bound_the_error(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 5000, 7).select("id", quality_rules.bucket(F.col("id")).alias("b")).collect()
    assert all(r["b"] <= r["id"] and (r["id"] - r["b"]) * 32 <= max(r["id"], 1) * 1 for r in rows)
    assert all(r["b"] == r["id"] for r in rows if r["id"] < 64)


def test_quality_keeps_odd_rows_and_columns(odd):
    out = quality_rules.filtered(odd)
    assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {7}
    assert quality_rules.filtered(odd.limit(0)).count() == 0 and quality_rules.judged(odd.limit(0)).count() == 0


def _targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    due, full = share * sum(sizes.values()), set()
    while True:
        rest = due - sum(cap * sizes[s] for s in full)
        total = sum(w[s] for s in order if s not in full)
        out = {s: cap * sizes[s] if s in full else rest * w[s] / total for s in order}
        over = {s for s in order if s not in full and out[s] > cap * sizes[s] + 1e-9}
        if not over:
            return out
        full |= over


def test_mixing_targets_and_words(odd):
    small = odd.where("doc_id IS NULL OR doc_id <> 7")
    rows = mixing.plan(small).collect()
    again = mixing.plan(small.repartition(5)).collect()
    assert len(rows) == len(ROWS) - 1
    taken = lambda r: sum(d["words"] for d in r["draws"])
    assert sorted((str(r["doc_id"]), taken(r)) for r in rows) == sorted((str(r["doc_id"]), taken(r)) for r in again)
    sizes, got = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        got[r["source"]] += taken(r)
        assert 0 <= taken(r) <= 2 * r["size"]
    want = _targets(dict(sizes))
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(got[s] - want[s]) <= 1
    assert mixing.plan(odd.limit(0)).count() == 0


def test_mixing_draws_are_disjoint_and_fill_shards(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i * 13 % 700)), f"s{i % 4}") for i in range(300)], "doc_id long, text string, source string")
    mix = mixing.Mix(shards=8, block_words=32)
    planned = mixing.plan(docs, mix)
    seen = Counter()
    blocks = Counter()
    for r in planned.collect():
        for d in r["draws"]:
            blocks[d["shard"]] += d["blocks"]
            for b in range(d["block"], d["block"] + d["blocks"]):
                seen[r["doc_id"], d["pass"], b] += 1
    assert max(seen.values()) == 1 and set(blocks) == set(range(8))
    assert max(blocks.values()) - min(blocks.values()) <= 1
    assert mixing.shards(planned, mix).count() == sum(len(r["draws"]) for r in planned.collect())


def test_hypergeometric_mean_and_variance(spark):
    from pyspark.sql import functions as F

    total, good, draws = 1000.0, 300.0, 400.0
    rows = spark.range(3000).select(mixing._hypergeometric(F.xxhash64("id"), F.lit(total), F.lit(good), F.lit(draws)).alias("x")).agg(F.avg("x").alias("m"), F.variance("x").alias("v"), F.min("x"), F.max("x")).first()
    variance = draws * good / total * (1 - good / total) * (total - draws) / (total - 1)
    assert abs(rows["m"] - 120) < 0.8 and abs(rows["v"] / variance - 1) < 0.12


def test_mixed_documents_agree_with_the_plan(odd):
    small = odd.where("doc_id <> 7")
    want = Counter()
    for r in mixing.plan(small).collect():
        want[r["doc_id"]] += sum(d["words"] for d in r["draws"])
    got = Counter()
    out = mixing.mixed_documents(small)
    assert out.columns == small.columns
    for r in out.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert got == +want


def test_line_dedup_rules(odd):
    rows = {r["row"]["doc_id"]: r for r in line_dedup.deduplicated(odd).collect()}
    assert rows[8]["n_dropped"] == 0
    assert rows[9]["text"] == "another line that stands in this one only, nine" and rows[9]["n_dropped"] == 1
    assert rows[10]["n_dropped"] == 0 and rows[11]["text"] == ""  # they differ in variable fields only
    assert rows[1]["text"] == "" and rows[0]["text"] == ROWS[0][1]
    assert rows[2]["text"] is None and rows[3]["text"] == "" and rows[5]["text"] == "one"
    out = line_dedup.deduplicated_documents(odd)
    assert out.columns == odd.columns and out.count() == len(ROWS)
    assert line_dedup.deduplicated_documents(odd.limit(0)).count() == 0


def test_short_lines_need_more_documents(spark):
    docs = spark.createDataFrame([(i, f"All rights reserved.\nbody {i} " + "x" * i) for i in range(6)] + [(9, "only two\nonly two")], "doc_id long, text string")
    rows = {r["doc_id"]: r["n_dropped"] for r in line_dedup.deduplicated(docs).select("row.doc_id", "n_dropped").collect()}
    assert rows == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 0}


def test_repeated_rows_have_places_of_their_own(spark):
    for share, due in ((0.85, 170), (0.75, 150), (0.57, 114), (1.0, 200), (0.3, 60)):
        docs = spark.createDataFrame([(1, " ".join(["w"] * 100), "s", k) for k in range(2)], "doc_id long, text string, source string, part int")
        mix = mixing.Mix(share=share, block_words=32)
        assert sum(d["words"] for r in mixing.plan(docs, mix).collect() for d in r["draws"]) == due
        rows = mixing.mixed_documents(docs, mix).collect()
        assert sorted((len(WORD.findall(r["text"])) for r in rows), reverse=True) == [n for n in (min(100, due), due - 100) if n > 0]


def test_mix_is_written_by_shard_in_shuffled_order(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i * 13 % 700)), f"s{i % 4}") for i in range(300)], "doc_id long, text string, source string")
    mix = mixing.Mix(shards=8, block_words=32)
    first = {}
    for r in mixing.plan(docs, mix).collect():
        for d in r["draws"]:
            if d["block"] == 0:
                first[r["doc_id"], d["pass"]] = d["shard"]
    parts = mixing.mixed_documents(docs, mix).select("doc_id").rdd.mapPartitionsWithIndex(lambda k, rows: [(k, [r[0] for r in rows])]).collect()
    assert Counter((k, i) for k, ids in parts for i in ids) == Counter((s, i) for (i, _), s in first.items())
    assert all(ids != sorted(ids) for _, ids in parts if len(ids) > 9)


def test_shards_grow_with_the_mix(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * 500), "s") for i in range(64)], "doc_id long, text string, source string")
    for words, n in ((1 << 22, 1), (8000, 8), (2000, 32)):
        mix = mixing.Mix(shard_words=words, stretch=8)
        rows = mixing.plan(docs, mix).collect()
        assert {d["shard"] for r in rows for d in r["draws"]} == set(range(n))
        assert sum(d["words"] for r in rows for d in r["draws"]) == 48_000


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("a.b.example.com", "/en/x", "block"), ("", "/", "block"), (None, "/", "block")]
URLS = ["http://example.com/en/", "https://WWW.Example.com/en/a?b#c", "x://a.b.example.com/en/xyz", "http://net/es/", "http://q.net/fr", "http://q.net/fr/", "http://com", "http://com/", "nourl", None, "", "http://", "a://b://c", "http://notexample.com/en/", "http://e.com?x=/en/", "http://" + "a." * 300 + "com/" + "y/" * 300, "http://example.com/en/"]


def test_url_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: r for r in url_filters.judge(pages, rules).collect()}
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), u
    assert url_filters.judge(pages, rules.limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == len(URLS)
    assert url_filters.judge(pages.limit(0), rules).count() == 0


def test_every_fence_follows_its_group(spark):
    """The same rule gives each group bounds of its own, on the side where its documents lie."""
    found = []
    for g, scale in (("calm", 1), ("wild", 4)):
        for i in range(200):
            found.append((i, "en", g, 5 * scale * (i % 9), 9 * scale * (i % 23), 7 * scale * (i % 31), 500 + scale * 8 * ((i % 21) - 10), False))
    rows = spark.createDataFrame(found, "doc_id long, lang string, source string, symbol_pct long, repeat_permille long, dup_line_permille long, mean_chars_x100 long, base_failed boolean")
    calm, wild = (quality_rules.fences(rows).where(f"level = 2 AND source = '{g}'").first() for g in ("calm", "wild"))
    for m, rule in quality_rules.METRICS.items():
        values = sorted(r[3 + list(quality_rules.METRICS).index(m)] for r in found if r[2] == "wild")
        assert wild[f"high_{m}"] > calm[f"high_{m}"] > 0 and wild[f"high_{m}"] >= values[-1]
        assert (wild[f"low_{m}"] < calm[f"low_{m}"]) if rule.low else wild[f"low_{m}"] is None


def test_a_long_tail_above_does_not_lower_the_floor(spark):
    """Only lengths above the median vary: the high fence widens, the low one stays."""
    rows = [(i, "en", "s", 0, 0, 0, 500 + max(0, i - 60) * 4, False) for i in range(100)]
    f = quality_rules.fences(spark.createDataFrame(rows, "doc_id long, lang string, source string, symbol_pct long, repeat_permille long, dup_line_permille long, mean_chars_x100 long, base_failed boolean")).where("level = 2").first()
    rule = quality_rules.METRICS["mean_chars_x100"]
    middle = 496  # the bucket of 500
    assert f["low_mean_chars_x100"] == middle - rule.spread * rule.least and f["high_mean_chars_x100"] > middle + rule.spread * rule.least


def test_lines_that_differ_in_fields_share_a_template(spark):
    """Any two changed words of a long line, wherever they stand behind the lead; not three far apart, nor many."""
    import itertools
    import random

    rng = random.Random(3)
    base = [f"word{k}" for k in range(40)]

    def changed(*places):
        return " ".join(f"other{rng.randrange(10**6)}x" if k in places else w for k, w in enumerate(base)).translate(str.maketrans("0123456789", "abcdefghij"))

    pairs = [p for p in itertools.combinations(range(3, 40), 2)][::37]
    texts = [changed()] + [changed(*p) for p in pairs] + [changed(5, 18, 33), changed(*range(10, 30)), changed(0)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    dropped = {r["doc_id"]: r["n_dropped"] for r in line_dedup.deduplicated(docs).select("row.doc_id", "n_dropped").collect()}
    n = len(pairs)
    assert dropped == {0: 0} | {i + 1: 1 for i in range(n)} | {n + 1: 0, n + 2: 0, n + 3: 0}


def _kept_lines(texts, rule):
    """Documents' texts after a plain pass over lines in order, each against all lines kept so far."""
    import itertools

    def tokens(line):
        return tuple(line_dedup.WILDCARD if re.search(r"[0-9@]|://", w) else w for w in WORD.findall(line))

    def keys(t):
        n, out = len(t), []
        if n >= rule.fields:
            band = [(p - rule.lead) * rule.bands // (n - rule.lead) if p >= rule.lead else -1 for p in range(n)]
            for pair in itertools.combinations(range(rule.bands), 2):
                key = tuple(None if b in pair else w for w, b in zip(t, band, strict=True))
                if 5 * sum(w is None for w in key) <= n:
                    out.append((pair, key))
        return out

    holders, place = {}, {}
    for doc, text in sorted(texts):
        for k, line in enumerate(text.split("\n")):
            t = tokens(line)
            if t:
                holders.setdefault(t, set()).add(doc)
                place.setdefault(t, (doc, k))
    groups = {}
    for t in holders:
        for key in keys(t):
            groups.setdefault(key, set()).add(t)
    good = {key for key, ts in groups.items() if len(ts) > 1 and len(set().union(*(holders[t] for t in ts))) > 1}
    keeper = {t: place[t][0] for t, docs in holders.items() if len(docs) >= rule.min_docs and len(docs) * len(t) >= rule.evidence}
    kept = {}
    for t in sorted(holders, key=place.get):
        mine = [key for key in keys(t) if key in good]
        like = [kept[key] for key in mine if key in kept]
        if like:
            keeper[t] = min(like)
        else:
            kept |= {key: place[t][0] for key in mine}
    return {doc: "\n".join(x for x in text.split("\n") if keeper.get(tokens(x), doc) == doc) for doc, text in texts}


def test_a_chain_of_lines_keeps_what_no_kept_line_is_like(spark):
    base = [f"word{chr(97 + k)}" for k in range(23)]

    def step(k):  # each differs from the one before in two fields
        return " ".join(f"{w}x" if i in range(3, 3 + 4 * k, 2) else w for i, w in enumerate(base))

    texts = [(d, step(k)) for k, d in enumerate((2, 5, 7, 9))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(texts, "doc_id long, text string")).select("row.doc_id", "text").collect()}
    assert got == {2: texts[0][1], 5: "", 7: texts[2][1], 9: ""} == _kept_lines(texts, line_dedup.Templates())
    # a long chain needs many rounds
    line = " ".join(f"w{chr(97 + k // 20)}{chr(97 + k % 20)}" for k in range(103)).split()
    texts = [(d, " ".join(w + "x" if 3 <= i < 3 + 9 * d else w for i, w in enumerate(line))) for d in range(11)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(texts, "doc_id long, text string")).select("row.doc_id", "text").collect()}
    assert got == _kept_lines(texts, line_dedup.Templates()) and 2 < sum(t != "" for t in got.values()) < 11


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([3, 9, 10, 14, 25]))) for _ in range(12)]

    def line():
        words_ = rng.choice(lines).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words_[rng.randrange(len(words_))] = rng.choice(["q", "rr", "7", "a@b", "sss"])
        return " ".join(words_)

    texts = [(d, "\n".join(line() for _ in range(rng.randint(1, 6)))) for d in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).select("row.doc_id", "text").collect()}
    assert got == _kept_lines(texts, line_dedup.Templates())


def test_bands_cover_every_place(spark):
    from pyspark.sql import functions as F

    rule = line_dedup.Templates()
    for n in (10, 11, 13, 23, 57, 400):
        rows = spark.range(rule.bands + 1).select(line_dedup.band_start(F.col("id"), F.lit(n), rule).alias("b")).orderBy("id").collect()
        starts = [r["b"] for r in rows]
        got = [k for k in range(rule.bands) for _ in range(starts[k], starts[k + 1])]
        assert starts[0] == rule.lead and starts[-1] == n
        assert got == [(p - rule.lead) * rule.bands // (n - rule.lead) for p in range(rule.lead, n)]

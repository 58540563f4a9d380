"""Near-duplicates, BPE, the store, language-model scores and page texts on odd rows and against brute force."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkwarden.llm import bpe, content_store, html_text, lexicon, pitman_yor, simhash
from inkwarden.llm.labelled import labelled
from tests.llm.conftest import ROWS


# ---------------------------------------------------------------- SimHash


def _plain_fingerprint(text):
    w = [x for x in (text or "").encode().lower().split()]
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(fps: list[int]) -> list[int]:
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("seed", range(6))
def test_trie_join_against_all_pairs(seed):
    rng = random.Random(seed)
    keys = {rng.getrandbits(64) for _ in range(60)}
    for k in list(keys):
        for _ in range(rng.choice([0, 0, 3, 20])):
            for _ in range(rng.randint(1, 5)):
                k ^= 1 << rng.randrange(64)
            keys.add(k)
    keys = sorted(keys)
    got = simhash.trie_forest(np.zeros(len(keys), np.int64), np.array(keys, np.uint64))
    assert _same_partition(got.tolist(), _classes(keys))


def _same_partition(a, b) -> bool:
    pairs = set(zip(a, b))
    return len(pairs) == len(set(a)) == len(set(b))


def test_classes_on_odd_rows(odd):
    rows = simhash.classes(odd).collect()
    assert len(rows) == len(ROWS)
    fps = [_plain_fingerprint(r[1]) for r in ROWS]
    ids = [r[0] for r in ROWS]
    groups = defaultdict(list)
    for i, g in enumerate(_classes(fps)):
        groups[g].append(ids[i])
    want = Counter((ids[i], fps[i], min((x for x in groups[g] if x is not None), default=None)) for i, g in enumerate(_classes(fps)))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows) == want
    assert simhash.classes(odd.limit(0)).count() == 0
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter(d for d, _, c in want.elements() if d is None or d == c)


def test_chain_of_links_is_one_class(spark):
    # fingerprints on a line, each three bits from the next: far apart at the ends
    fps = [0]
    for i in range(20):
        fps.append(fps[-1] ^ (0b111 << (3 * i)))
    edges = simhash.links(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long"))
    from inkwarden.operators.graph import components

    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert len(roots) == len(fps) - 1 and len(set(roots.values())) == 1


# ---------------------------------------------------------------- lexicon and BPE


def test_lexicon_round_trip(tmp_path):
    rng = random.Random(3)
    words = {bytes(rng.choice(b"abc \xff\0") for _ in range(rng.randint(1, 7))) for _ in range(800)}
    words = list(words)
    ids = [[i, i + 1][: 1 + i % 2] for i in range(len(words))]
    (tmp_path / "l").write_bytes(lexicon.compile_lexicon(words, ids))
    lex = lexicon.Lexicon(str(tmp_path / "l"))
    probe = words + [w + b"a" for w in words[:50]] + [b"zz", b"\xff\xff\xff\xff\xff\xff\xff\xff\xff"]
    data = np.frombuffer(b"".join(probe), np.uint8)
    size = np.array([len(w) for w in probe])
    ranks = lex.ranks(data, np.cumsum(size) - size, size)
    known = dict(zip(words, ids))
    for w, r in zip(probe, ranks):
        assert (lex.words_ids(r).tolist() if r >= 0 else None) == known.get(w)
    states = {w[:i] for w in words for i in range(len(w) + 1)}
    assert len(lex.base) < len(states)  # suffixes are shared
    (tmp_path / "e").write_bytes(lexicon.compile_lexicon([], []))
    assert lexicon.Lexicon(str(tmp_path / "e")).ranks(data, np.zeros(1, int), np.ones(1, int)).tolist() == [-1]


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_against_the_library(tmp_path):
    library, own = _library(), bpe.Bpe(bpe.vocabulary_path())
    rng = random.Random(1)
    parts = list(" \t\n\r\x0b\x0c\x1c\x85\u00a0abcZ09'!.,é漢ß\u0301\u200b😀²Ⅷ") + ["<|endoftext|>", "'s", " the", "  ", "   ", "\u19157"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(30)) for _ in range(800)]
    words = [b" the", b" a", b" b'", " é".encode()]
    (tmp_path / "l").write_bytes(lexicon.compile_lexicon(words, [own.pretokens(w.decode()) for w in words]))
    lex = lexicon.Lexicon(str(tmp_path / "l"))
    for limit in (64, bpe.MEMO):  # memos that hardly hold a chunk, and one that holds all
        chunked = bpe.Chunked(lambda new: own.encode_new(new, lex), lambda ts: (np.array(own.encode(t), "<u4").tobytes() for t in ts), own.special, None if limit > 64 else lambda ids: (ids,), limit)
        for text, (got,), want in zip(texts, chunked.of(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, ascii(text)
    encoder = content_store.Encoder(bpe.vocabulary_path())
    for text, got, want in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, encoder.kind).tolist() == want.ids, ascii(text)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_long_words_are_merged_as_the_library_does():
    library, own, rng = _library(), bpe.Bpe(bpe.vocabulary_path()), random.Random(6)
    for n in (97, 98, 150, 1000, 40_000):
        for letters in ("ab", "aeionst", "aeioutnrsldmpchgb", "é漢ab"):
            word = "".join(rng.choice(letters) for _ in range(n))
            began = time.perf_counter()
            got = own.merged(word.encode())
            assert time.perf_counter() - began < 2
            assert got == library.encode(word, add_special_tokens=False).ids


def test_bpe_on_odd_rows(odd):
    library = _library()
    rows = bpe.digests(odd, ["doc_id"], with_ids=True).collect()
    want = Counter()
    for doc_id, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    assert bpe.digests(odd.limit(0), ["doc_id"]).count() == 0


# ---------------------------------------------------------------- the store


def test_store_on_odd_rows(odd, tmp_path):
    spark, path = odd.sparkSession, f"{tmp_path}/store"
    content_store.write_store(odd, path)
    library = _library()
    got = sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in content_store.read_back(spark, path).collect())
    want, start = [], 0
    for doc_id, text, *_ in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((start, -1 if doc_id is None else doc_id, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    some = content_store.reconstruct(spark, path, odd.where("doc_id IN (6, 7)").select("doc_id")).collect()
    texts = {r[0]: r[1] for r in ROWS}
    assert all(list(r["ids"]) == [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0] for r in some) and len(some) == 2
    content_store.write_store(odd.limit(0), f"{tmp_path}/none")
    assert content_store.read_back(spark, f"{tmp_path}/none").count() == 0


class _Counting:
    """A tokenizer that counts the characters it is asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, 0

    def encode_batch_fast(self, texts, **kw):
        self.asked += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **kw)


@pytest.mark.parametrize("memo", [0, 2000, content_store.MEMO])
def test_store_asks_once_for_a_word_with_any_signs(memo, monkeypatch):
    monkeypatch.setattr(content_store, "MEMO", memo)
    rng, library = random.Random(4), _library()
    words = ["".join(rng.choice("abcdefghijéñßжя漢0") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    signs = ["", ".", ",", "***", "'s", "'", "'s.", ")", " (", "\n", ".\n", "\n\n", "\n'", "\t", "\u0301.", "\u00a0", "\x1c", ".5", "://"]
    encoder = content_store.Encoder(bpe.vocabulary_path())
    encoder.tokenizer = counting = _Counting(encoder.tokenizer)
    for odd in ([], ["  ", "<|endoftext|>", " \n"]):
        texts = ["", *("".join(rng.choice(words) + rng.choice(signs + odd) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(400))]
        for text, got, want in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, encoder.kind).tolist() == want.ids, ascii(text)
    plain = [x for x in words if "漢" not in x]
    text = [" ".join(rng.choice(plain) + rng.choice([".", ",", ".\n", "\n", ",\n"]) + rng.choice(plain) for _ in range(3000)) for _ in range(2)]
    for i in range(2):
        counting.asked = 0
        assert encoder.encode(text[i : i + 1]) == [np.array(library.encode(text[i]).ids, encoder.kind).tobytes()]
        assert counting.asked < 2000


def test_broken_chunk_is_found(spark, tmp_path):
    path = f"{tmp_path}/store"
    content_store.write_store(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), path)
    broken = [(bytes(r["digest"]), b"\1\0") for r in spark.read.parquet(f"{path}/chunks").collect()]
    spark.createDataFrame(broken, "digest binary, payload binary").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="does not match"):
        content_store.read_back(spark, path).collect()


def test_every_level_of_the_tree_is_checked(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some text of number {i}") for i in range(9)], "doc_id long, text string")
    for name in ("recipes", "manifest", "root"):
        path = f"{tmp_path}/{name}"
        content_store.write_store(docs, path)
        assert content_store.read_back(spark, path).count() == 9
        rows = spark.read.parquet(f"{path}/{name}")
        bad = rows.withColumn("root", F.unhex(F.lit("00" * 16))) if name != "recipes" else rows.withColumn("digests", F.reverse(F.concat("digests", "digests"))).withColumn("after", F.concat("after", "after"))
        spark.createDataFrame(bad.collect(), rows.schema).write.mode("overwrite").parquet(f"{path}/{name}")
        with pytest.raises(Exception, match="match"):
            content_store.read_back(spark, path).collect()


def test_cuts_depend_on_content_only():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 50_000, 6000)
    a, b = np.r_[rng.integers(0, 50_000, 777), passage], np.r_[rng.integers(0, 50_000, 90), passage]
    both = np.r_[a, b]
    ends = np.array([len(a), len(both)])
    found = content_store.cuts(both, np.r_[0, ends[:-1]], ends)
    chunks = [{both[s:e].tobytes() for s, e in zip([begin, *f], f)} for begin, f in zip([0, len(a)], found)]
    assert len(chunks[0] & chunks[1]) >= 0.6 * len(chunks[0])
    for begin, f in zip([0, len(a)], found):
        sizes = np.diff([begin, *f])
        assert sizes.max() <= content_store.MOST and (sizes[:-1] >= content_store.LEAST).all()


def test_crc_of_parts():
    tables = content_store.shift_tables()
    rng = random.Random(2)
    for _ in range(50):
        parts = [rng.randbytes(rng.randrange(0, 300)) for _ in range(rng.randint(1, 5))]
        after = np.array([sum(map(len, parts[i + 1 :])) for i in range(len(parts))])
        crc = content_store.shifted(np.array([zlib.crc32(p) for p in parts], np.uint32), after, tables)
        assert int(np.bitwise_xor.reduce(crc)) == zlib.crc32(b"".join(parts))


# ---------------------------------------------------------------- language model


def test_scores_on_odd_rows(odd):
    rows = pitman_yor.scores(odd).collect()
    counts = Counter()
    for doc_id, text, *_ in ROWS:
        if not pitman_yor.held_out(doc_id):
            counts.update(pitman_yor.tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for doc_id, text, *_ in ROWS:
        w = pitman_yor.tokens(text)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want[doc_id, pitman_yor.held_out(doc_id), len(w), sum(counts[x] > 0 for x in w), n, round(base, 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert pitman_yor.scores(odd.limit(0)).count() == 0


def test_predictions_sum_to_one():
    """Over all training tokens and the unknown, in every restaurant."""
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64))
    pairs = rng.integers(1, 4, 40).astype(np.uint32)
    contexts = np.concatenate([np.sort(rng.choice(5, k, replace=False)) for k in pairs]).astype(np.uint16)
    customers = rng.integers(1, 400, len(contexts))
    d = pitman_yor.Dishes(0, hashes, pairs, contexts, customers)
    history = []
    for _ in range(pitman_yor.SWEEPS + 1):
        t, c, r = list(pitman_yor.chain(d, history))[-1]
        assert (t >= 1).all() and (t <= customers).all() and (r >= 1).all() and (r <= c).all()
        found = {i: (int(customers[contexts == i].sum()), int(t[contexts == i].sum())) for i in range(5)}
        found |= {pitman_yor.CONTEXTS + i: (int(x), 0) for i, x in enumerate([customers.sum(), 40, (customers == 1).sum(), (customers == 2).sum(), c.sum(), r.sum(), (c == 1).sum(), (c == 2).sum()])}
        history.append(pitman_yor.exchanged(found, history[0] if history else None))
    p = pitman_yor.Predictor(d, history)
    for u in (0, 3, 400):
        one, _ = p.of(np.r_[hashes, np.uint64(5)], np.ones(41, np.uint32), np.full(41, u, np.uint16))
        assert one.sum() == pytest.approx(1, abs=1e-9)


def test_stirling_numbers_against_seatings():
    """S(c, t) sums the weights of all seatings of c customers at t tables."""
    d = 0.4

    def seatings(c):
        found = Counter({(1,): 1.0})
        for _ in range(c - 1):
            after = Counter()
            for sizes, w in found.items():
                after[(*sizes, 1)] += w
                for i, n in enumerate(sizes):
                    after[(*sizes[:i], n + 1, *sizes[i + 1 :])] += w * (n - d)
            found = after
        return found

    table = pitman_yor.log_stirling(d)
    for c in range(1, 7):
        by = Counter()
        for sizes, w in seatings(c).items():
            by[len(sizes)] += w
        for t, w in by.items():
            assert table[c, t] == pytest.approx(math.log(w))


def test_model_beats_its_base_on_held_out_texts(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    after = {w: rng.sample(words, 4) for w in words}

    def text():
        w, out = rng.choice(words), []
        for _ in range(60):
            out.append(w)
            w = rng.choice(after[w])
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    scored = pitman_yor.scores(docs).cache()
    assert pitman_yor.perplexity(scored) < 0.5 * pitman_yor.perplexity(scored, "base_score")


# ---------------------------------------------------------------- pages


def test_tree_on_pages_it_has_not_seen():
    tree, right, n = html_text.trained(), 0, 0
    for page, labels in html_text.labelled_pages(200, seed=123):
        found = html_text.blocks(page)
        right += sum(html_text.judge(tree, r) == y for r, y in zip(html_text.matrix(found).tolist(), labels, strict=True))
        n += len(labels)
    assert right / n > 0.98


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        ("<article><h1>T&amp;C</h1><p>a <b>b</b>\n c<br>d</article>", "T&C\n\na b c d"),
        ("<nav><a href=x>Home</a></nav><article><p>Short.</p></article><footer>&copy; x</footer>", "Short."),
        ("<article><p>One.</p><script>var a='</p>'</script><style>p{}</style><!-- no --><p>Two &#228;&lt;b&gt;</p>", "One.\n\nTwo ä<b>"),
        ("<main><p>Text of it.</p><form><label>Name</label></form><div class='ad'>Buy now</div></main><section id='comments'><p>Nice one</p></section>", "Text of it."),
        ('<div class="cookie-notice">We use cookies</div><div class="content"><p>Body here.</p></div><aside>More</aside>', "Body here."),
        ("<p>unclosed <!-- comment", "unclosed"),
        ("<p title='a>b'>x</p", "x"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page, html_text.trained()) == text


_ARTICLE = "<h1>+Crane for the harbour</h1><p>+The council met on Tuesday and agreed on the plan for the harbour, after a long debate.</p><p>+Nobody objected to the new crane, which will be delivered in the spring of next year.</p>"
_TOP, _END = "<ul class='menu'><li><a href=1>Home</a></li><li><a href=2>News of the town</a></li></ul>", "<div class='footer'><p>All rights reserved by the paper.</p></div>"


@pytest.mark.parametrize("name", ["related-news story", "tabs-content", "social-post", "ad-free article", "search-and-rescue article", "story-promotion-of-peace", "menu-planning", "notice-board-feature", "popular-science", "reply-to-critics entry"])
def test_no_word_of_a_name_loses_an_article(name):
    for page in (f"<html><body>{_TOP}<div class='{name}'>{_ARTICLE}</div>{_END}</body></html>", f"<html><body>{_TOP}<div id='{name.split()[0]}'><div>{_ARTICLE}</div></div>{_END}</body></html>"):
        text, labels = labelled(page)
        assert html_text.main_text(text, html_text.trained()) == "\n\n".join(b.text for b, y in zip(html_text.blocks(text), labels, strict=True) if y)


#: Pages labelled as in ``labelled``: articles under doubtful names, and doubtful names that are right.
_HELD_OUT = (
    f"<html><body><form id='aspnetForm'>{_TOP}<div class='search-box'><p>Search the archive of the paper</p></div><div id='ctl00'>{_ARTICLE}</div>{_END}</form></body></html>",
    f"<html><body>{_TOP}<div class='tabs-content'>{_ARTICLE}<div class='related-stories'><p>A crane fell in the other harbour, too, some years ago.</p><a href=3>The old crane</a></div></div><div class='comments'><h3>Two readers wrote</h3><p>We have had no crane for years.</p><p>Good.</p></div>{_END}</body></html>",
    f"<html><body>{_TOP}<div class='c1'>{_ARTICLE}<h2>3 Comments</h2><p>I do not think that the crane is needed at all, as I have said here before.</p><p>Well, I do like cranes very much.</p><p>So do I.</p></div>{_END}</body></html>",
    f"<html><body>{_TOP}<div>{_ARTICLE}<h2>+Comment from the mayor</h2><p>+The mayor said that the crane would be painted blue, like the old one was.</p><h3>Leave a reply</h3><p>Your address will not be shown to any other reader.</p></div>{_END}</body></html>",
    f"<html><body>{_TOP}<div class='social-post-body'>{_ARTICLE}<div class='comment-body'><p>Why not green, as in the other harbour across the water?</p></div><h4>Kommentare (2)</h4><p>Blau ist doch eine sehr gute Farbe für einen Kran.</p></div><div class='ad-unit-7'><p>Paint of all colours at half the price until Sunday.</p></div></body></html>",
    f"<html><body><div id='sidebar-right' class='layout'>{_TOP}<div class='entry'>{_ARTICLE}</div><div class='sidebar'><p>About this paper: it has been printed every Friday for two hundred years.</p></div>{_END}</div></body></html>",
    f"<html><body>{_TOP}<section class='story'>{_ARTICLE}<p>+It cost less than was feared.</p></section><section><h2>Réponses</h2><div><p>Une grue bleue, voilà une bonne idée pour notre port.</p></div></section><div class='story-share'><p>Tell your friends of this article today.</p></div></body></html>",
)


def test_pages_labelled_by_hand_that_the_tree_has_not_seen():
    tree, right, n = html_text.trained(), 0, 0
    for page in _HELD_OUT:
        text, labels = labelled(page)
        found = html_text.blocks(text)
        got = [html_text.judge(tree, r) for r in html_text.matrix(found).tolist()]
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        n += len(labels)
    assert right / n >= 0.95


def test_nested_pages_take_linear_time():
    import time

    tree = html_text.trained()
    took = []
    for n in (16_000, 64_000):
        began = time.process_time()
        for page in ("<div>" * n + "text", "<div>" * n + "</p></span></ul>" * n, "<ul><li>" * n + "</table>" * n):
            html_text.main_text(page, tree)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5 and took[0] < 5


def test_main_text_query(spark):
    pages = spark.createDataFrame([(1, "u", "<article>" + "<p>Some words.</p>" * 3000), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    rows = html_text.main_texts(pages, ["page_id", "url"]).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 0, 3000 * 11 + 2999 * 2]
    assert html_text.main_texts(pages.limit(0), ["page_id"]).count() == 0

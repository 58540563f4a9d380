"""The near-duplicate stage against brute-force Jaccard similarity."""

import random
from itertools import combinations

from inkwarden.llm import simhash


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_representatives_against_jaccard(spark):
    rng = random.Random(8)
    common = " ".join(f"c{k}" for k in range(60))
    texts = ["", "one two", "one two", "three"]
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 200))]
        for changes in (0, 0, 1, 2, 4, 6, 9):
            words = list(base)
            for _ in range(changes):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(words))
        texts.append(" ".join(base[: len(base) // 2]) + " " + common)
    sets = [_shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    far = 0
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            up[b] = a
            far += (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in simhash.representatives(docs).collect())
    assert kept == [i for i in range(len(texts)) if root(i) == i]
    assert far > 10  # links that three bits do not find


def test_hot_tries_are_dealt_again(spark):
    """However small a trie must be, the classes are those of all pairs."""
    from inkwarden.operators.graph import components
    from tests.llm.test_texts import _classes

    rng = random.Random(5)
    keys = {rng.getrandbits(64) for _ in range(30)}
    for centre in list(keys)[:4]:
        for _ in range(60):
            k = centre
            for _ in range(rng.randint(1, 6)):
                k ^= 1 << rng.randrange(64)
            keys.add(k)
    keys = sorted(keys)
    rows = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "fp long")
    want = _classes(keys)
    for hot in (12, 1 << 20):
        assert hot > 12 or simhash.tries(rows, hot).select("mask").distinct().count() > 4
        roots = {r["node"]: r["root"] for r in components(simhash.links(rows, hot)).collect()}
        got = [roots.get(k - (1 << 64) if k >> 63 else k, k - (1 << 64) if k >> 63 else k) for k in keys]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_dense_tries_end_soon():
    import time

    import numpy as np

    rng = random.Random(9)
    centre = rng.getrandbits(64)
    keys = set()
    while len(keys) < 6000:
        k = centre
        for _ in range(rng.randint(1, 4)):
            k ^= 1 << rng.randrange(64)
        keys.add(k)
    began = time.perf_counter()
    up = simhash.trie_forest(np.zeros(len(keys), np.int64), np.array(sorted(keys), np.uint64))
    assert time.perf_counter() - began < 8
    assert len(set(up.tolist())) == 1


def test_common_passage_with_little_beside_it(spark):
    """Documents that are mostly one passage, with own words of many lengths: links as by brute force, and few pairs across."""
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(100)]
    texts = [" ".join(passage)]
    for i in range(150):
        own = [f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(0, 45))]
        texts.append(" ".join((own + passage) if i % 2 else (passage + own)))
    for i in range(0, 20, 2):
        texts.append(texts[i + 40] + f" z{i}")
    sets = [_shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_classes(docs).collect()}
    assert got == {i: root(i) for i in range(len(texts))} and len(set(got.values())) > 10


def test_classes_begin_with_fingerprints(spark):
    rng = random.Random(21)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    texts = [base, base + " more", base + " other", "alone " + " ".join(f"v{k}" for k in range(50))]
    assert all((simhash.fingerprint(base) ^ simhash.fingerprint(t)).bit_count() <= 3 for t in texts[:3])
    keyed = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "key long, text string")
    named = spark.createDataFrame([(k, simhash.set_id(simhash.shingle_set(t))) for k, t in enumerate(texts)], "key long, sid long")
    sids = sorted(r["sid"] for r in named.where("key < 3").collect())
    told = simhash.fingerprint_pairs(keyed, named)
    assert sorted(map(tuple, told.collect())) == [(sids[0], sids[1]), (sids[0], sids[2])]
    sets = simhash.whole_sets(keyed)
    heads = spark.createDataFrame([], "h long, sid long, n int, slack int")
    got = simhash.jaccard_links(heads, sets, told).distinct().count()
    assert got == 2  # no shingle told of them

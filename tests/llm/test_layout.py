"""Whitening, the Merkle manifest and sharding against brute force, on odd rows and any layout."""

import random
from collections import Counter, defaultdict
from hashlib import md5, sha256
from math import floor, isfinite
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwarden.llm import manifest, sharding, whitening
from tests.llm.conftest import ROWS

# ---------------------------------------------------------------- whitening


def _whole(vector):
    return tuple(floor(256 * float(c)) for c in vector)


def _vectors(rng, n, dim):
    mix = rng.normal(size=(dim, dim))
    return [(mix @ rng.normal(size=dim)).astype(np.float32).tolist() for _ in range(n)]


@pytest.mark.parametrize("dim", [1, 2, 3, 7, 64, 150])
def test_symmetric_qr(dim):
    rng = np.random.default_rng(dim)
    for rank in {dim, max(1, dim // 3)}:
        a = rng.normal(size=(dim, rank))
        a = a @ a.T
        values, q = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * values[0])
        assert np.abs(q @ q.T - np.eye(dim)).max() < 1e-12
        assert np.abs(q.T @ np.diag(values) @ q - a).max() < 1e-12 * max(values[0], 1)


@pytest.mark.parametrize("matrix", [np.zeros((4, 4)), np.eye(5), np.ones((6, 6)), np.diag([3.0, 1.0, 2.0]), np.array([[2.0, 1e-200], [1e-200, 1.0]])])
def test_symmetric_qr_of_special_matrices(matrix):
    values, q = whitening.symmetric_qr(matrix)
    assert np.abs(q.T @ np.diag(values) @ q - matrix).max() < 1e-14 and all(values[:-1] >= values[1:])


def test_merged_moments_are_those_of_the_whole():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, size=(501, 6))
    parts = [whitening.Moments.empty(6) for _ in range(5)]
    for k, m in enumerate(parts[1:]):  # the first stays empty
        m.add(x[k::4])
    whole = parts[0]
    for m in parts[1:]:
        whole = whole.merge(m)
    assert whole.n == len(x) and np.allclose(whole.mean, x.mean(axis=0), rtol=1e-13)
    assert np.allclose(whole.covariance, np.cov(x.T, bias=True), rtol=1e-12)


def _check(rows, found, components=4):
    """Whitened rows against a plain eigen-decomposition of the distinct whole-number vectors."""
    good = [(i, _whole(v)) for i, v in rows if v is not None and v and all(c is not None and isfinite(c) for c in v)]
    for dim in {len(x) for _, x in good}:
        mine = [(i, x) for i, x in good if len(x) == dim]
        fit = sorted({x for _, x in mine})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        values, vectors = np.linalg.eigh(np.cov(np.array(fit, dtype=float).T, bias=True).reshape(dim, dim))
        values, vectors = values[::-1][:components], vectors.T[::-1][:components]
        by_row = defaultdict(list)
        for r in found:
            by_row[r["vec_id"]].append(r)
        signs = np.zeros(len(values))
        assert Counter(r["component"] for i, _ in mine for r in by_row[i]) == {k + 1: sum(1 for _ in mine) for k in range(len(values))}
        for i, x in mine:
            for r in by_row[i]:
                k = r["component"] - 1
                assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
                assert r["explained"] == pytest.approx(values[k] / np.trace(np.cov(np.array(fit, dtype=float).T, bias=True).reshape(dim, dim)), rel=1e-9)
                want = (np.array(x) - np.array(sums) / n) @ vectors[k] / np.sqrt(values[k])
                signs[k] = signs[k] or np.sign(want * r["whitened"]) if abs(want) > 1e-6 else signs[k]
                assert r["whitened"] == pytest.approx((signs[k] or 1) * want, abs=1e-7)
                assert r["identity_error"] < 1e-9


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = _vectors(rng, 300, 7)
    rows = list(enumerate([*base, *base[:40], base[0], [base[0][0] + 1e-7, *base[0][1:]], None, [None] * 7, [float("nan"), *base[1][1:]], [float("inf"), *base[2][1:]], []]))
    for partitions in (1, 40):  # more than FAN states are merged in a tree
        df = spark.createDataFrame(rows, "vec_id int, embedding array<float>").repartition(partitions)
        _check(rows, whitening.whitened(df).select("row.vec_id", "*").collect())


def test_many_states_merge_in_a_tree(spark):
    rows = list(enumerate(_vectors(np.random.default_rng(11), 120, 3)))
    x = spark.createDataFrame(rows, "vec_id int, v array<double>").repartition(60).select(whitening.quantised(F.col("v")).alias("x"))
    found = whitening.merged(x)
    fit = np.array([_whole(v) for _, v in rows])
    assert found[3].n == 120 and found[3].sums == fit.sum(axis=0).tolist() and np.allclose(found[3].covariance, np.cov(fit.T, bias=True), rtol=1e-12)


def test_vectors_of_two_lengths_are_two_spaces(spark):
    rng = np.random.default_rng(6)
    rows = list(enumerate([*_vectors(rng, 50, 3), *_vectors(rng, 60, 5)]))
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).select("row.vec_id", "*").collect()
    _check(rows, found)


def test_whitening_without_variance(spark):
    schema = "vec_id int, embedding array<float>, x string, n int, component string, row string"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(k, [0.5, 0.25], "x", 1, "c", "r") for k in range(3)], schema)
    found = whitening.whitened(same).collect()
    assert len(found) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in found} == {(1, 0, None, None)} and found[0]["row"]["x"] == "x"
    line = spark.createDataFrame([(k, [k / 256, 2 * k / 256], "x", 1, "c", "r") for k in range(9)], schema)
    found = {(r["row"]["vec_id"], r["component"]): r for r in whitening.whitened(line).collect()}
    assert all((found[k, 2]["whitened"], found[k, 2]["explained"]) == (None, 0.0) for k in range(9)) and found[0, 1]["explained"] == pytest.approx(1)
    assert abs(found[8, 1]["whitened"]) == pytest.approx(4 / np.sqrt(60 / 9))
    large = spark.createDataFrame([(k, [k * 1e15, 1e300], "x", 1, "c", "r") for k in range(3)], "vec_id int, embedding array<double>, x string, n int, component string, row string")
    assert {r["deviation"] for r in whitening.whitened(large).collect()} <= {None, 0}


# ---------------------------------------------------------------- manifest


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def _proof(levels, place):
    steps = []
    for nodes in levels[:-1]:
        first = place - place % 3
        steps.append((nodes[first:place], nodes[place + 1 : first + 3]))
        place //= 3
    return steps


def _fold(start, steps):
    for left, right in steps:
        start = H(*left, start, *right)
    return start


def _manifest(rows):
    """Multiset of (doc_id, leaf, subroot, root, proof digest, folded root, verified); rows: doc_id, source, lang, n_chars, text."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(((r[0] is not None, r[0] or 0, _leaf(r)), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([x[0][2] for x in sorted(groups[s], key=lambda x: x[0])]) for s in names}
    upper = _levels([trees[s][-1][0] for s in names])
    out = Counter()
    for at, s in enumerate(names):
        for place, (key, r) in enumerate(sorted(groups[s], key=lambda x: x[0])):
            steps = _proof(trees[s], place) + _proof(upper, at)
            bad = r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            end = _fold(_leaf((*r[:4], r[4].replace("\n", ""))) if bad else key[2], steps)
            out[r[0], key[2], trees[s][-1][0], upper[-1][0], H(*(d for left, right in steps for d in (*left, *right))), end, end == upper[-1][0]] += 1
    return out


def _op12(docs, tree, monkeypatch):
    monkeypatch.setattr(manifest, "read", lambda *_: docs)
    whole = manifest.manifest
    monkeypatch.setattr(manifest, "manifest", lambda *a, **k: whole(*a, **k, tree=tree))
    return Counter(map(tuple, manifest.op12_manifest(None, "").collect()))


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _rows(rng, n):
    return [(k if rng.random() < 0.98 else None, rng.choice([None, "", "a", "a", "a", "a", "é", "\U0001f600", "￿", f"s{k % 7}"]), rng.choice(["en", None]), rng.choice([k, None]), rng.choice([None, "", "a\nb", f"text {k}", "\n\n é"])) for k in range(n)]


@pytest.mark.parametrize("tree", [manifest.Tree(), manifest.Tree(9, 2), manifest.Tree(20, 3)])
def test_manifest_against_brute_force(spark, monkeypatch, tree):
    rows = _rows(random.Random(tree.chunk), 700)
    rows += rows[:50] + [(7, "a", "en", 1, "same\nrow")] * 40
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in ("g", "leaf", "root", "key", "id", "place")})
    assert _op12(docs, tree, monkeypatch) == _manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 28])
def test_manifest_of_few_rows(spark, monkeypatch, n):
    rows = [(k, "s", "en", k, f"row {k}\n") for k in range(n)]
    assert _op12(spark.createDataFrame(rows, SCHEMA), manifest.Tree(9, 2), monkeypatch) == _manifest(rows)


def test_manifest_proofs_are_returned(spark, odd):
    found = manifest.manifest(odd).collect()
    assert len(found) == len(ROWS) and all(r["verified"] for r in found)
    for r in found:
        steps = [(s["left"], s["right"]) for s in r["path"]]
        assert manifest.folded(r["leaf"], steps) == r["root"] and len({len(left) + len(right) for left, right in steps} - {0, 1, 2}) == 0


# ---------------------------------------------------------------- sharding


def _documents(rng, sources):
    rows = [(k, rng.choice(["", None, "é" * rng.randrange(9), "same text"]), s) for k, s in enumerate(s for s, n in sources.items() for _ in range(n))]
    rng.shuffle(rows)
    return rows


def _order(rows, rule):
    """Places by a plain sort by fractional rank."""
    groups = defaultdict(list)
    for doc_id, text, source in rows:
        raw = (text or "").encode()
        perm = int(md5(f"{rule.seed}:{'-' if doc_id is None else doc_id}:{len(raw) + 1}:{crc32(raw)}".encode()).hexdigest()[:15], 16)
        groups[source].append((perm, doc_id, len(raw) + 1, crc32(raw)))
    out = []
    for source, found in groups.items():
        found.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2]))
        out += [((2 * r + 1) / (2 * len(found)), "n" if source is None else "s" + source, r, *x[1:]) for r, x in enumerate(found)]
    return sorted(out, key=lambda x: (x[0], x[1].encode(), x[2]))


@pytest.mark.parametrize("range_rows", [4096, 16])
@pytest.mark.parametrize("sources", [{"a": 500, "b": 250, None: 125, "c": 60, "d": 3, "e": 1}, {"a": 5}, {None: 1, "": 16}])
def test_sharding_against_brute_force(spark, sources, range_rows):
    rows, rule = _documents(random.Random(4), sources), sharding.Shards(range_rows=range_rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    kept = sharding.plan(docs, rule).collect()
    found = sorted((r["pos"], r["g"], r["rank"], r["doc_id"], r["size"], r["text_crc32"]) for r in kept)
    assert found == [(k, *x[1:]) for k, x in enumerate(_order(rows, rule))]
    counts = Counter(r["shard"] for r in kept)
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(8)) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in kept if r["shard"] == shard) == list(range(n))
        for source, all_rows in sources.items():  # the mixture of the whole, to a row for the cut at either end
            assert abs(sum(r["source"] == source for r in kept if r["shard"] == shard) - all_rows / 8) <= 2


def test_sharded_documents_keep_rows_and_columns(spark, odd):
    out = sharding.sharded_documents(odd, sharding.Shards(shards=3))
    assert out.columns == odd.columns and sharding.plan(odd.limit(0)).count() == 0 and sharding.sharded_documents(odd.limit(0)).count() == 0
    assert Counter(map(tuple, out.select("doc_id", "text", "row").collect())) == Counter(map(tuple, odd.select("doc_id", "text", "row").collect()))
    plan = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.plan(odd, sharding.Shards(shards=3)).collect()}
    placed = out.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), F.spark_partition_id().alias("at")).collect()
    assert all(plan[r["doc_id"], r["crc"]] == r["at"] for r in placed if r["doc_id"] != 9)


def test_a_shard_is_the_same_in_any_layout(spark):
    rows = _documents(random.Random(9), {"a": 300, "b": 20, None: 50})
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, second = (sorted(map(tuple, sharding.plan(docs.repartition(k), sharding.Shards(range_rows=r)).select("doc_id", "shard", "slot").collect())) for k, r in ((1, 8), (23, 4096)))
    assert first == second

"""The number of tables is sampled over its whole range."""

import math

import numpy as np
import pytest

from inkwarden.llm import pitman_yor


def _exact(c, d):
    """log S(c, t) for t from 1 to c."""
    row = np.full(c + 2, -np.inf)
    row[0] = 0.0
    for n in range(c):
        after = np.full(c + 2, -np.inf)
        with np.errstate(divide="ignore"):
            after[1:] = np.logaddexp(row[:-1], row[1:] + np.log(np.maximum(n - d * np.arange(1, c + 2), 0.0)))
        row = after
    return row[1 : c + 1]


@pytest.mark.parametrize("d", [0.2, 0.6, 0.85])
@pytest.mark.parametrize(("c", "others", "base"), [(2, 40, 0.1), (60, 900, 0.05), (700, 3000, 0.05), (700, 300, 0.001), (700, 30, 0.9)])
def test_tables_follow_their_conditional(c, d, others, base):
    t = np.arange(1, c + 1)
    w = _exact(c, d) + np.cumsum(np.log(1 + d * (others + t - 1))) + t * math.log(base)
    p = np.exp(w - w.max())
    p /= p.sum()
    mean, deviation = p @ t, math.sqrt(max(p @ t**2 - (p @ t) ** 2, 0))
    rng, n = np.random.default_rng(3), 600
    got = np.ones(n, np.int64)
    for _ in range(15):  # as many moves as a chain makes
        got = pitman_yor.gibbs(rng, np.full(n, c), got, d, np.full(n, others), np.full(n, base))
    assert got.min() >= 1 and got.max() <= c
    assert abs(got.mean() - mean) < 0.2 * deviation + 0.02
    assert 0.8 * deviation - 0.02 < got.std() < 1.2 * deviation + 0.02


def test_frequent_dishes_pass_sixteen_tables():
    d = pitman_yor.Dishes(0, np.arange(3, dtype=np.uint64), np.ones(3, np.uint32), np.zeros(3, np.uint16), np.array([9_000, 200_000, 3]))
    now = pitman_yor.Exchange(np.r_[209_003, np.zeros(511, int)], np.r_[5_000, np.zeros(511, int)], 209_003, 3, 3, 3, 0.7, 0.5)
    t, c, r = list(pitman_yor.chain(d, [now]))[-1]
    assert t[0] > 100 and t[1] > 100 and 1 <= t[2] <= 3 and (c == t).all() and (r <= c).all()


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few, many = ({r["doc_id"]: tuple(r) for r in pitman_yor.scores(docs.repartition(n, "text")).collect()} for n in (3, 40))
    assert few == many and len(few) == docs.count()


def test_ids_of_any_type(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([("a-1", "one two three"), ("b", "one two"), (None, None)], "doc_id string, text string")
    rows = pitman_yor.scores(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["None", "a-1", "b"]
    assert all(r["held_out"] == pitman_yor.held_out(r["doc_id"]) for r in rows)
    days = spark.range(3).select(F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("doc_id"), F.lit("w x").alias("text"))
    assert pitman_yor.scores(days).schema["doc_id"].dataType.simpleString() == "date" and pitman_yor.scores(days).count() == 3


def test_restaurants_against_enumerated_seatings():
    """The tables of a small restaurant under its parent: the chain's frequencies against all joint states.

    One restaurant, two dishes, the parent's seating included; the parent falls back to a uniform choice.
    """
    d, d0 = 0.5, 0.4
    customers = np.array([4, 2])
    types = 2
    theta = pitman_yor.CONCENTRATION

    def rising(discount, tables):
        return sum(math.log(theta + discount * k) for k in range(1, tables))

    states, weights = [], []
    for t1 in range(1, 5):
        for t2 in range(1, 3):
            for r1 in range(1, t1 + 1):
                for r2 in range(1, t2 + 1):
                    w = rising(d, t1 + t2) + _exact(4, d)[t1 - 1] + _exact(2, d)[t2 - 1]
                    w += rising(d0, r1 + r2) + _exact(t1, d0)[r1 - 1] + _exact(t2, d0)[r2 - 1]
                    w += (r1 + r2) * math.log(1 / (types + 1)) - sum(math.log(theta + k) for k in range(1, t1 + t2))
                    states.append((t1, t2))
                    weights.append(w)
    p = np.exp(np.array(weights) - max(weights))
    p /= p.sum()
    want = sum(q * np.array(s) for q, s in zip(p, states))
    # many copies of the restaurant, each with dishes of its own, updated one dish after the other
    n, rng = 4000, np.random.default_rng(8)
    t, r = np.ones((n, 2), np.int64), np.ones((n, 2), np.int64)
    total = np.zeros(2)
    for sweep in range(60):
        for k in (0, 1):
            others, others_root = t[:, 1 - k], r[:, 1 - k]
            # a table more in the restaurant is a customer more in the parent, under this dish
            c = customers[k]
            options = []
            for x in range(1, c + 1):
                for y in range(1, x + 1):
                    w = _exact(c, d)[x - 1] + _exact(x, d0)[y - 1] + y * math.log(1 / (types + 1))
                    free = sum(np.log(theta + d * (others + i)) for i in range(x))
                    up = sum(np.log(theta + d0 * (others_root + i)) for i in range(y)) - sum(np.log(theta + others + i) for i in range(x))
                    options.append((x, y, w + free + up))
            w = np.array([o[2] for o in options])
            w = np.cumsum(np.exp(w - w.max(axis=0)), axis=0)
            pick = (w[:-1] < rng.random(n) * w[-1]).sum(axis=0)
            t[:, k], r[:, k] = (np.array([o[i] for o in options])[pick] for i in (0, 1))
        if sweep >= 20:
            total += t.mean(axis=0) / 40
    assert np.abs(total - want).max() < 0.02  # the joint law that the operator's conditionals come from
    # the operator's own chain, restaurants independent, totals exchanged between sweeps
    m = 600
    dishes = pitman_yor.Dishes(0, np.arange(2, dtype=np.uint64), np.full(2, m, np.uint32), np.tile(np.arange(m, dtype=np.uint16), 2), np.repeat(customers, m))
    history, mean = [], np.zeros(2)
    for sweep in range(12):
        tables, c, r_ = list(pitman_yor.chain(dishes, history))[-1]
        per = np.bincount(dishes.contexts, tables, m).astype(int)
        history.append(pitman_yor.Exchange(np.full(m, 6), per, 6 * m, types, int(c.sum()), int(r_.sum()), d, d0))
        if sweep >= 4:
            mean += [tables[:m].mean() / 8, tables[m:].mean() / 8]
    # under a parent that many restaurants feed, its probability of a dish is c / (c1 + c2), nearly
    base = np.array([c[0], c[1]]) / c.sum()
    states, weights = [], []
    for t1 in range(1, 5):
        for t2 in range(1, 3):
            states.append((t1, t2))
            weights.append(rising(d, t1 + t2) + _exact(4, d)[t1 - 1] + _exact(2, d)[t2 - 1] + t1 * math.log(base[0]) + t2 * math.log(base[1]))
    p = np.exp(np.array(weights) - max(weights))
    p /= p.sum()
    want = sum(q * np.array(s) for q, s in zip(p, states))
    assert np.abs(mean - want).max() < 0.12


def test_what_is_packed_grows_with_the_occurrences_alone(spark):
    """Neither batches nor buckets repeat what is known of documents."""
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2000)).cast("string")) for k in range(30)]).alias("text"))
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in ("docs", "contexts", "held", "lengths")), F.lit(0))
    bytes_ = {n: pitman_yor.packed(docs.coalesce(1), n).agg(F.sum(size)).first()[0] for n in (16, 256, 4096)}
    assert len(set(bytes_.values())) == 1  # four bytes an occurrence, nine a document
    occurrences = 3000 * 31
    assert bytes_[16] == 4 * occurrences + 9 * 3000

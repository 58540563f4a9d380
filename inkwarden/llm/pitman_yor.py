"""Language-model scores by a hierarchical Pitman-Yor model.

Tokens are the lower-cased words of a text, then one end. A token is drawn in the
restaurant of its context, the whole word before it, dealt by hash to ``CONTEXTS``
restaurants (words that share one are one context). All restaurants share one
parent, where every table is a customer, and the parent falls back to a uniform
choice of the V + 1 training tokens and the unknown. Discounts come from the
counts of counts.

Seating is sampled by Gibbs. For each dish of each restaurant the state is its
customers and tables; a move draws the tables anew from their distribution given
everything else, over the whole range (generalised Stirling numbers, tabulated to
256 customers; beyond, Metropolis steps of all scales by a saddle point). Dishes are
dealt by token, so a dish's tables in all restaurants and its seating in the
parent meet in one task; the restaurants' table totals, ``CONTEXTS`` numbers,
are exchanged between sweeps. Chains are seeded by bucket, so a task replays
its chain from the totals exchanged so far and no state is kept between jobs.
There are as many buckets as the texts' characters ask for, whatever the partitions,
and a document's sums are added up in the order of buckets: scores are the same for
any layout of the input.
Predictive probabilities are averaged over the samples after the burn-in, and
the score is the sum of their logarithms.

Everything is counted over all texts. The texts are read once: a task turns its
documents into packed occurrences (token hashes, with the context and document
of each occurrence) dealt to buckets by token. Counting first adds up inside
each packed row, so a word in every document arrives as a few numbers per task;
scoring splits buckets that hold more than their share. A document's score is
the sum of its buckets' partial sums. What the driver holds is bounded by
``CONTEXTS``, whatever the corpus.

Defined results: a null or empty text is its end alone; a doc_id may be of any type
and is carried as it is, and counts as its text in the choice of the fold, a null
one as the text ''; repeated rows are scored and counted as rows of their own; with no
training documents every token is unknown; an empty table gives an empty result;
other columns are ignored. Token identity is a 64-bit hash.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarden.llm.text import read
from inkwarden.session import stage

#: Restaurants; the last is that of the start of a text.
CONTEXTS = 1 << 16
#: Folds of crc32(doc_id as text): this remainder is held out.
FOLDS, HELD_OUT = 7, 2
#: Gibbs: sweeps, moves of each dish in a sweep, and how many of the last sweeps are samples.
SWEEPS, MOVES, SAMPLES = 4, 3, 3
CONCENTRATION = 1.0
STIRLING = 256
#: Metropolis steps of a move for dishes beyond the table.
STEPS = 12
#: Text and documents packed together, and characters whose tokens make a bucket on average.
SLICE_CHARS, SLICE_DOCS, BUCKET_CHARS = 24 << 20, 1 << 15, 24 << 20
#: The bit of an occurrence's document that says that it is held out.
HELD_BIT = SLICE_DOCS
END = b"\n"  # no word holds a line feed
START = CONTEXTS - 1


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def held_out_column(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def context(word: bytes) -> int:
    """The restaurant of what follows ``word``; the last is kept for the start of a text."""
    return zlib.crc32(word) % (CONTEXTS - 1)


PACKED = "batch long, bucket int, hashes binary, counts binary, contexts binary, docs binary, doc_ids binary, held binary, lengths binary"


def packed(docs: DataFrame, buckets: int) -> DataFrame:
    """Occurrences by token bucket, and a row of bucket -1 with the documents of each batch.

    hashes (sorted, distinct, uint64) and counts (occurrences of each, uint32);
    contexts (uint16) and docs (uint16, the document's place in the batch, and
    whether it is held out) of each occurrence, in the order of hashes. In
    bucket -1: doc_ids (an Arrow stream), held (uint8) and lengths (tokens). So
    what is written grows with the occurrences, whatever the number of buckets.
    """

    def pack(ids: pa.Array, texts: list, held: np.ndarray) -> Iterator[dict]:
        known: dict[bytes, int] = {}
        flat: list[int] = []
        lengths = []
        for text in texts:
            words = tokens(text)
            lengths.append(len(words))
            flat += [known.setdefault(w, len(known)) for w in words]
        length = np.array(lengths, np.int64)
        token = np.array(flat, np.int64)
        del flat
        hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
        after = np.fromiter(map(context, known), np.uint16, len(known))
        doc = np.repeat(np.arange(len(texts), dtype=np.uint16) | held.astype(np.uint16) * np.uint16(HELD_BIT), length)
        where = np.r_[np.uint16(START), after[token[:-1]]]
        where[np.r_[0, np.cumsum(length)[:-1]]] = START
        batch = random.SystemRandom().getrandbits(62)
        yield {"batch": batch, "bucket": -1, "doc_ids": np.frombuffer(_stream(ids), np.uint8), "held": held, "lengths": length}
        # sort distinct tokens by bucket and hash, and occurrences by that rank
        bucket = (hashed >> np.uint64(33)) % np.uint64(buckets)
        order = np.lexsort((hashed, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[token]
        by = np.argsort(place, kind="stable")
        counts = np.bincount(place, minlength=len(order)).astype(np.uint32)
        ends = np.r_[0, np.cumsum(counts)]
        first = np.flatnonzero(np.r_[True, np.diff(bucket[order].astype(np.int64)) != 0])
        for a, b in zip(first, np.r_[first[1:], len(order)], strict=True):
            at = by[ends[a] : ends[b]]
            yield {"batch": batch, "bucket": int(bucket[order[a]]), "hashes": hashed[order[a:b]], "counts": counts[a:b], "contexts": where[at], "docs": doc[at]}

    names = [f.split()[0] for f in PACKED.split(", ")]

    def rows(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for r in found:
            values = [pa.array([r["batch"]], pa.int64()), pa.array([r["bucket"]], pa.int32()), *(pa.array([r[n].tobytes() if n in r else None], pa.binary()) for n in names[2:])]
            yield pa.RecordBatch.from_arrays(values, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        size, n = 0, 0

        def whole() -> Iterator[pa.RecordBatch]:
            ids, texts, held = (pa.chunked_array([p.column(c) for p in parts]).combine_chunks() for c in ("doc_id", "text", "held"))
            return rows(pack(ids, texts.to_pylist(), held.to_numpy(zero_copy_only=False).astype(np.uint8)))

        for batch in batches:
            begin = 0
            for i, chars in enumerate(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()):
                size, n = size + chars, n + 1
                if size >= SLICE_CHARS or n == SLICE_DOCS:
                    parts.append(batch.slice(begin, i + 1 - begin))
                    yield from whole()
                    parts, size, n, begin = [], 0, 0, i + 1
            if begin < batch.num_rows:
                parts.append(batch.slice(begin))
        if parts:
            yield from whole()

    return docs.select("doc_id", "text", held_out_column(F.col("doc_id")).alias("held")).mapInArrow(run, PACKED)


def _stream(ids: pa.Array) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids], names=["doc_id"])
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _from_stream(data: pa.Buffer) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column("doc_id").combine_chunks()


def _array(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind) if value.is_valid else np.zeros(0, kind)


# ---------------------------------------------------------------- seating


@lru_cache(maxsize=8)
def log_stirling(discount: float) -> np.ndarray:
    """log S(c, t), the generalised Stirling numbers of ``discount``, for c and t up to ``STIRLING``."""
    table = np.full((STIRLING + 1, STIRLING + 2), -np.inf)
    table[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(STIRLING):
            t = np.arange(1, STIRLING + 1)
            stay = table[c, 1:-1] + np.log(np.maximum(c - discount * t, 0.0))
            table[c + 1, 1:-1] = np.logaddexp(table[c, :-2], stay)
    return table


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series at x + 7."""
    x = np.asarray(x, float)
    z = x + 7
    down = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4)) + np.log((x + 5) * (x + 6))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - down


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) for t < c by the saddle point of c! / (t! d**t) [x**c] (1 - (1 - x)**d)**t."""
    aim = np.log(c / t)
    low, high = np.full(len(c), -690.0), np.full(len(c), -1e-12)
    v = np.clip((math.log(d) - aim) / (1 - d), low, -1e-6)  # log(1 - x)

    def at(v: np.ndarray) -> tuple[np.ndarray, ...]:
        x, g, y = -np.expm1(v), -np.expm1(d * v), np.exp(v)
        return x, g, y, d * np.exp((d - 1) * v) / g

    for _ in range(14):  # Newton on the log of the mean, which falls in v, kept inside a bracket
        x, g, y, slope = at(v)
        off = np.log(x) + np.log(slope) - aim
        low, high = np.where(off > 0, v, low), np.where(off > 0, high, v)
        step = v + off / (y / x + (1 - d) - slope * y)
        v = np.where((step > low) & (step < high), step, (low + high) / 2)
    x, g, y, slope = at(v)
    spread = x * (c / t) * (1 / x + (1 - d) / y - slope)
    return t * np.log(g) - c * np.log(x) - 0.5 * np.log(2 * np.pi * t * spread) - _lgamma(t + 1) - t * math.log(d) + _lgamma(c + 1)


@lru_cache(maxsize=8)
def _edge(discount: float) -> np.ndarray:
    """What the saddle point misses of the table's last row, by t from 1."""
    t = np.arange(1.0, STIRLING)
    return log_stirling(discount)[STIRLING, 1:STIRLING] - _saddle(np.full(len(t), float(STIRLING)), t, discount)


def log_far(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) beyond the table: the saddle point, mended by the table's last row at the same log t / log c.

    Against exact numbers at c = 3,000 the error changes by 0.1 over all t for
    discounts to 0.7, 0.2 at 0.8 and 0.6 at 0.9, where log S spans thousands.
    """
    c, t = np.asarray(c, float), np.asarray(t, float)
    ones = np.ones(len(c))
    edge = _edge(d)
    first = _lgamma(c - d) - math.lgamma(1 - d) - _saddle(c, ones, d)  # S(c, 1) is known
    inner = np.minimum(t, c - 1)
    mend = np.interp(STIRLING ** (np.log(inner) / np.log(c)), np.arange(1, STIRLING), edge) * (first / edge[0])
    return np.where(t >= c, 0.0, _saddle(c, inner, d) + mend)


def discount_of(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos > 0 else 0.5


def gibbs(rng: np.random.Generator, c: np.ndarray, t: np.ndarray, discount: float, others: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The tables of each dish given everything else, over the whole range from 1 to c.

    ``others``: the tables of other dishes in its restaurant; ``base``: the parent's
    probability of the dish. Up to ``STIRLING`` customers the conditional is drawn
    from in full; beyond, by ``STEPS`` Metropolis steps of all scales up to c.
    """
    t = t.copy()
    free = CONCENTRATION + discount * others
    table = log_stirling(discount)
    near = np.flatnonzero((c > 1) & (c <= STIRLING))
    near = near[np.argsort(c[near], kind="stable")]
    sizes, starts = np.unique(c[near], return_index=True)
    for n, rows in zip(sizes.tolist(), np.split(near, starts[1:]), strict=False):
        k = np.arange(n)
        for at in np.array_split(rows, max(1, len(rows) * n >> 20)):
            each = (free[at] + discount * k[:, None]) * base[at]  # by table and dish
            if n <= 16:  # products stay within a double
                w = np.cumprod(each, axis=0) * np.exp(table[n, 1 : n + 1])[:, None]
            else:
                w = np.cumsum(np.log(each), axis=0) + table[n, 1 : n + 1, None]
                w = np.exp(w - w.max(axis=0))
            w = np.cumsum(w, axis=0)
            t[at] = 1 + (w[:-1] < rng.random(len(at)) * w[-1]).sum(axis=0)
    far = np.flatnonzero(c > STIRLING)
    if len(far):
        n, a, low = c[far].astype(float), free[far] / discount, np.log(base[far]) + math.log(discount)
        weight = lambda x: log_far(n, x, discount) + _lgamma(a + x) + x * low
        now = t[far].astype(float)
        is_ = weight(now)
        for _ in range(STEPS):
            reach = np.exp(rng.random(len(far)) * np.log(n))
            to = now + np.rint(reach * rng.standard_normal(len(far)))
            able = (to >= 1) & (to <= n)
            would = weight(np.where(able, to, now))
            go = able & (np.log(rng.random(len(far))) < would - is_)
            now, is_ = np.where(go, to, now), np.where(go, would, is_)
        t[far] = now.astype(np.int64)
    return t


MODEL = "bucket int, hashes binary, pairs binary, contexts binary, customers binary"
TOTALS = "context int, customers long, tables long"
#: Rows of ``TOTALS`` beyond the restaurants', by name.
SCALARS = ("tokens", "types", "ones", "twos", "root_customers", "root_tables", "root_ones", "root_twos")


@dataclass(frozen=True)
class Dishes:
    """A bucket's training counts: distinct hashes, pairs of each, and their contexts and customers, sorted."""

    bucket: int
    hashes: np.ndarray
    pairs: np.ndarray
    contexts: np.ndarray
    customers: np.ndarray

    @property
    def token(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.hashes)), self.pairs)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of (hash, context, n) by hash and context, sorted."""
    h, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((c, h))
    h, c, n = h[order], c[order], n[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[first], c[first], np.add.reduceat(n, first) if len(first) else n


_COUNTS = {"hashes": np.uint64, "pairs": np.uint32, "contexts": np.uint16, "customers": np.uint32}


def _compact(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Sorted (hash, context, n) as distinct hashes, pairs of each, contexts and customers."""
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    found = h[first], np.diff(np.r_[first, len(h)]), c, n
    return [x.astype(k).tobytes() for x, k in zip(found, _COUNTS.values(), strict=True)]


def counted(found: DataFrame) -> DataFrame:
    """``MODEL``: training counts of each bucket's dishes."""
    names = [f.split()[0] for f in MODEL.split(", ")]

    def row(bucket: int, merged: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([v], pa.binary()) for v in _compact(*merged))], names=names)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind: _array(batch.column(name)[i], kind)  # noqa: B023, E731
                counts, where = get("counts", np.uint32), get("contexts", np.uint16)
                train = get("docs", np.uint16) < HELD_BIT
                # hashes are sorted: by their places, so that a pair is one number
                key = np.sort((np.repeat(np.arange(len(counts)), counts) * CONTEXTS + where)[train])
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                one = key[first]
                yield row(batch.column("bucket")[i].as_py(), (get("hashes", np.uint64)[one // CONTEXTS], one % CONTEXTS, np.diff(np.r_[first, len(key)])))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column("bucket")[i].as_py()
                if bucket != now:
                    if held:
                        yield row(now, _merged(held))
                    now, held, size = bucket, [], 0
                h, pairs, c, n = (_array(batch.column(name)[i], k) for name, k in _COUNTS.items())
                held.append((np.repeat(h, pairs), c, n.astype(np.int64)))
                size += len(c)
                if size > 4_000_000:
                    held = [_merged(held)]
                    size = 0
        if held:
            yield row(now, _merged(held))

    pairs = found.where("bucket >= 0").select("bucket", "hashes", "counts", "contexts", "docs").mapInArrow(inside, MODEL)
    return pairs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(across, MODEL)


def _dishes(batch: pa.RecordBatch, i: int) -> Dishes:
    h, pairs, c, n = (_array(batch.column(name)[i], k) for name, k in _COUNTS.items())
    return Dishes(batch.column("bucket")[i].as_py(), h, pairs, c, n.astype(np.int64))


@dataclass(frozen=True)
class Exchange:
    """What tasks know of the whole corpus before a sweep."""

    customers: np.ndarray  # by restaurant
    tables: np.ndarray
    tokens: int
    types: int
    root_customers: int
    root_tables: int
    discount: float
    root_discount: float

    def mass(self) -> np.ndarray:
        """What each restaurant keeps for the parent."""
        return (CONCENTRATION + self.discount * self.tables) / (CONCENTRATION + self.customers)

    def root_mass(self) -> float:
        return (CONCENTRATION + self.root_discount * self.root_tables) / (CONCENTRATION + self.root_customers)

    def root(self, customers: np.ndarray, tables: np.ndarray, more: np.ndarray | int = 0, opened: np.ndarray | int = 0) -> np.ndarray:
        """The parent's probability of each dish; ``more`` and ``opened`` are its own customers and tables since the exchange."""
        room = CONCENTRATION + self.root_customers + more
        return (customers - self.root_discount * tables + (CONCENTRATION + self.root_discount * (self.root_tables + opened)) / (self.types + 1)) / room


def chain(d: Dishes, history: list[Exchange]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tables of each pair, and customers and tables of each token in the parent: at first, then after each sweep."""
    token, rng = d.token, np.random.default_rng([d.bucket, 20_240_517])
    t = np.ones(len(d.contexts), np.int64)
    own = lambda t: np.bincount(token, t, len(d.hashes)).astype(np.int64)
    r = np.ones(len(d.hashes), np.int64)
    yield t, own(t), r
    for now in history:
        # what the exchange counted of a dish is its state at the start of the sweep
        others, others_root, c0, r0 = now.tables[d.contexts] - t, now.root_tables - r, own(t), r
        for _ in range(MOVES):
            c = own(t)
            base = now.root(c, r, c - c0, r - r0)[token]
            t = gibbs(rng, d.customers, t, now.discount, others, base)
            c = own(t)
            r = np.minimum(r, c)
            r = gibbs(rng, c, r, now.root_discount, others_root, np.full(len(c), 1 / (now.types + 1)))
        yield t, own(t), r


def totals(model: DataFrame, history: list[Exchange]) -> dict[int, tuple[int, int]]:
    """Customers and tables of each restaurant after the sweeps so far; scalars behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customers = np.zeros(CONTEXTS + len(SCALARS), np.int64)
        tables = np.zeros(CONTEXTS + len(SCALARS), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                d = _dishes(batch, i)
                for t, c, r in chain(d, history):
                    pass
                customers[:CONTEXTS] += np.bincount(d.contexts, d.customers, CONTEXTS).astype(np.int64)
                tables[:CONTEXTS] += np.bincount(d.contexts, t, CONTEXTS).astype(np.int64)
                n = d.customers
                customers[CONTEXTS:] += [n.sum(), len(d.hashes), (n == 1).sum(), (n == 2).sum(), c.sum(), r.sum(), (c == 1).sum(), (c == 2).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(customers), dtype=np.int32)), pa.array(customers), pa.array(tables)], names=["context", "customers", "tables"])

    rows = model.mapInArrow(run, TOTALS).groupBy("context").agg(F.sum("customers").alias("c"), F.sum("tables").alias("t")).collect()
    return {r["context"]: (r["c"], r["t"]) for r in rows}


def exchanged(found: dict[int, tuple[int, int]], before: Exchange | None) -> Exchange:
    by = [found.get(i, (0, 0)) for i in range(CONTEXTS)]
    n = {name: found.get(CONTEXTS + i, (0, 0))[0] for i, name in enumerate(SCALARS)}
    return Exchange(
        np.array([c for c, _ in by]), np.array([t for _, t in by]), n["tokens"], n["types"], n["root_customers"], n["root_tables"],
        before.discount if before else discount_of(n["ones"], n["twos"]),
        before.root_discount if before else discount_of(n["root_ones"], n["root_twos"]),
    )


def sampled(model: DataFrame, sweeps: int = SWEEPS) -> list[Exchange]:
    """The exchanges before each sweep and after the last."""
    history: list[Exchange] = []
    for _ in range(sweeps + 1):
        history.append(exchanged(totals(model, history), history[0] if history else None))
    return history


class Predictor:
    """Averaged predictive probabilities of a bucket's tokens."""

    def __init__(self, d: Dishes | None, history: list[Exchange]):
        self.history = history
        last = history[-SAMPLES:]
        self.mass = np.array([x.mass() for x in last])  # sample by restaurant
        self.unknown = np.array([x.root_mass() / (x.types + 1) for x in last])
        self.hashes = np.zeros(0, np.uint64) if d is None else d.hashes
        if d is None:
            self.counts, self.keys, self.own, self.root = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((len(last), 0))
            return
        self.counts = np.bincount(d.token, d.customers, len(d.hashes)).astype(np.int64)
        self.keys = d.token * CONTEXTS + d.contexts
        states = list(chain(d, history[:-1]))[-SAMPLES:]
        self.root = np.array([x.root(c, r) for x, (_, c, r) in zip(last, states, strict=True)])
        own = [(d.customers - x.discount * t) / (CONCENTRATION + x.customers[d.contexts]) for x, (t, _, _) in zip(last, states, strict=True)]
        self.own = np.mean(own, axis=0)

    def of(self, hashes: np.ndarray, counts: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability and training count of each occurrence."""
        place = np.searchsorted(self.hashes, hashes)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == hashes[known]
        token = np.repeat(np.where(known, place, -1), counts)
        contexts = contexts.astype(np.int64)
        seen = token >= 0
        p = np.zeros(len(token))
        for s in range(len(self.mass)):
            root = np.full(len(token), self.unknown[s])
            root[seen] = self.root[s][token[seen]]
            p += self.mass[s][contexts] * root
        p /= len(self.mass)
        if len(self.keys):
            key = token * CONTEXTS + contexts
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = seen & (self.keys[at] == key)
            p[hit] += self.own[at[hit]]
        count = np.zeros(len(token), np.int64)
        count[seen] = self.counts[token[seen]]
        return p, count


def scored(found: DataFrame, model: DataFrame, history: list[Exchange]) -> DataFrame:
    """batch and bucket, the documents (uint16) that have tokens there, and packed sums of each: score, base (float64) and known tokens (int64)."""
    now = history[-1]
    blobs = found.where("bucket >= 0")
    weight = stage(blobs.groupBy("bucket").agg(F.sum(F.length("contexts")).alias("n")), "weights")  # a row a bucket
    fair = weight.agg(F.greatest(F.lit(1), 2 * F.avg("n")).alias("fair")).first()["fair"] or 1
    parts = weight.select("bucket", F.greatest(F.lit(1), F.ceil(F.col("n") / fair)).cast("int").alias("parts"))
    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    work = blobs.join(parts, "bucket").select("bucket", F.pmod("batch", "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "batch", "hashes", "counts", "contexts", "docs", *none("pairs", "customers"))
    told = model.join(parts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("batch"), "hashes", *none("counts"), "contexts", *none("docs"), "pairs", "customers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, predictor = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                where = batch.column("bucket")[i].as_py(), batch.column("part")[i].as_py()
                if where != at:
                    at, predictor = where, None
                if batch.column("kind")[i].as_py() == 0:
                    predictor = Predictor(_dishes(batch, i), history)
                    continue
                predictor = predictor or Predictor(None, history)
                get = lambda name, kind: _array(batch.column(name)[i], kind)  # noqa: B023, E731
                p, count = predictor.of(get("hashes", np.uint64), get("counts", np.uint32), get("contexts", np.uint16))
                doc = get("docs", np.uint16) & np.uint16(HELD_BIT - 1)
                here = np.flatnonzero(np.bincount(doc))
                sums = np.bincount(doc, np.log10(p))[here], np.bincount(doc, np.log10((count + 1) / (now.tokens + now.types + 1)))[here], np.bincount(doc, count > 0)[here].astype(np.int64)
                values = [pa.array([batch.column("batch")[i].as_py()], pa.int64()), pa.array([where[0]], pa.int32()), pa.array([here.astype(np.uint16).tobytes()], pa.binary()), pa.array([b"".join(x.tobytes() for x in sums)], pa.binary())]
                yield pa.RecordBatch.from_arrays(values, names=["batch", "bucket", "here", "sums"])

    dealt = work.unionByName(told).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    return dealt.mapInArrow(run, "batch long, bucket int, here binary, sums binary")


def gathered(found: DataFrame, sums: DataFrame, history: list[Exchange], doc_id: str) -> DataFrame:
    """The documents of each batch with the sums over its buckets, added up in the order of buckets."""
    now = history[-1]
    docs = found.where("bucket = -1").select("batch", "bucket", "doc_ids", "held", "lengths", *[F.lit(None).cast("binary").alias(n) for n in ("here", "sums")])
    parts = sums.select("batch", "bucket", *[F.lit(None).cast("binary").alias(n) for n in ("doc_ids", "held", "lengths")], "here", "sums")
    kind = f"doc_id {doc_id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def rows(total: np.ndarray, ids: pa.Array, held: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        (score, base, known), n = total, len(ids)
        values = [ids, pa.array(held == 1), pa.array(lengths), pa.array(known.astype(np.int64)), pa.array(np.full(n, now.tokens)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(values, names=[f.split()[0] for f in kind.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, docs = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if (b := batch.column("batch")[i].as_py()) != at:
                    if at is not None:
                        yield rows(total, *docs)
                    at = b
                if batch.column("sums")[i].is_valid:
                    raw, here = batch.column("sums")[i].as_buffer(), _array(batch.column("here")[i], np.uint16)
                    n = len(here)
                    total[:2, here] += np.frombuffer(raw, np.float64, 2 * n).reshape(2, n)
                    total[2, here] += np.frombuffer(raw, np.int64, n, 16 * n)
                else:  # bucket -1: the first of the batch
                    docs = (_from_stream(batch.column("doc_ids")[i].as_buffer()), *(_array(batch.column(n)[i], k) for n, k in (("held", np.uint8), ("lengths", np.int64))))
                    total = np.zeros((3, len(docs[0])))
        if at is not None:
            yield rows(total, *docs)

    return docs.unionByName(parts).repartition("batch").sortWithinPartitions("batch", "bucket").mapInArrow(run, kind)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    found = stage(packed(docs, max(16, -(-chars // BUCKET_CHARS))), "packed")
    model = stage(counted(found), "dishes")
    history = sampled(model)
    return gathered(found, scored(found, model, history), history, docs.schema["doc_id"].dataType.simpleString())


def perplexity(scored_docs: DataFrame, column: str = "score") -> float:
    """Of the held-out documents, a token."""
    r = scored_docs.where("held_out").agg(F.sum(column).alias("s"), F.sum("n_tokens").alias("n")).first()
    return 10 ** (-r["s"] / r["n"])


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents"))

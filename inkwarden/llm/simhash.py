"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: XXH64 (seed 42) of the 3-word shingles of a lower-cased text; a
bit is set if it is set in over half of the hashes.

Links: distinct fingerprints are sorted into binary tries and each trie is
joined with itself. Node pairs are traversed together from the root, level by
level; a pair carries the bits in which its prefixes differ and is pruned when
they exceed the budget. The upper levels are dealt out: the 64 bits are cut
into ``budget + 1`` bands, and two fingerprints within the budget agree in one
band at least, so a trie over the other bits for each value of each band finds
every link with the budget spent below. Tries are small and many, and a
group of near copies meets as distinct fingerprints only.

A task returns, for each trie, a spanning forest of its links rather than all
pairs, so a dense group of m fingerprints yields m - 1 links. A large node pair
whose keys are all of one component already is not descended.
Components come from alternating large-star and small-star steps over staged
tables; no links or components reach the driver.

``representatives``, a stage of the pipeline, takes its first links from the classes of
fingerprints, each checked in full by the Jaccard similarity of its sets of 5-word
shingles. Most texts of similarity 0.8 differ in more than three bits: beside these
links, the sets are joined exactly, by prefixes in the order of frequency and by position.

Defined results: null and empty texts, and texts of white space, have the
fingerprint zero and link like any other; texts of one or two words have one
shingle, the whole sequence; repeated rows share a component; a null doc_id
belongs to its component, whose id is the smallest of the others (null if none
is there); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarden.llm.text import read
from inkwarden.operators.graph import components
from inkwarden.session import stage, unstage

BITS, BUDGET, SHINGLE, SEED = 64, 3, 3, 42
#: Words of a shingle where similarity is exact (``representatives``).
NEAR_SHINGLE = 5
#: Node pairs that one step of the traversal takes at most, fingerprints joined together, and
#: fingerprints of one trie from which on it is dealt again.
STEP, HELD, HOT, LEAST_FREE = 1 << 16, 1 << 19, 1 << 16, 16


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six gaps count
    if not w:
        return np.zeros(0, np.uint64)
    parts = zip(*(w[i:] for i in range(width)), strict=False) if len(w) >= width else [w]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(p), SEED) for p in parts), np.uint64)


def fingerprint(text: str | None) -> int:
    """Unsigned; long texts are counted in bounded slices."""
    h = shingle_hashes(text)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big") if len(h) else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


class Forest:
    """Disjoint sets over positions, for the links of one batch of tries."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        y = up[x]
        while not np.array_equal(z := up[y], y):
            y = z
        up[x] = y
        return y

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            apart = a != b
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.up, high, low)


def trie_forest(trie: np.ndarray, key: np.ndarray, budget: int = BUDGET, bits: int = BITS, depth: int = 0) -> np.ndarray:
    """For each position the smallest position that its trie links it to, over any chain of links.

    ``trie`` and ``key`` are sorted together, with no repeats, and the keys of
    a trie share their first ``depth`` of ``bits`` bits. A node is a range
    of positions with a common prefix, so that the sorted array is the trie.
    """
    n = len(key)
    forest = Forest(n)
    if n < 2:
        return forest.up
    # neighbours in the order of keys first: of a dense group this joins much, and joined ranges are not descended
    near = np.flatnonzero((trie[1:] == trie[:-1]) & (np.bitwise_count(key[1:] ^ key[:-1]) <= budget))
    forest.link(near, near + 1)
    starts = np.flatnonzero(np.r_[True, trie[1:] != trie[:-1]])
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    a0, a1 = starts[many], ends[many]
    # a stack of node pairs (first range, second range, depth, differing bits), the deepest on top
    a0, a1 = a0.astype(np.int32), a1.astype(np.int32)
    stack = [(a0, a1, a0, a1, depth, np.zeros(len(a0), np.int8))]
    places, stale = np.arange(n), 0
    low = forest.root(places)
    jump = np.r_[0, np.cumsum(low[1:] != low[:-1])]
    while stack:
        s, e, t, f, depth, diff = stack.pop()
        if len(s) > STEP:
            half = len(s) // 2
            stack.append((s[half:], e[half:], t[half:], f[half:], depth, diff[half:]))
            s, e, t, f, diff = s[:half], e[:half], t[:half], f[:half], diff[:half]
        # both subtrees are single keys: compare what is left of them at once
        leaf = (e - s == 1) & (f - t == 1)
        if leaf.any():
            x, y = s[leaf], t[leaf]
            close = (x != y) & (low[x] != low[y]) & (np.bitwise_count(key[x] ^ key[y]) <= budget)
            if close.any():
                forest.link(x[close], y[close])
                stale += int(close.sum())
            s, e, t, f, diff = (v[~leaf] for v in (s, e, t, f, diff))
        # ranges that are of one component already have nothing to add; the view of components may lag behind
        if len(s):
            if stale and stale + len(s) > n >> 4:
                low, stale = forest.root(places), 0
                jump = np.r_[0, np.cumsum(low[1:] != low[:-1])]
            done = (jump[e - 1] == jump[s]) & (jump[f - 1] == jump[t]) & (low[s] == low[t])
            s, e, t, f, diff = (v[~done] for v in (s, e, t, f, diff))
        if not len(s) or depth >= bits:
            continue
        bit = np.uint64(bits - 1 - depth)
        m, o = _split(key, s, e, bit), _split(key, t, f, bit)
        same = s == t
        below = []
        for (p, q), (u, v), cost, keep in (((s, m), (o, f), 1, None), ((m, e), (t, o), 1, ~same), ((s, m), (t, o), 0, None), ((m, e), (o, f), 0, None)):
            live = (q > p) & (v > u) & (diff + cost <= budget)
            if keep is not None:
                live &= keep
            if cost == 0:
                live &= ~((p == u) & (q - p == 1))  # a key with itself
            below.append((p[live], q[live], u[live], v[live], diff[live] + cost))
        p, q, u, v, diff = (np.concatenate(c) for c in zip(*below, strict=True))
        if len(p):
            stack.append((p, q, u, v, depth + 1, diff))
    return forest.root(np.arange(n))


def _split(key: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the given bit turns to one inside each sorted range, by bisection of all ranges together."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        one = (key[np.minimum(mid, len(key) - 1)] >> bit) & np.uint64(1) == 1
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)
    return low


def _cut(mask: int) -> list[int]:
    """``mask`` with each of the ``BUDGET + 1`` bands of the bits that it leaves free."""
    free = [b for b in reversed(range(BITS)) if not mask >> b & 1]
    ends = [len(free) * i // (BUDGET + 1) for i in range(BUDGET + 2)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(ends, ends[1:], strict=False)]


def _dealt(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """fp, k and value of each fingerprint: ``masks[k]`` holds the masks that follow the one it was dealt by."""
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    width = BUDGET + 1
    held = F.array(*[F.lit(signed(m)) for of in masks for m in of])
    each = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct((F.col("k") * width + i).alias("k"), F.col("fp").bitwiseAND(F.get(held, F.col("k") * width + i)).alias("value")))
    return rows.select("fp", F.explode(each).alias("b")).select("fp", "b.k", "b.value")


def tries(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """fp, mask and value: the fingerprints of each trie, which agree in the bits of its mask.

    A trie of more than ``hot`` fingerprints is dealt again, on the bits that are
    free in it, until ``LEAST_FREE`` are left: no trie of those is large.
    """
    masks, found = [_cut(0)], []
    rows = _dealt(distinct.select("fp", F.lit(0).alias("k")), masks)
    while True:
        flat = [m for of in masks for m in of]
        signed = F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m) for m in flat])
        named = lambda df, signed=signed: df.select("fp", F.get(signed, F.col("k")).alias("mask"), "value")
        large = stage(rows.groupBy("k", "value").count().where(F.col("count") > hot).select("k", "value"), "hot-tries")
        if max(BITS - m.bit_count() for m in flat) <= LEAST_FREE or large.isEmpty():
            found.append(named(rows))
            break
        found.append(named(rows.join(large, ["k", "value"], "left_anti")))
        masks = [_cut(m) for m in flat]
        rows = stage(_dealt(rows.join(large, ["k", "value"]).select("fp", "k"), masks), "dealt-again")
    return reduce(DataFrame.unionByName, found)


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """a and b: a spanning forest of the links between distinct fingerprints ``fp``."""
    dealt = tries(distinct, hot).repartition("mask", "value").sortWithinPartitions("mask", "value")

    def joined(fp: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        trie = np.cumsum(first)
        key = fp.view(np.uint64)
        order = np.lexsort((key, trie))
        key, trie, fp = key[order], trie[order], fp[order]
        up = trie_forest(trie, key)
        moved = np.flatnonzero(up != np.arange(len(up)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[up[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # whole batches: fingerprints, and where a trie begins
        size, last = 0, None
        for batch in batches:
            fp, mask, value = (batch.column(c).to_numpy() for c in ("fp", "mask", "value"))
            if not len(fp):
                continue
            first = np.r_[last != (mask[0], value[0]), (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]
            last = mask[-1], value[-1]
            starts = np.flatnonzero(first)
            if size + len(fp) > HELD and len(starts):  # whole tries go; the last, which may continue, stays
                k = starts[-1]
                held.append((fp[:k], first[:k]))
                if size + k:
                    yield joined(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, size = [(fp[k:], first[k:])], len(fp) - k
            else:
                held.append((fp, first))
                size += len(fp)
        if size:
            yield joined(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return dealt.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    found = stage(fingerprints(docs), "fingerprints")
    smallest = stage(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = components(links(smallest.select("fp")))
    members = smallest.join(linked, smallest["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # few fingerprints move: only those are brought together by root
    roots = members.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = stage(members.join(roots, "root").select("fp", "component_id"), "labels")
    return found.join(labels, "fp").select("doc_id", "fp", "component_id")


#: Characters and documents packed together, and characters whose shingles meet in one task.
SLICE_CHARS, SLICE_DOCS, BUCKET_CHARS = 24 << 20, 1 << 16, 8 << 20
PACKED = "batch long, bucket int, places binary, hs binary, sids binary, sizes binary, keys binary"


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingles of ``NEAR_SHINGLE`` words."""
    return np.unique(shingle_hashes(text, NEAR_SHINGLE))


def set_id(shingles: np.ndarray) -> int:
    """The set's name, a signed hash; 0 for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64)) if len(shingles) else 0


def packed_sets(keyed: DataFrame, bits: int) -> DataFrame:
    """``PACKED``: the shingles of some documents by the first ``bits`` bits, and in bucket -1 their sids, sizes and keys.

    Of a shingle's hash the 32 bits after the bucket's travel, next to the document's
    place in its batch: six bytes in all.
    """

    def pack(keys: list[int], texts: list) -> Iterator[list]:
        sets = [shingle_set(t) for t in texts]
        sizes = np.fromiter(map(len, sets), np.int32, len(sets))
        batch = random.SystemRandom().getrandbits(62)
        yield [batch, -1, None, None, np.fromiter(map(set_id, sets), np.int64, len(sets)).tobytes(), sizes.tobytes(), np.array(keys, np.int64).tobytes()]
        all_ = np.concatenate(sets)
        place = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        del sets
        order = np.argsort(all_, kind="stable")
        all_, place = all_[order], place[order]
        bucket = (all_ >> np.uint64(64 - bits)).astype(np.int64)
        low = (all_ >> np.uint64(32 - bits)).astype(np.uint32)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        for i, j in zip(first, np.r_[first[1:], len(bucket)], strict=True):
            yield [batch, int(bucket[i]), place[i:j].tobytes(), low[i:j].tobytes(), None, None, None]

    names = [f.split()[0] for f in PACKED.split(", ")]
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 5)

    def rows(found: Iterator[list]) -> Iterator[pa.RecordBatch]:
        for r in found:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(r, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column("key"), batch.column("text"), strict=True):
                keys.append(k.as_py())
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= SLICE_CHARS or len(keys) == SLICE_DOCS:
                    yield from rows(pack(keys, texts))
                    keys, texts, size = [], [], 0
        if keys:
            yield from rows(pack(keys, texts))

    return keyed.select("key", "text").mapInArrow(run, PACKED)


def unpacked(packed: DataFrame) -> DataFrame:
    """batch, place, sid, n and key of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sid, n, key = (np.frombuffer(batch.column(c)[i].as_py(), k) for c, k in (("sids", np.int64), ("sizes", np.int32), ("keys", np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sid), batch.column("batch")[i].as_py())), pa.array(np.arange(len(sid), dtype=np.int32)), pa.array(sid), pa.array(n), pa.array(key)], names=["batch", "place", "sid", "n", "key"])

    return packed.where("bucket = -1").select("batch", "sids", "sizes", "keys").mapInArrow(run, "batch long, place int, sid long, n int, key long")


def shared_shingles(packed: DataFrame) -> DataFrame:
    """batch, place, h and df: the shingles that two documents or more have, for each of these."""

    def met(bucket: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        low = np.concatenate([h for _, _, h in held])
        batch = np.repeat(np.array([b for b, _, _ in held], np.int64), [len(h) for _, _, h in held])
        place = np.concatenate([p for _, p, _ in held]).astype(np.int32)
        order = np.argsort(low, kind="stable")
        low, batch, place = low[order], batch[order], place[order]
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        df = np.diff(np.r_[first, len(low)])
        df = np.repeat(df, df)
        many = np.flatnonzero(df > 1)
        for at in range(0, len(many), 1 << 18):
            k = many[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(batch[k]), pa.array(place[k]), pa.array(low[k].astype(np.int64) | np.int64(bucket) << 32), pa.array(df[k].astype(np.int64))], names=["batch", "place", "h", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                if (bucket := batch.column("bucket")[i].as_py()) != now:
                    if held:
                        yield from met(now, held)
                    now, held = bucket, []
                held.append((batch.column("batch")[i].as_py(), np.frombuffer(batch.column("places")[i].as_py(), np.uint16), np.frombuffer(batch.column("hs")[i].as_py(), np.uint32)))
        if held:
            yield from met(now, held)

    dealt = packed.where("bucket >= 0").select("batch", "bucket", "places", "hs").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "batch long, place int, h long, df long")


def whole_sets(texts: DataFrame) -> DataFrame:
    """sid, n and hs of each row's ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(t.as_py()) for t in batch.slice(at, 512).column("text")]
                n = np.fromiter(map(len, sets), np.int32, len(sets))
                hs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in sets], pa.int64()), pa.array(n), hs], names=["sid", "n", "hs"])

    return texts.select("text").mapInArrow(run, "sid long, n int, hs array<long>")


def near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b of sets whose Jaccard similarity is 0.8 at least: 9 * both >= 4 * (na + nb)."""
    x, y = (sets.select(F.col("sid").alias(k), F.col("n").alias(f"n{k}"), F.col("hs").alias(f"h{k}")) for k in "ab")
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(x, "a").join(y, "b").where(9 * both >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def prefixes(shared: DataFrame, known: DataFrame) -> DataFrame:
    """sid, n, h and slack: of each set the shingles by which a similar set would be met, if another document has them.

    Two sets of similarity 0.8 share one of their first n - ceil(0.8 n) + 1 shingles
    in any order common to all. The order is by frequency, rarest first, so that
    shingles of common passages stay out; those of one document alone come first and
    are only counted. ``slack`` is n - 9 p, where p shingles stand before h: of two sets
    that first meet in h, those differ, and at 0.8 at most a ninth of both sizes may
    differ, so their slacks must not add up to less than zero.
    """
    prefix = F.col("n") - F.ceil(F.col("n") * 4 / 5).cast("int") + 1
    one = known.where("n > 0").groupBy("sid", "n").agg(F.min(F.struct("batch", "place")).alias("at")).select("sid", "n", "at.*")
    ranked = shared.join(one, ["batch", "place"]).groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    left = prefix - (F.col("n") - F.size("s"))
    found = ranked.where(left > 0).select("sid", "n", (F.col("n") - F.size("s")).alias("alone"), F.posexplode(F.slice("s", 1, left)).alias("k", "s"))
    return found.select("sid", "n", F.col("s.h").alias("h"), (F.col("n") - 9 * (F.col("alone") + F.col("k"))).alias("slack"))


def fingerprint_pairs(keyed: DataFrame, named: DataFrame) -> DataFrame:
    """a and b: the sets of a class of fingerprints, each with the class's first; ``keyed`` has key and text, ``named`` key and sid."""
    found = fingerprints(keyed.select(F.col("key").alias("doc_id"), "text")).toDF("key", "fp")
    told = stage(found.groupBy("key").agg(F.min("fp").alias("fp")).join(named, "key").groupBy("sid").agg(F.min("fp").alias("fp")), "set-fingerprints")
    linked = components(links(told.select("fp").distinct()))
    members = stage(told.join(linked, told["fp"] == linked["node"], "left").select("sid", F.coalesce("root", "fp").alias("root")), "fingerprint-classes")
    firsts = members.groupBy("root").agg(F.min("sid").alias("a"))
    return stage(members.join(firsts, "root").where("a <> sid").select("a", F.col("sid").alias("b")), "fingerprint-pairs")


def jaccard_links(heads: DataFrame, sets: DataFrame, told: DataFrame) -> DataFrame:
    """a and b: links between distinct sets (``sid``, ``n``, ``hs``) that join all pairs of similarity 0.8 or more.

    The pairs ``told`` by fingerprints are compared in full with the first ones. Sets that meet in ``heads`` with slack enough are compared in full: the members
    of a shingle with the one of most slack first, and then across the components
    found only. Sets that share a common passage and little else all come near the
    one that has least beside it, or have no slack, so a passage of many documents
    does not pair them with each other.
    """
    hubs = heads.groupBy("h").agg(F.max(F.struct("slack", "sid")).alias("hub"), F.count("*").alias("m")).where("m > 1").select("h", "hub")
    able = stage(heads.join(hubs, "h").where("slack + hub.slack >= 0").select("h", "sid", "n", "slack", F.col("hub.sid").alias("a")), "able")
    star = able.where("a <> sid").select("a", F.col("sid").alias("b")).distinct()
    first = stage(near(star.unionByName(told).distinct(), sets), "star")
    joined = stage(components(first).select(F.col("node").alias("sid"), "root"), "joined")
    labelled = stage(able.join(joined, "sid", "left").select("h", "sid", "n", "slack", F.coalesce("root", "sid").alias("root")), "labelled")
    unstage(able)
    mixed = labelled.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    apart = stage(labelled.join(mixed, "h").groupBy("h", "root").agg(F.max("slack").alias("most"), F.collect_list(F.struct("sid", "n", "slack")).alias("members")), "apart")
    unstage(labelled)
    x, y = (apart.select("h", F.col("root").alias(f"r{k}"), F.col("most").alias(f"s{k}"), F.col("members").alias(f"m{k}")) for k in "ab")
    across = x.join(y, "h").where("ra < rb AND sa + sb >= 0").select(F.explode("ma").alias("x"), "mb").select("x", F.explode("mb").alias("y"))
    sized = across.where("x.slack + y.slack >= 0 AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n").select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()
    return first.unionByName(near(sized, sets))


#: Bytes of keys that may be broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 32 << 20


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id and component_id by exact Jaccard similarity of ``NEAR_SHINGLE``-word shingles, over any chain of links.

    Classes of fingerprints tell the first pairs; the others are met by shingles. Frequencies of all shingles are counted over packed rows; only shingles that two
    documents share become rows of their own, and only sets that meet in a prefix are
    made again, from one text of each, to be compared in full.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    packed = stage(packed_sets(keyed, min(24, max(8, (chars // BUCKET_CHARS).bit_length()))), "packed-sets")
    known = stage(unpacked(packed), "known-sets")
    shared = stage(shared_shingles(packed), "shared-shingles")
    unstage(packed)
    heads = stage(prefixes(shared, known), "heads")
    unstage(shared)
    met = heads.groupBy("h").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("h")
    heads = stage(heads.join(met, "h"), "met")
    named = known.select("key", "sid").distinct()
    told = fingerprint_pairs(keyed, named)
    asked = heads.select("sid").unionByName(told.select(F.explode(F.array("a", "b")).alias("sid"))).distinct()
    keys = known.join(asked, "sid", "left_semi").groupBy("sid").agg(F.min("key").alias("key")).select("key")
    keys = stage(keys, "candidates")
    few = F.broadcast(keys) if 16 * keys.count() <= BROADCAST_BYTES else keys
    sets = stage(whole_sets(keyed.join(few, "key", "left_semi").dropDuplicates(["key"])), "sets")
    linked = components(stage(jaccard_links(heads, sets, told), "links"))
    joined = keyed.select("doc_id", "key").join(named, "key")
    smallest = joined.groupBy("sid").agg(F.min("doc_id").alias("first"))
    members = stage(smallest.join(linked, smallest["sid"] == linked["node"], "left").select("sid", "first", F.coalesce("root", "sid").alias("root")), "members")
    roots = members.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = members.join(roots, "root").select("sid", "component_id")
    labels = stage(named.join(labels, "sid").select("key", "component_id"), "labels")
    return keyed.select("doc_id", "key").join(labels, "key").select("doc_id", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each class of ``near_classes`` stays: the one whose id is the class id. Columns as they came.

    Rows that repeat that id stay together: they are one document. Rows with
    null ids cannot be named and stay.
    """
    gone = near_classes(docs).groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))).alias("stays")).where("NOT stays").select("doc_id")
    return docs.join(stage(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

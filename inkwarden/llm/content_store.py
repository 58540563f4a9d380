"""A content-addressed store of token ids.

Each document's id stream, with its end id, is cut where a rolling hash over
the last 32 ids matches, so equal passages give equal chunks wherever they
stand. A chunk is stored once, under the BLAKE2b digest of its bytes. A
document's recipe lists its chunks' digests; recipes are written in ascending
order of doc_id with each document's first position in the whole stream. A
Merkle tree over the chunks gives a document's root, one over the roots of a
recipe part gives the part's, and the manifest holds these with a root of all.

Layout under the store's folder, in Parquet: ``chunks`` (digest, payload),
``recipes`` (doc_id, row, part, start_in_part, n_tokens, digests, after, root; ``after`` counts
the document's ids behind each chunk)
``manifest`` (part, docs, ids, start, root) and ``root`` (docs, ids, root). Payloads are little-endian, of
two bytes an id where the vocabulary allows and else of four.

Writing moves each chunk once; reading checks each stored chunk against its
digest and takes its CRC there; a document's root is made again from the digests of
the chunks read, its CRC is combined from theirs, and the roots of parts and of all
are made again from those below, so that no payload is moved to be checked.

Defined results: a null or empty text is its end id alone; rows that repeat a
doc_id are rows of their own, in an order that the store keeps; null ids come
first; an empty table gives an empty store; other columns are ignored; a chunk
that does not match its digest, or a root that does not match its manifest,
raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwarden.llm.bpe import byte_characters, vocabulary_path
from inkwarden.llm.text import read
from inkwarden.session import fresh_path, stage, unstage

END_ID = 0
#: Ids: least and most of a chunk, and the mean length beyond the least as a power of two.
LEAST, MOST, MEAN_BITS, WINDOW = 64, 2048, 8, 32
DIGEST = 16
#: Bytes of a worker's memo of pieces and their ids before it begins anew with those of the last slice.
MEMO = 64 << 20
#: Bytes of text that are looked up together, and ids that are cut into chunks together.
SLICE, PLACES = 16 << 20, 1 << 20


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; an odd node rises unchanged. No leaves: the digest of nothing."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cuts(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For each document ``ids[start:end]`` the ends of its chunks, found for all documents together.

    The hash at a place covers the 32 ids before it. A chunk has 64 at least, so
    no hash that counts reaches into another document or chunk.
    """
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    marks = (np.flatnonzero((h >> np.uint64(40)) & np.uint64((1 << MEAN_BITS) - 1) == 0) + 1).tolist()
    out = []
    for at, end in zip(starts.tolist(), ends.tolist(), strict=True):
        found = []
        while at < end:
            k = bisect_left(marks, at + LEAST)
            at = min(marks[k] if k < len(marks) else end, at + MOST, end)
            found.append(at)
        out.append(found)
    return out


class Encoder:
    """The tokenizers library, asked once for each piece of text that a worker has not seen lately.

    A text is cut before each space that no white space follows, and what lies between
    the spaces, once for all its copies in a slice of texts, around single line feeds and
    between a letter or digit and a sign: no pre-token spans these places. New pieces are
    joined into long texts: by their spaces, as a piece holds no other, or by line feeds,
    as each of these is a token of its own there. Texts with a special string, or with
    white space behind a space, go to the library whole.
    """

    JOINED, STEP = 100, 200
    #: No white space but single line feeds inside.
    PLAIN = r"\A{0}+(?:\n{0}+)*\z".format(r"[^\x00-\x20\x7f-\xa0\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
    #: Letters and digits that all Unicode tables know as such, and the signs of ASCII but the apostrophe.
    SIGN = r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{400}-\x{481}])([!-&(-/:-@\[-`{-~])"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if resize := getattr(self.tokenizer.model, "_resize_cache", None):
            resize(0)  # no piece is asked for twice
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        n = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        shown = {b: c for c, b in byte_characters().items()}
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(shown[32]) for i in range(n)])
        self.feed = self.tokenizer.token_to_id(shown[10])
        # other vocabularies than byte-level ones with the usual pattern may have pre-tokens over signs and line feeds
        self.usual = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.usual = self.usual.get("type") == "ByteLevel" and self.usual.get("use_regex", True) and self.feed is not None
        self._forget()

    def _forget(self) -> None:
        self.words, self.records = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _asked(self, texts: list[str]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), self.STEP):
            for found in self.tokenizer.encode_batch_fast(texts[at : at + self.STEP], add_special_tokens=False):
                yield np.array(found.ids, self.kind)

    def _joined(self, pieces: list[str], between: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of all pieces, and how many each has."""
        parts = [pieces[i : i + self.JOINED] for i in range(0, len(pieces), self.JOINED)]
        out, sizes = [], []
        for part, ids in zip(parts, self._asked([between.join(p) for p in parts]), strict=True):
            if between:
                feeds = ids == self.feed
                n, ids = np.diff(np.r_[-1, np.flatnonzero(feeds), len(ids)]) - 1, ids[~feeds]
            else:
                n = np.diff(np.r_[np.flatnonzero(self.opens[ids]), len(ids)])
            if len(n) != len(part):
                each = list(self._asked(part))
                n, ids = np.array([len(x) for x in each]), np.concatenate(each)
            out.append(ids)
            sizes.append(n)
        return out, sizes

    def _new(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of each piece, from the library."""
        spaced = pc.starts_with(pieces, " ").to_numpy(zero_copy_only=False)
        bare = np.array([self.usual and x.split() == [x] for x in pieces.filter(pa.array(~spaced)).to_pylist()], bool)
        places = np.flatnonzero(spaced), np.flatnonzero(~spaced)[bare], np.flatnonzero(~spaced)[~bare]
        kinds = [pieces.take(pa.array(p)).to_pylist() for p in places]  # behind a space, without white space, others
        others = list(self._asked(kinds[2]))
        found = self._joined(kinds[0], ""), self._joined(kinds[1], "\n"), (others, [np.array([len(x)]) for x in others])
        ids = np.concatenate([np.empty(0, self.kind), *(x for out, _ in found for x in out)])
        sizes = np.concatenate([np.empty(0, np.int64), *(n for _, sizes in found for n in sizes)])
        at = np.empty(len(pieces), np.int64)
        at[np.concatenate(places)] = np.arange(len(pieces))
        return _cells(ids, np.r_[0, np.cumsum(sizes)]).take(pa.array(at))

    def _known(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of each of these distinct pieces."""
        at = pc.index_in(pieces, value_set=self.words)
        missing = pieces.filter(pc.is_null(at))
        words, records = pa.concat_arrays([self.words, missing]), pa.concat_arrays([self.records, self._new(missing)])
        at = at.to_numpy(zero_copy_only=False)
        if len(missing):
            gone = np.isnan(at)
            at[gone] = len(self.words) + np.arange(len(missing))
        out = records.take(pa.array(at.astype(np.int64)))
        if words.nbytes + records.nbytes <= MEMO:
            self.words, self.records = words, records
        elif pieces.nbytes + out.nbytes <= MEMO:
            self.words, self.records = pieces, out
        else:
            self._forget()
        return out

    def _chunks(self, chunks: pa.LargeStringArray, behind: np.ndarray) -> pa.LargeBinaryArray:
        """The ids of each chunk, that holds no space; those that are ``behind`` one include it."""
        if self.usual:
            marked = pc.replace_substring(pc.replace_substring_regex(chunks, self.SIGN, r"\1 \2"), "\n", " \n ")
            chunks = pc.if_else(pc.match_substring_regex(chunks, self.PLAIN), marked, chunks)
        cut = pc.split_pattern(chunks, " ")
        begin = cut.offsets.to_numpy()
        space = np.zeros(begin[-1], bool)
        space[begin[:-1]] = behind
        flat = cut.flatten()
        nothing = pa.scalar("", pa.large_string())
        coded = pc.binary_join_element_wise(pc.if_else(pa.array(space), pa.scalar(" ", pa.large_string()), nothing), flat, nothing).dictionary_encode()
        found = self._known(coded.dictionary).take(coded.indices)
        ids, ends = _flat(found, self.kind)
        return _cells(ids, ends[begin])

    def streams(self, texts: pa.StringArray, end: bytes = b"") -> pa.LargeBinaryArray:
        """The ids of each text and ``end``, as bytes of ``kind``."""
        if not len(texts):
            return pa.array([], pa.large_binary())
        texts, whole = texts.cast(pa.large_string()), np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts if not whole.any() else pc.if_else(pa.array(whole), "", texts), " ")
        begin = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        at, n = coded.indices.to_numpy(), len(coded.dictionary)
        firsts, first_at = np.unique(at[begin[:-1]], return_inverse=True)
        opening = pc.utf8_slice_codeunits(coded.dictionary, 0, 1)
        blank = pa.array([x for x in pc.unique(opening).to_pylist() if not x or x.isspace()], pa.large_string())
        odd = pc.is_in(opening, value_set=blank)
        rest = pc.if_else(odd, "", coded.dictionary)
        odd = odd.to_numpy(zero_copy_only=False)
        chunks = pa.concat_arrays([rest, coded.dictionary.take(pa.array(firsts))])
        records = self._chunks(chunks, np.r_[~odd, np.zeros(len(firsts), bool)])
        is_odd = odd[at]
        at = at.astype(np.int64)
        at[begin[:-1]], is_odd[begin[:-1]] = n + first_at, False
        whole |= np.logical_or.reduceat(is_odd, begin[:-1])
        size = np.diff(begin)
        if whole.any():
            kept = np.repeat(~whole, size)
            kept[begin[:-1]] = True
            at[begin[:-1][whole]] = len(chunks) + np.arange(whole.sum())
            at, size = at[kept], np.where(whole, 1, size)
        asked = [x.tobytes() for x in self._asked(texts.filter(pa.array(whole)).to_pylist())]
        records = pa.concat_arrays([records, pa.array([*asked, end], pa.large_binary())])
        upto = np.cumsum(size)
        ids, ends = _flat(records.take(pa.array(np.insert(at, upto, len(records) - 1))), self.kind)
        return _cells(ids, ends[np.r_[0, upto + np.arange(1, len(upto) + 1)]])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``kind``."""
        return self.streams(pa.array(texts, pa.string())).to_pylist()


def _cells(ids: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Binary values that lie one after the other, from their bounds in ``ids``."""
    offsets = np.ascontiguousarray(ends, np.int64) * ids.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


def _flat(cells: pa.LargeBinaryArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all values and their bounds, the reverse of ``_cells``."""
    _, offsets, data = cells.buffers()
    ends = np.frombuffer(offsets, np.int64)[cells.offset : cells.offset + len(cells) + 1]
    ids = np.frombuffer(data, kind, int(ends[-1] - ends[0]) // kind.itemsize, int(ends[0])) if data is not None and ends[-1] > ends[0] else np.empty(0, kind)
    return ids, (ends - ends[0]) // kind.itemsize


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of about ``most`` in all, or of one that is larger."""
    marks = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    yield from pairwise([0, *marks.tolist(), len(sizes)])


_encoders: dict[str, Encoder] = {}

PIECES = "row long, n_tokens long, digests array<binary>, after array<long>, root binary, payloads array<binary>"


def pieces(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, row, n_tokens, digests, after, root and payloads, null for chunks that the task gave before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        end, seen = np.array([end_id], encoder.kind).tobytes(), set()
        row = TaskContext.get().partitionId() << 36
        width = encoder.kind.itemsize
        names = ["doc_id", "row", "n_tokens", "digests", "after", "root", "payloads"]
        kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()))
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), pc.fill_null(batch.column("text"), "")
            for begin, stop in _runs(pc.binary_length(texts).to_numpy().astype(np.int64), SLICE) if batch.num_rows else ():
                stream, ends = _flat(encoder.streams(texts.slice(begin, stop - begin), end), encoder.kind)
                data = memoryview(stream).cast("B")
                for i, j in _runs(np.diff(ends), PLACES):
                    columns: tuple[list, ...] = [], [], [], [], []
                    base = at = int(ends[i])
                    for found in cuts(stream[base : ends[j]], ends[i:j] - base, ends[i + 1 : j + 1] - base):
                        start, digests, payloads = at, [], []
                        for to in found:
                            part = data[at * width : (base + to) * width]
                            name = digest(part)
                            payloads.append(None if name in seen else bytes(part))
                            seen.add(name)
                            digests.append(name)
                            at = base + to
                        for c, v in zip(columns, (at - start, digests, [at - base - to for to in found], merkle(digests), payloads), strict=True):
                            c.append(v)
                    arrays = [doc_ids.slice(begin + i, j - i), pa.array(np.arange(row, row + j - i)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                    row += j - i

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECES}")


def _running(recipes: DataFrame) -> DataFrame:
    """Range partitions in order of doc_id: the part's number and each document's place in its part."""
    placed = recipes.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            upto = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(upto - n, pa.int64())], names=[*batch.schema.names, "part", "start_in_part"])
            before = int(upto[-1]) if len(n) else before

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in recipes.schema.fields)
    return placed.mapInArrow(run, f"{fields}, part int, start_in_part long")


def _part_roots(recipes: DataFrame) -> DataFrame:
    """part, docs, ids and the Merkle root of each part's document roots. A part is one range partition."""

    def root(group):
        group = group.sort_values("start_in_part", kind="stable")
        return group.iloc[:1][["part"]].assign(docs=len(group), ids=int(group.n_tokens.sum()), root=merkle(group.root.tolist()))

    return recipes.select("part", "start_in_part", "n_tokens", "root").groupBy("part").applyInPandas(root, "part int, docs long, ids long, root binary")


def _whole_root(parts: DataFrame) -> DataFrame:
    """docs, ids and the Merkle root over the roots of all parts, in order: one row a part meets here."""

    def root(group):
        group = group.sort_values("part", kind="stable")
        return group.iloc[:1][[]].assign(docs=int(group.docs.sum()), ids=int(group.ids.sum()), root=merkle(group.root.tolist()))

    return parts.select("part", "docs", "ids", "root").groupBy().applyInPandas(root, "docs long, ids long, root binary")


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write a store to ``path``, a folder that the cluster shares."""
    spark = docs.sparkSession
    found = stage(pieces(docs, vocabulary or vocabulary_path(), end_id), "pieces")
    chunks = found.select(F.explode(F.arrays_zip("digests", "payloads")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.payloads").alias("payload")).where("payload IS NOT NULL")
    chunks.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    _running(found.drop("payloads")).write.option("compression", "zstd").parquet(f"{path}/recipes")
    unstage(found)
    roots = _part_roots(spark.read.parquet(f"{path}/recipes"))
    starts = F.sum("ids").over(Window.orderBy("part")) - F.col("ids")  # one row per part
    roots.withColumn("start", starts).write.parquet(f"{path}/manifest")
    _whole_root(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/root")


def shift_tables(levels: int = 40) -> np.ndarray:
    """tables[k][b][v]: byte b of a CRC-32 with value v, moved on by 2**k zero bytes."""
    one = np.zeros(32, np.uint32)  # the operator of one zero bit, by columns
    one[0] = 0xEDB88320
    one[1:] = np.uint32(1) << np.arange(31, dtype=np.uint32)

    def times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for i in range(32):
            out ^= np.where((v >> np.uint32(i)) & np.uint32(1) == 1, m[i], np.uint32(0))
        return out

    for _ in range(3):
        one = times(one, one)
    tables = np.zeros((levels, 4, 256), np.uint32)
    for k in range(levels):
        for b in range(4):
            tables[k, b] = times(one, np.arange(256, dtype=np.uint32) << np.uint32(8 * b))
        one = times(one, one)
    return tables


def shifted(crc: np.ndarray, after: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Each CRC's share in the CRC of a stream that goes on for ``after`` bytes."""
    crc, after = crc.astype(np.uint32), after.astype(np.int64)
    for k in range(len(tables)):
        on = np.flatnonzero((after >> k) & 1)
        if len(on):
            v = crc[on]
            crc[on] = tables[k, 0][v & 255] ^ tables[k, 1][(v >> 8) & 255] ^ tables[k, 2][(v >> 16) & 255] ^ tables[k, 3][v >> 24]
    return crc


def stored_chunks(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """digest, n and crc (of the ids as four bytes each) of every chunk, read back and checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("payload").to_pylist()
            for name, data in zip(batch.column("digest").to_pylist(), found, strict=True):
                if digest(data) != name:
                    raise ValueError(f"stored chunk {name.hex()} does not match its digest")
            ends = np.cumsum([0, *map(len, found)]) // width
            wide = memoryview(np.frombuffer(b"".join(found), f"<u{width}").astype("<u4").tobytes())
            crc = [zlib.crc32(wide[4 * i : 4 * j]) for i, j in pairwise(ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=["digest", "n", "crc"])

    return spark.read.parquet(f"{path}/chunks").mapInArrow(run, "digest binary, n long, crc long")


def read_back(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    Stored chunks are checked against their digests, and each document's root is
    made again from the digests of the chunks that were read.
    """
    verify_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = spark.read.parquet(f"{path}/manifest").select("part", F.col("start").alias("part_start"))
    whole = ["row", "doc_id", "part", "start_in_part", "root"]
    lines = recipes.select(*whole, F.posexplode(F.arrays_zip("digests", "after")).alias("seq", "c"))
    lines = lines.select(*whole, "seq", F.col("c.digests").alias("digest"), (4 * F.col("c.after")).alias("after"))
    met = lines.join(stored_chunks(spark, path, width), "digest", "left")
    listed = met.groupBy(*whole).agg(F.array_sort(F.collect_list(F.struct("seq", "digest", F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"), "after"))).alias("c"))
    tables = shift_tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("c")
            rows, ends = c.flatten(), np.cumsum([0, *(len(x) for x in c)])
            n = rows.field("n").to_numpy()
            if (n < 0).any():
                raise ValueError("a recipe names a chunk that the store lacks")
            digests = rows.field("digest").to_pylist()
            for root, i, j in zip(batch.column("root"), ends, ends[1:], strict=False):
                if merkle(digests[i:j]) != root.as_py():
                    raise ValueError("a document does not match its root")
            share = shifted(rows.field("crc").to_numpy(), rows.field("after").to_numpy(), tables)
            first = ends[:-1]
            tokens, crc = (op.reduceat(v, first) if len(v) else v for op, v in ((np.add, n), (np.bitwise_xor, share)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "part", "start_in_part")), pa.array(tokens), pa.array(crc.astype(np.int64))], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    kind = recipes.schema["doc_id"].dataType.simpleString()
    docs = listed.select("doc_id", "part", "start_in_part", "root", "c").mapInArrow(run, f"doc_id {kind}, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return docs.join(parts, "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Make every part's root again from the recipes' roots, and the root of all from the parts'."""
    found = _part_roots(spark.read.parquet(f"{path}/recipes"))
    manifest = spark.read.parquet(f"{path}/manifest")
    named = manifest.select("part", F.col("docs").alias("d"), F.col("root").alias("r"))
    wrong = found.join(named, "part", "full").where("NOT (docs <=> d AND root <=> r)").select("part")
    top = _whole_root(manifest).alias("a").join(spark.read.parquet(f"{path}/root").alias("b"), F.lit(True), "full").where("NOT (a.docs <=> b.docs AND a.ids <=> b.ids AND a.root <=> b.root)").select(F.lit(-1).alias("part"))
    if not wrong.unionByName(top).isEmpty():
        raise ValueError("the recipes do not match the manifest")


def reconstruct(spark: SparkSession, path: str, rows: DataFrame | None = None, width: int = 2) -> DataFrame:
    """doc_id, row and ids of the documents, or of those whose doc_id ``rows`` has, checked against their roots."""
    recipes = spark.read.parquet(f"{path}/recipes")
    recipes = recipes if rows is None else recipes.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    lines = recipes.select("row", "doc_id", "root", F.posexplode("digests").alias("seq", "digest"))
    met = lines.join(spark.read.parquet(f"{path}/chunks"), "digest", "left")
    whole = met.groupBy("row", "doc_id", "root").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for root, chunks in zip(batch.column("root"), batch.column("c"), strict=True):
                data = [c["payload"].as_py() for c in chunks]
                if None in data or merkle([digest(x) for x in data]) != root.as_py():
                    raise ValueError("a document does not match its root")
                ids.append(np.frombuffer(b"".join(data), f"<u{width}").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "row", "ids"])

    kind = recipes.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"doc_id {kind}, row long, ids array<int>")


def op6_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "store")
    write_store(read(spark, sf_dir, "documents"), path)
    return read_back(spark, path)

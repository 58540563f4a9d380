"""Byte-level BPE by a transducer lexicon, exact for every text.

A text is cut at the tokenizer's special strings, and between them before each
space that follows no white space, where no pre-token can span. The distinct
chunks of a slice of texts that a worker has not seen lately are looked up in a
minimal acyclic transducer (``lexicon``) compiled from the corpus's frequent
chunks with their ids and memory-mapped by every worker, all in lockstep. Chunks
that it lacks are split by the pre-tokenizer's pattern and merged by rank, so the
lexicon decides the speed and never the ids.

Chunks are counted over all documents: each task keeps Misra-Gries counters of
bounded size, the counters are added up, and the ``words`` most frequent are
compiled; of those equally frequent that do not all fit a share by hash. The file goes to the
shared folder and from there to executors as a Spark file, also to those that join
later.

Defined results: a null text is an empty one, with no ids; special strings in
a text become their ids, as in the reference library; texts where white space
follows a space take the exact path whole; a word of n bytes is merged in
O(n log n), so texts and words of any length are processed whole; repeated rows
give repeated results; an empty table gives an empty lexicon and result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwarden.llm.lexicon import Lexicon, compile_lexicon
from inkwarden.llm.text import read
from inkwarden.session import fresh_path, stage

#: Fixed value: the pre-tokenizer's pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON_WORDS, WORD_BYTES, COUNTERS = 65_536, 48, 65_536
#: Characters of text looked up together, and entries of a memo before it starts anew.
SLICE_BYTES, MEMO = 4 << 20, 400_000
#: Bytes of a word from which on it is merged by a heap.
LONG_WORD = 96
#: Rows whose results are held together, and words that are merged in lockstep.
BATCH, LOCKSTEP = 2048, 4096
#: Above any merge.
NEVER = 1 << 62


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file, as character to byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """A dict that starts anew when it holds ``limit`` entries."""

    def __init__(self, limit: int = MEMO):
        super().__init__()
        self.limit = limit

    def __setitem__(self, key, value) -> None:
        if len(self) >= self.limit:
            self.clear()
        super().__setitem__(key, value)


class Pairs:
    """What pairs of ids become, by rank, looked up for whole arrays in an open-addressing table."""

    def __init__(self, merges: dict[int, int]):
        keys, goals = np.array(list(merges), np.int64), np.array(list(merges.values()), np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.goals = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            first = left[free][np.unique(at[left[free]], return_index=True)[1]]  # one key a slot
            self.keys[at[first]], self.goals[at[first]] = keys[first], goals[first]
            left = np.setdiff1d(left, first, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | result of each pair, ``NEVER`` for those that do not merge."""
        want = left.astype(np.int64) << 32 | right
        at = self._slot(want)
        out = np.full(len(want), NEVER, np.int64)
        open_ = np.arange(len(want))
        while len(open_):
            found = self.keys[at[open_]]
            hit = found == want[open_]
            out[open_[hit]] = self.goals[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out


class Bpe:
    """Encoding and decoding with a vocabulary file of the byte-level family."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text("utf-8"))
        vocab = spec["model"]["vocab"]
        to_byte = byte_characters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            if token not in special:
                self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = [vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        self.merges: dict[int, int] = {}  # (left << 32 | right): rank << 32 | what they become
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
        self.pairs = Pairs(self.merges)
        byte = np.array(self.byte_ids)
        self.byte_pairs = self.pairs.of(np.repeat(byte, 256), np.tile(byte, 256))
        self.pattern = regex.compile(PATTERN)
        self.library = None
        self.words = Memo()

    def merged(self, word: bytes) -> list[int]:
        """The ids of one pre-token: the lowest-ranked pair merges first, the leftmost of equals."""
        if len(word) > LONG_WORD:
            return self._merged_long(word)
        ids = [self.byte_ids[b] for b in word]
        get = self.merges.get
        # what each neighbouring pair becomes, by rank; two neighbours change with a merge
        goals = [get(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while goals and (best := min(goals)) != NEVER:
            i = goals.index(best)
            ids[i] = best & 0xFFFFFFFF
            del ids[i + 1], goals[i]
            if i < len(goals):
                goals[i] = get(ids[i] << 32 | ids[i + 1], NEVER)
            if i:
                goals[i - 1] = get(ids[i - 1] << 32 | ids[i], NEVER)
        return ids

    def _merged_long(self, word: bytes) -> list[int]:
        """``merged`` by a heap of pairs over a linked list, O(n log n). A merged pair's right place becomes -1."""
        ids = [self.byte_ids[b] for b in word]
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # (rank, place, what they become) in one integer, and the pair it stands for
        heap = [(g >> 32) << 64 | i << 32 | g & 0xFFFFFFFF for i in range(n - 1) if (g := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, goal = top >> 32 & 0xFFFFFFFF, top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            now = get(ids[i] << 32 | ids[j])
            if now is None or now >> 32 != top >> 64 or now & 0xFFFFFFFF != goal:
                continue  # one of the two has merged since
            ids[i], ids[j] = goal, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (g := get(goal << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (g >> 32) << 64 | i << 32 | g & 0xFFFFFFFF)
            h = before[i]
            if h >= 0 and (g := get(ids[h] << 32 | goal)) is not None:
                heapq.heappush(heap, (g >> 32) << 64 | h << 32 | g & 0xFFFFFFFF)
        return [x for x in ids if x >= 0]

    def merged_many(self, words: list[bytes]) -> list[bytes]:
        """``merged`` of each word, as bytes of four an id: words of like lengths in lockstep, a merge of each a step."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), LOCKSTEP):
            part = order[at : at + LOCKSTEP]
            width = len(words[part[-1]])
            if width > LONG_WORD:
                for i in part:
                    out[i] = array("I", self.merged(words[i])).tobytes()
                continue
            ids, n = self._merged_rows(np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in part]), np.uint8).reshape(len(part), width), np.array([len(words[i]) for i in part]))
            data, ends = ids.astype("<u4").tobytes(), np.cumsum(4 * n).tolist()
            begin = 0
            for i, end in zip(part, ends, strict=True):
                out[i], begin = data[begin:end], end
        return out

    def _merged_rows(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and how many each row has."""
        places = np.arange(data.shape[1])
        ids = np.array(self.byte_ids, np.int64)[data]
        ids[places >= size[:, None]] = -1
        goal = np.full(data.shape, NEVER, np.int64)
        goal[:, :-1] = self.byte_pairs[data[:, :-1].astype(np.int64) << 8 | data[:, 1:]]
        goal[places >= size[:, None] - 1] = NEVER
        after, before = np.broadcast_to(places + 1, data.shape).copy(), np.broadcast_to(places - 1, data.shape).copy()
        rows = np.arange(len(data))
        while True:
            i = goal[rows].argmin(axis=1)
            best = goal[rows, i]
            live = best < NEVER
            if not live.any():
                break
            rows, i, best = rows[live], i[live], best[live]
            j = after[rows, i]
            ids[rows, i], ids[rows, j], goal[rows, j] = best & 0xFFFFFFFF, -1, NEVER
            k = after[rows, j]
            after[rows, i], goal[rows, i] = k, NEVER
            on = k < size[rows]
            r, a, b = rows[on], i[on], k[on]
            before[r, b] = a
            goal[r, a] = self.pairs.of(ids[r, a], ids[r, b])
            h = before[rows, i]
            on = h >= 0
            r, a, b = rows[on], h[on], i[on]
            goal[r, a] = self.pairs.of(ids[r, a], ids[r, b])
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text.

        Libraries disagree on code points that younger versions of Unicode
        assign, so texts with any go to the tokenizer library's own splitter.
        """
        plain = text[1:] if text[:1] == " " else text
        if plain.isalpha():  # letters alone, behind a space or not
            return [text]
        if plain[-1:] in (".", ",", ";", ":", "!", "?") and plain[:-1].isalpha():
            return [text[:-1], plain[-1]]
        if text.isascii() or text.isprintable() or not any(unicodedata.category(c) == "Cn" for c in text):
            return self.pattern.findall(text)
        if self.library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.library = ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def pretokens(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.split(text):
            if (ids := self.words.get(word)) is None:
                ids = self.merged(word.encode())
                if len(word) <= WORD_BYTES:
                    self.words[word] = ids
            out += ids
        return out

    def parts(self, text: str) -> list[str]:
        """The text between special strings, and these, in turn."""
        return self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]

    def encode(self, text: str | None) -> list[int]:
        """Without a lexicon."""
        return [i for p in self.parts(text or "") for i in ([self.special[p]] if p in self.special else self.pretokens(p))]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def encode_new(self, chunks: list[str], lexicon: Lexicon) -> list[bytes]:
        """The ids of each chunk, as bytes of four an id: by the transducer, or else merged."""
        data = [c.encode("utf-8", "surrogatepass") for c in chunks]
        size = np.fromiter(map(len, data), np.int64, len(data))
        end = np.cumsum(size)
        ranks = lexicon.ranks(np.frombuffer(b"".join(data), np.uint8), end - size, size).tolist()
        offsets, ids = lexicon.offsets.tolist(), lexicon.ids.tobytes()
        out = [ids[4 * offsets[r] : 4 * offsets[r + 1]] if r >= 0 else b"" for r in ranks]
        missing = [i for i, r in enumerate(ranks) if r < 0]
        parts = [self.split(chunks[i]) for i in missing]
        words = list(dict.fromkeys(chain.from_iterable(parts)))
        known = dict(zip(words, self.merged_many([w.encode("utf-8", "surrogatepass") for w in words]), strict=True))
        for i, part in zip(missing, parts, strict=True):
            out[i] = known[part[0]] if len(part) == 1 else b"".join([known[w] for w in part])
        return out


class Known:
    """Records of chunks in two generations: what a full one held and was asked for again goes to the next."""

    def __init__(self, limit: int = MEMO) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.limit = limit

    def of(self, want: set[str], make: Callable[[list[str]], Iterable]) -> dict:
        """A dict that has all of ``want``."""
        missing = want.difference(self.young)
        if len(self.young) + len(missing) > self.limit:
            self.young, self.old = {}, self.young
            missing = want
        new = []
        for x in missing:
            if (record := self.old.get(x)) is None:
                new.append(x)
            else:
                self.young[x] = record
        for at in range(0, len(new), 20_000):
            self.young.update(zip(new[at : at + 20_000], make(new[at : at + 20_000]), strict=True))
        return self.young


class Chunked:
    """Texts by their chunks: each distinct chunk is encoded once and kept as bytes for every view.

    ``encode`` gives the ids of chunks, ``whole`` those of any text, and ``views``
    makes bytes from ids that may be joined over chunks; None stands for the ids alone. A text goes to ``whole``
    if it holds a special string, or white space behind a space.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], Iterable[bytes]], special: Iterable[str], views: Callable[[bytes], tuple[bytes, ...]] | None = None, limit: int = MEMO):
        self.encode, self.whole, self.special, self.views = encode, whole, list(special), views
        self.first, self.rest = Known(limit), Known(limit)

    def _records(self, ids: Iterable[bytes]) -> list:
        return list(ids) if self.views is None else list(map(self.views, ids))

    def _joined(self, found: Iterable) -> tuple[bytes, ...]:
        if self.views is None:
            return (b"".join(found),)
        found = list(found)
        return tuple(b"".join([r[k] for r in found]) for k in range(len(found[0])))

    def _new(self, chunks: list[str]) -> Iterable:
        """Records of chunks behind a space; an empty one for those that white space begins."""
        plain = [f" {x}" for x in chunks if x and not x[0].isspace()]
        records = self._records(self.encode(plain))
        if len(plain) == len(chunks):
            return records
        found = iter(records)
        return [next(found) if x and not x[0].isspace() else b"" for x in chunks]

    def of(self, texts: list[str]) -> Iterator[tuple[bytes, ...]]:
        """For each text the joined bytes of each view."""
        begin, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= SLICE_BYTES or i + 1 == len(texts):
                yield from self._slice(texts[begin : i + 1])
                begin, size = i + 1, 0

    def _slice(self, texts: list[str]) -> Iterator[tuple[bytes, ...]]:
        cut = [None if any(s in t for s in self.special) else t.split(" ") for t in texts]
        first = self.first.of({p[0] for p in cut if p}, lambda new: self._records(self.encode(new)))
        want: set[str] = set()
        for p in cut:
            if p:
                want.update(p[1:])
        rest = self.rest.of(want, self._new)
        odd = {x for x in want if not rest[x]}
        for text, p in zip(texts, cut, strict=True):
            if p is None or (odd and not odd.isdisjoint(p[1:])):
                (record,) = self._records(self.whole([text]))
                yield (record,) if self.views is None else record
            else:
                yield self._joined(chain((first[p[0]],), map(rest.__getitem__, p[1:])))


_open: dict[tuple[str, str | None], object] = {}


def tokenizer(path: str) -> Bpe:
    """One per worker process, so that its memos last."""
    if (path, None) not in _open:
        _open[path, None] = Bpe(path)
    return _open[path, None]


def opened(name: str) -> Lexicon:
    if (name, "lexicon") not in _open:
        _open[name, "lexicon"] = Lexicon(SparkFiles.get(name))
    return _open[name, "lexicon"]


def chunk_counts(docs: DataFrame) -> DataFrame:
    """word and n: frequent chunks of all texts, an underestimate by at most a task's pruned share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                seen.update((text.as_py() or "").split(" ")[1:])
                if len(seen) > 4 * COUNTERS:
                    pruned = sorted(seen.values(), reverse=True)[COUNTERS]
                    seen = Counter({w: n - pruned for w, n in seen.items() if n > pruned})
        top = [(f" {w}".encode(), n) for w, n in seen.most_common(COUNTERS) if n > 1]
        top = [x for x in top if len(x[0]) <= WORD_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compiled(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the frequent chunks of ``docs`` and hand the file to all executors; its name there.

    The driver holds at most ``words`` chunks of at most ``WORD_BYTES`` bytes.
    """
    spark = docs.sparkSession
    counts = stage(chunk_counts(docs), "chunk-counts")
    # counts are few: how many chunks are as frequent or more, and what part of the last count's chunks fits
    sizes = counts.groupBy("n").agg(F.count("*").alias("chunks"))
    ranked = sizes.withColumn("before", F.sum("chunks").over(Window.orderBy(F.desc("n"))) - F.col("chunks")).where(F.col("before") < words)
    least = ranked.orderBy("n").limit(1).collect()
    top: list[bytes] = []
    if least:
        n, share = least[0]["n"], min(1.0, (words - least[0]["before"]) / least[0]["chunks"])
        fits = (F.col("n") > n) | ((F.col("n") == n) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))))
        top = sorted(bytes(r["word"]) for r in counts.where(fits).select("word").collect())
    bpe = Bpe(path)
    where = fresh_path(spark, "lexicon") + ".bin"
    write_bytes(spark, where, compile_lexicon(top, [bpe.pretokens(w.decode()) for w in top]))
    spark.sparkContext.addFile(where)
    return where.rsplit("/", 1)[1]


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()


def _each(docs: DataFrame, columns: list[str], schema: str, path: str, name: str, views, arrays) -> DataFrame:
    """mapInArrow over the views of each batch's texts; ``views`` are made from the tokenizer, ``arrays`` makes the added columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, lexicon = tokenizer(path), opened(name)
        whole = lambda texts: (np.array(bpe.encode(t), "<u4").tobytes() for t in texts)
        chunked = Chunked(lambda new: bpe.encode_new(new, lexicon), whole, bpe.special, views(bpe))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                added = arrays(chunked.of([t or "" for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *added.values()], names=[*columns, *added])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, *[c for c in ("text",) if c not in columns]).mapInArrow(run, f"{kept}, {schema}")


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int32)


def encoded(docs: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """``columns`` and ``ids``, the token ids of each text."""
    path = path or vocabulary_path()

    def arrays(found: Iterator[tuple[bytes, ...]]) -> dict[str, pa.Array]:
        return {"ids": pa.array([_ids(ids) for (ids,) in found], pa.list_(pa.int32()))}

    return _each(docs, columns, "ids array<int>", path, compiled(docs, path), lambda bpe: None, arrays)


def digests(docs: DataFrame, columns: list[str], path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``columns``, n_tokens, ids_sha256 and decoded_sha256: each text encoded, then decoded again; ``ids`` if asked for."""
    path = path or vocabulary_path()

    def views(bpe: Bpe) -> Callable[[bytes], tuple[bytes, ...]]:
        decimal, token = [b",%d" % i for i in range(len(bpe.bytes_of))].__getitem__, bpe.bytes_of.__getitem__

        def of(ids: bytes) -> tuple[bytes, ...]:
            listed = memoryview(ids).cast("I").tolist()
            seen = b"".join(map(decimal, listed)), b"".join(map(token, listed))
            return (*seen, ids) if with_ids else seen

        return of

    def arrays(found: Iterator[tuple[bytes, ...]]) -> dict[str, pa.Array]:
        n, ids_sha, text_sha, kept = [], [], [], []
        for decimals, data, *ids in found:
            n.append(decimals.count(b","))
            ids_sha.append(hashlib.sha256(memoryview(decimals)[1:]).hexdigest())
            text_sha.append(hashlib.sha256(valid_utf8(data)).hexdigest())
            kept += map(_ids, ids)
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())} | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if with_ids else {})

    return _each(docs, columns, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, path, compiled(docs, path), views, arrays)


def valid_utf8(data: bytes) -> bytes:
    """The bytes of the decoded text: what is no UTF-8 is replaced."""
    try:
        data.decode()
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode()
    return data


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), ["doc_id"])

"""Merkle dataset manifest: one tree a group of rows, one over the groups' roots, and a proof for every row.

Leaves are sorted by range: by group, then by the row's order. While a partition
streams by, its leaves are packed into chunks of ``Tree.chunk`` at most, and a chunk's
first place in its group follows from the counts of the partitions before. Three
consecutive nodes, the last run maybe fewer, become one. Each chunk builds what is
complete inside it; only the ragged nodes at its two edges are shuffled, by the
coordinate of the aligned block of 3 ** ``Tree.levels`` leaves that they fall in. A
block finishes its subtree and hands its top to the block above, until one node of the
group is left. The way back is the same: a ragged node's siblings come from its block,
the block's from the one above, and a chunk joins them to its own for every leaf.
The groups' roots are the leaves of one more such tree.

No task holds more than a block, a chunk or a partition's stream, and a group with a
third of all rows is spread like any other: repeated rows are told apart by their
place in the input. Blocks, chunks and leaves are staged, so a lost executor costs
one of these steps.

A node is the lowercase hex sha256 of its children's hex digests, joined. A leaf is the
digest of its fields, each ``-`` if null and else its length in bytes, a colon and it.

Defined results: rows without an id come first in their group, rows that agree in
order are sorted by leaf; equal rows have equal leaves and places of their own; a lone
leaf is its group's root and a lone group's root the root; a leaf without siblings has
the digest of nothing as proof digest; an empty table gives an empty result; texts and
other columns stay behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkwarden.llm.sharding import group_key
from inkwarden.llm.text import read
from inkwarden.session import stage

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Tree:
    chunk: int = 4096  # leaves that a partition packs into one row
    levels: int = 9  # of a block; ARITY ** levels is not under chunk


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(framed, fields)).cast("binary"), 256)


# ---------------------------------------------------------------- nodes


def width(leaves: int, level: int) -> int:
    """Nodes at a level of a tree over so many leaves."""
    return -(-leaves // ARITY**level)


@dataclass
class Part:
    """Known nodes of one group's tree: digests by level and place, built upward as far as they are complete."""

    leaves: int
    known: dict[int, dict[int, str]] = field(default_factory=dict)

    def build(self, top: int) -> None:
        """Parents up to ``top`` whose children are all known."""
        level = 0
        while level < top and width(self.leaves, level) > 1:
            nodes, above = self.known.get(level, {}), self.known.setdefault(level + 1, {})
            last = width(self.leaves, level)
            for parent in {place // ARITY for place in nodes}:
                children = [nodes.get(k) for k in range(ARITY * parent, min(ARITY * (parent + 1), last))]
                if None not in children:
                    above[parent] = digest(*children)
            level += 1

    def whole(self, level: int, place: int) -> bool:
        """Whether the node's parent is known too."""
        return place // ARITY in self.known.get(level + 1, {})

    def ragged(self) -> Iterator[tuple[int, int, str]]:
        """Known nodes whose parent is not known."""
        return ((level, place, d) for level, nodes in self.known.items() for place, d in nodes.items() if not self.whole(level, place))

    def siblings(self, level: int, place: int) -> tuple[list[str], list[str]]:
        """The other nodes of the run, left and right."""
        nodes, first = self.known[level], place - place % ARITY
        run = range(first, min(first + ARITY, width(self.leaves, level)))
        return [nodes[k] for k in run if k < place], [nodes[k] for k in run if k > place]

    def climb(self, level: int, place: int) -> tuple[list[tuple[list[str], list[str]]], int, int]:
        """The siblings from a node up to the last known ancestor, and that ancestor."""
        steps = []
        while self.whole(level, place):
            steps.append(self.siblings(level, place))
            level, place = level + 1, place // ARITY
        return steps, level, place


#: The siblings on the way up from a node, level by level.
PATH = "array<struct<left: array<string>, right: array<string>>>"


def _path(steps) -> list[dict]:
    return [{"left": left, "right": right} for left, right in steps]


def _steps(path) -> list[tuple[list[str], list[str]]]:
    return [(list(s["left"]), list(s["right"])) for s in path]


def folded(start: str, steps) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in steps:
        start = digest(*left, start, *right)
    return start


# ---------------------------------------------------------------- packing


def _packer(chunk: int, schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of one group, in the order of the stream, as rows of at most ``chunk`` leaves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, place = TaskContext.get().partitionId(), None, 0
        held: list[pa.Array] = []
        count = 0

        def packed() -> pa.RecordBatch:
            nonlocal held, count, place
            items = pa.concat_arrays(held)
            out = pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part], pa.int32()), pa.array([place], pa.int64()), pa.array([count], pa.int64()), pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), items)], schema=schema)
            held, place, count = [], place + count, 0
            return out

        for batch in batches:
            groups, items = batch.column("g").to_pylist(), batch.column("item")
            begin = 0
            while begin < len(groups):
                if groups[begin] != at:
                    if held:
                        yield packed()
                    at, place = groups[begin], 0
                end = begin
                while end < len(groups) and groups[end] == at and count + end - begin < chunk:
                    end += 1
                held.append(items.slice(begin, end - begin))
                count += end - begin
                if count == chunk:
                    yield packed()
                begin = end
        if held:
            yield packed()

    return run


def chunked(leaves: DataFrame, order: list[str], tree: Tree) -> tuple[DataFrame, DataFrame]:
    """Chunks (id, g, lo, count, items) of ``leaves`` (g, ``order`` columns, leaf and others), and the number of leaves of each g."""
    items = [c for c in leaves.columns if c != "g"]
    rows = leaves.withColumn("_at", F.monotonically_increasing_id())
    keys = ["g", *order, "leaf", "_at"]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("g", F.struct(*items).alias("item"))
    item = sorted_rows.schema["item"].dataType
    schema = T.StructType.fromDDL("g string, part int, place long, count long").add("items", T.ArrayType(item))
    packed = stage(sorted_rows.mapInArrow(_packer(tree.chunk, _arrow(schema)), schema), "manifest-chunks")
    counts = packed.groupBy("g", "part").agg(F.sum("count").alias("rows"))
    upto = Window.partitionBy("g").orderBy("part")
    starts = counts.select("g", "part", (F.sum("rows").over(upto) - F.col("rows")).alias("start"))
    placed = packed.select("g", "part", "place", "count").join(starts, ["g", "part"]).select("g", "part", "place", "count", (F.col("start") + F.col("place")).alias("lo"))
    total = stage(counts.groupBy("g").agg(F.sum("rows").alias("n")), "manifest-counts")
    spans = stage(placed.join(total, "g").select(_chunk_id().alias("id"), "lo", "n"), "manifest-spans")
    return packed.withColumn("id", _chunk_id()).join(spans, "id").select("id", "g", "n", "lo", "items"), total


def _chunk_id() -> Column:
    """A chunk is known by its partition, its group and its place there."""
    return F.struct("part", "g", "place")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# ---------------------------------------------------------------- up


ID = "struct<part: int, g: string, place: long>"
NODE = f"id {ID}, g string, n long, level int, place long, digest string"


def _chunk_part(row: dict, tree: Tree) -> Part:
    part = Part(row["n"], {0: {row["lo"] + k: x["leaf"] for k, x in enumerate(row["items"])}})
    part.build(tree.levels)
    return part


def _edges(tree: Tree):
    schema = _arrow(T.StructType.fromDDL(NODE))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                found = _chunk_part(row, tree).ragged()
                yield pa.RecordBatch.from_pylist([{"id": row["id"], "g": row["g"], "n": row["n"], "level": a, "place": b, "digest": d} for a, b, d in found], schema=schema)

    return run


UP = f"{NODE}, path {PATH}, top boolean"


def _finish(low: int, tree: Tree):
    """The nodes of one block, from level ``low`` on: each with its siblings up to the block's top, and the top itself."""

    schema = _arrow(T.StructType.fromDDL(UP))

    def run(nodes: pa.Table) -> pa.Table:
        rows = nodes.drop_columns("block").to_pylist()
        part = Part(rows[0]["n"])
        for r in rows:
            part.known.setdefault(r["level"], {})[r["place"]] = r["digest"]
        part.build(low + tree.levels)
        out, ends = [], {}
        for r in rows:
            steps, level, place = part.climb(r["level"], r["place"])
            ends[level, place] = part.known[level][place]
            out.append(r | {"path": _path(steps), "top": False})
        out += [{"id": None, "g": rows[0]["g"], "n": rows[0]["n"], "level": a, "place": b, "digest": d, "path": [], "top": True} for (a, b), d in ends.items()]
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _block(high: int) -> Column:
    """The place of a node's ancestor at level ``high``."""
    return F.expr(f"place div cast(power({ARITY}, {high} - least(level, {high})) as bigint)")


def climbed(edges: DataFrame, most: int, tree: Tree) -> tuple[DataFrame, DataFrame]:
    """``edges`` with the path to their group's root, and the root of each group (g, root).

    ``most`` is the number of leaves of the largest group; a round of blocks climbs ``tree.levels`` levels.
    """
    nodes, rounds, low = edges, [], 0
    while True:
        high = low + tree.levels
        keyed = nodes.withColumn("block", _block(high))
        done = stage(keyed.groupBy("g", "block").applyInArrow(_finish(low, tree), UP), "manifest-blocks")
        rounds.append((high, done))
        if ARITY**high >= most:
            break
        nodes, low = done.where("top").select(*edges.columns), high
    # downward: what is above a block joins its nodes
    high, last = rounds[-1]
    roots = last.where("top").select("g", F.col("digest").alias("root"))
    paths = last.where("NOT top").select(*edges.columns, "path")
    for high, below in reversed(rounds[:-1]):
        above = paths.select("g", F.col("place").alias("block"), F.col("path").alias("rest"))
        paths = below.where("NOT top").withColumn("block", _block(high)).join(above, ["g", "block"]).select(*edges.columns, F.concat("path", "rest").alias("path"))
    return paths, roots


# ---------------------------------------------------------------- the forest and its proofs


def forest(leaves: DataFrame, order: list[str], tree: Tree = Tree()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chunks of ``leaves``; for each chunk's id and g the ``ways`` up (level, place and path of its ragged nodes); the root of each g."""
    chunks, total = chunked(leaves, order, tree)
    most = total.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    edges = stage(chunks.mapInArrow(_edges(tree), NODE), "manifest-edges")
    paths, roots = climbed(edges, most, tree)
    ways = paths.groupBy("id", "g").agg(F.collect_list(F.struct("level", "place", "path")).alias("ways"))
    return chunks, ways, stage(roots, "manifest-roots")


def _proofs(tree: Tree, result: pa.Schema):
    """One row a leaf: its fields, its place and the siblings on the whole way up, or what these lead to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                part = _chunk_part(row, tree)
                ways = {(w["level"], w["place"]): _steps(w["path"]) for w in row["ways"]}
                over = _steps(row["over"])
                out = []
                for j, item in enumerate(row["items"]):
                    steps, level, place = part.climb(0, row["lo"] + j)
                    steps = [*steps, *ways[level, place], *over]
                    found = item | {"g": row["g"], "place": row["lo"] + j, "subroot": row["subroot"], "root": row["root"]}
                    found["proof_sha256"] = digest(*(s for left, right in steps for s in (*left, *right)))
                    found["folded_root"] = folded(item["tampered"] or item["leaf"], steps)
                    out.append(found | {"path": _path(steps)} if "path" in result.names else found)
                yield pa.RecordBatch.from_pylist(out, schema=result)

    return run


def _proved(chunks: DataFrame, ways: DataFrame, tree: Tree, paths: bool) -> DataFrame:
    """The proofs of all leaves; ``ways`` has over, subroot and root as well."""
    item = chunks.schema["items"].dataType.elementType.fields
    more = T.StructType.fromDDL("g string, place long, subroot string, root string, proof_sha256 string, folded_root string" + (f", path {PATH}" if paths else ""))
    schema = T.StructType([*item, *more.fields])
    return chunks.join(ways.drop("g"), "id").mapInArrow(_proofs(tree, _arrow(schema)), schema)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, order: str = "doc_id", group: str = "source", tampered: Column | None = None, tree: Tree = Tree(), paths: bool = True) -> DataFrame:
    """key (the value of ``order``), leaf, g, place, subroot, root, path, proof_sha256, folded_root and verified of each row.

    ``tampered`` is the leaf that a checker finds in place of the first one, null where
    it is the same: what it folds to is ``folded_root``. Without ``paths`` these are left out.
    """
    own = leaf(*map(F.col, fields))
    other = F.lit(None).cast("string") if tampered is None else tampered
    leaves = docs.select(group_key(F.col(group)).alias("g"), F.col(order).alias("key"), own.alias("leaf"), other.alias("tampered"))
    chunks, ways, subroots = forest(stage(leaves, "manifest-leaves"), ["key"], tree)
    # the groups' roots, in the order of their keys, are the leaves of the upper tree
    upper = subroots.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("tampered"))
    tops, up, roots = forest(upper, ["key"], tree)
    up = up.join(roots, "g").select("*", F.array().cast(PATH).alias("over"), F.lit("").alias("subroot"))
    over = _proved(tops, up, tree, paths=True).select(F.col("key").alias("g"), F.col("leaf").alias("subroot"), "root", F.col("path").alias("over"))
    # a group's chunks may be many: only their narrow ways meet its one row
    found = _proved(chunks, ways.join(stage(over, "manifest-over"), "g"), tree, paths)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_manifest(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    tampered = F.when(changed, leaf(*map(F.col, FIELDS[:-1]), F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return manifest(docs, tampered=tampered, paths=False).select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

"""Sharding by proportional stratified interleaving, in native operations.

The rows of a source are shuffled by a seeded hash and ranked. Row ``r`` of the
``n`` rows of its source has the fractional rank (2r + 1) / 2n. All rows sorted by
fractional rank, equal ones by source, are cut into ``shards`` runs whose counts
differ by one at most. A source's fractional ranks are evenly spaced, so every
shard, and every stretch within one, has the mixture of the whole.

No task sorts more than a few thousand rows of one key. A source's rows are ranked
inside ranges of the hash, to which the counts of the ranges before are added; the
global order is made inside ranges of the fractional rank, evenly filled whatever
the sources, in the same way. The number of ranges grows with the rows. Only ids,
sizes and hashes travel; ``sharded_documents`` moves each text once, to its shard,
which it finds by the last hash of its source in each shard.

Defined results: a null text counts no bytes and has the checksum of an empty one;
the null source is a source like any other and comes first; the hash is of the id,
size and checksum, so repeated rows stand side by side in their source's order and
still get places of their own; an empty table gives an empty result; with fewer rows
than shards some shards stay empty; other columns are ignored by ``plan`` and
carried by ``sharded_documents``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwarden.llm.text import read
from inkwarden.session import stage


@dataclass(frozen=True)
class Shards:
    shards: int = 8
    seed: int = 20_240_611
    range_rows: int = 4096  # rows of a range that one window sorts, on average
    #: Bytes of the shards' last hashes that may be broadcast to the texts; beyond, they are joined.
    broadcast_bytes: int = 32 << 20


#: Bits of the shuffling hash that are used.
BITS = 60


def group_key(source: Column) -> Column:
    """A key without nulls that sorts as the source does, null first."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _measures(rule: Shards) -> tuple[Column, Column, Column]:
    """Size, checksum and shuffling hash of a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    digest = F.md5(F.concat_ws(":", F.lit(rule.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), size, crc).cast("binary"))
    return size, crc, F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _ranges(rows: int, rule: Shards) -> int:
    """Bits of the number of ranges."""
    return max(0, (-(-rows // rule.range_rows) - 1).bit_length())


def ranked(sizes: DataFrame, bits: int) -> DataFrame:
    """``sizes`` with rank (from 0, in the source's shuffled order) and n (the source's rows)."""
    at = sizes.withColumn("range", F.shiftright("perm", BITS - bits))
    cells = at.groupBy("g", "range").agg(F.count("*").alias("rows"))
    whole = Window.partitionBy("g")
    upto = F.sum("rows").over(whole.orderBy("range")) - F.col("rows")
    starts = cells.select("g", "range", upto.alias("before"), F.sum("rows").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy("g", "range").orderBy("perm", "doc_id", "size")) - 1
    return at.withColumn("inside", inside).join(starts, ["g", "range"]).select(*sizes.columns, (F.col("before") + F.col("inside")).alias("rank"), "n")


def interleaved(ranks: DataFrame, bits: int) -> DataFrame:
    """``ranks`` with pos: the place (from 0) by fractional rank, then source."""
    at = ranks.withColumn("range", F.expr(f"(2 * rank + 1) * {1 << bits}L div (2 * n)"))
    cells = at.groupBy("range").agg(F.count("*").alias("rows")).withColumn("coarse", F.shiftright("range", 10))
    coarse = cells.groupBy("coarse").agg(F.sum("rows").alias("all"))
    coarse = coarse.select("coarse", (F.sum("all").over(Window.orderBy("coarse")) - F.col("all")).alias("base"))
    fine = F.sum("rows").over(Window.partitionBy("coarse").orderBy("range")) - F.col("rows")
    starts = cells.withColumn("fine", fine).join(coarse, "coarse").select("range", (F.col("base") + F.col("fine")).alias("before"))
    # the nearest doubles of two fractions are equal where the fractions are
    inside = F.row_number().over(Window.partitionBy("range").orderBy((2 * F.col("rank") + 1) / (2 * F.col("n")), "g", "rank")) - 1
    return at.withColumn("inside", inside).join(starts, "range").select(*ranks.columns, (F.col("before") + F.col("inside")).cast("long").alias("pos"))


def plan(docs: DataFrame, rule: Shards = Shards()) -> DataFrame:
    """doc_id, source, size, text_crc32, g, perm, rank and n in the source, pos, shard and slot of each row."""
    size, crc, perm = _measures(rule)
    sizes = stage(docs.select("doc_id", "source", group_key(F.col("source")).alias("g"), size.alias("size"), crc.alias("text_crc32"), perm.alias("perm")), "shard-sizes")
    rows = sizes.count()
    bits = _ranges(rows, rule)
    placed = interleaved(stage(ranked(sizes, bits), "shard-ranks"), bits)
    shard = F.expr(f"pos * {rule.shards} div {max(rows, 1)}L")
    first = F.expr(f"(shard * {rows}L + {rule.shards - 1}) div {rule.shards}")
    return placed.withColumn("shard", shard).withColumn("slot", (F.col("pos") - first).cast("long")).withColumn("shard", F.col("shard").cast("int"))


def sharded_documents(docs: DataFrame, rule: Shards = Shards()) -> DataFrame:
    """The documents with the columns they came with, each shard in one partition and there in seeded order.

    Rows that agree in id and text and stand at a cut all go to the shard before it.
    """
    ends = plan(docs, rule).groupBy("g", "shard").agg(F.max("perm").alias("perm"))
    ends = stage(ends.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("perm", "shard"))).alias("ends")), "shard-ends")
    size = ends.agg(F.coalesce(F.sum(F.size("ends") * 16 + 48), F.lit(0)).alias("n")).first()["n"]
    ends = F.broadcast(ends) if size <= rule.broadcast_bytes else ends
    body = docs.select(F.struct(*docs.columns).alias("_row"), group_key(F.col("source")).alias("g"), _measures(rule)[2].alias("_perm"))
    shard = F.get(F.filter("ends", lambda e: e["perm"] >= F.col("_perm")), 0)["shard"]
    met = body.join(ends, "g").select("_row", "_perm", shard.alias("_shard"))
    dealt = met.repartitionById(rule.shards, F.col("_shard")).sortWithinPartitions("_shard", F.xxhash64("_perm"), "_perm")
    return dealt.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    out = plan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "pos")

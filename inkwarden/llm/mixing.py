"""Mixing sources to target weights by a hypergeometric splitting tree, in native operations.

Sources take their weights in code-point order (null last) from a repeating
list. They share ``share`` times all words by weight; a target stops at ``cap``
times its source's words and what is over goes to the others by weight (water
filling, solved in closed form over the sorted saturation points). A source's
documents are permuted by a seeded hash and cut into blocks of at most
``block_words`` words; a pass over a source has a quota of blocks, so that a
source gives exactly its target, rounded to whole words, and at most one
document a pass is cut. The exact block quotas of all sources and passes are
the root of a binary tree over the output shards: at each node a multivariate
hypergeometric draw, seeded by the node, splits every quota between the halves.
A shard draws the next so many of a source's permuted blocks, so draws are
disjoint, and shuffles what it drew by a seeded hash. A document's words in the
mix are the sum of its draws. The number of shards grows with the mix.

Everything is a function of the seed, the ids and the texts: reruns agree,
whatever the partitioning. Permuted positions come from per-bucket counts and a
window inside each hash bucket, so a source with a third of all rows never
meets in one task; draws meet documents by stretches of a source's blocks. One
row holds the quotas of a node, so sources are counted in millions at most.

Defined results: null and empty texts have no words, are never taken and count
nothing; the null source is a source like any other; repeated rows are rows of
their own, each with a place in the permutation; an empty table gives an empty
mix; a source without words has target zero; columns beyond doc_id, source and
text are ignored by ``plan`` and carried by ``mixed_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwarden.llm.quality_rules import let
from inkwarden.llm.text import n_words, read, words
from inkwarden.session import stage


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    block_words: int = 256
    shards: int | None = None  # a power of two; None: as many as ``shard_words`` asks for
    shard_words: int = 1 << 22
    buckets: int = 1024  # windows inside a source
    stretch: int = 4096  # blocks of a source that meet their draws under one key
    seed: int = 20_240_517
    #: Bytes of the places of shards that may be broadcast to the texts; beyond, they are joined.
    broadcast_bytes: int = 32 << 20


def _permutation(mix: Mix) -> Column:
    return F.xxhash64(F.lit(mix.seed), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def sized(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, source, size, blocks and the place in the permutation, without the text."""
    size = n_words(F.col("text"))
    return docs.select("doc_id", "source", size.alias("size"), _permutation(mix).alias("perm")).withColumns({
        "bucket": F.pmod("perm", F.lit(mix.buckets)).cast("int"),
        "blocks": F.ceil(F.col("size") / mix.block_words).cast("long"),
    })


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """source, source_size and target. One row per source: the windows see no more."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = totals.withColumn("weight", F.get(F.array(*map(F.lit, mix.weights)), n % len(mix.weights)).cast("double"))
    ordered = weighted.withColumn("ceiling", (mix.cap * F.col("source_size")).cast("double"))
    by_level = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, every = by_level.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    ordered = ordered.withColumns({"before": F.sum("ceiling").over(upto) - F.col("ceiling"), "left": F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"), "total": F.sum("source_size").over(every) * F.lit(mix.share)})
    # the water level is the largest of the levels that each saturation point implies
    level = F.max((F.col("total") - F.col("before")) / F.col("left")).over(every)
    return ordered.withColumn("level", level).select("source", "source_size", F.least(F.col("weight") * F.col("level"), "ceiling").alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def placed(sizes: DataFrame, mix: Mix) -> DataFrame:
    """Each document's words before it in its source's permutation, its blocks' ranks and the words of each pass."""
    cells = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("w"), F.sum("blocks").alias("b"))
    order = Window.partitionBy("source").orderBy("bucket")
    starts = cells.select("source", "bucket", (F.sum("w").over(order) - F.col("w")).alias("w0"), (F.sum("b").over(order) - F.col("b")).alias("b0"))
    inside = Window.partitionBy("source", "bucket").orderBy("perm", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sizes.withColumns({"w1": F.sum("size").over(inside) - F.col("size"), "b1": F.sum("blocks").over(inside) - F.col("blocks")})
    out = (
        ranked.alias("d").join(starts.alias("s"), _same("d", "s") & (F.col("d.bucket") == F.col("s.bucket"))).select("d.*", (F.col("w0") + F.col("w1")).alias("words_before"), (F.col("b0") + F.col("b1")).alias("rank")).alias("d")
        .join(targets(sizes, mix).alias("t"), _same("d", "t"))
        .select("d.*", "t.source_size", "t.target")
    )
    due = F.round("target").cast("long")
    takes = [F.least(F.greatest(due - p * F.col("source_size") - F.col("words_before"), F.lit(0)), F.col("size")).alias(f"take{p}") for p in range(mix.cap)]
    return out.select("doc_id", "source", "size", "perm", "bucket", "blocks", "rank", "source_size", "target", F.array(*takes).alias("takes"))


def _hypergeometric(seed: Column, total: Column, good: Column, draws: Column) -> Column:
    """One draw by inversion from the mode outwards; all arguments are doubles.

    The walk covers the support within 12 standard deviations and 12 more on
    each side; what lies beyond has a probability below a double's precision.
    """
    u = (F.pmod(seed, F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    spread = 12 * F.sqrt(F.greatest(draws * good / total * (1 - good / total) * (total - draws) / F.greatest(total - 1, F.lit(1.0)), F.lit(0.0))) + 12
    low = F.greatest(F.lit(0.0), draws - (total - good))
    high = F.least(good, draws)
    mode = F.least(F.greatest(F.floor((draws + 1) * (good + 1) / (total + 2)).cast("double"), low), high)
    up = F.sequence(F.lit(0), F.floor(F.least(high - mode, spread)).cast("int"))
    down = F.sequence(F.lit(0), F.floor(F.least(mode - low, spread)).cast("int"))

    def ratio_up(x: Column) -> Column:  # p(x + 1) / p(x)
        return (good - x) * (draws - x) / ((x + 1) * (total - good - draws + x + 1))

    def ratio_down(x: Column) -> Column:  # p(x - 1) / p(x)
        return x * (total - good - draws + x) / ((good - x + 1) * (draws - x + 1))

    def mass(steps: Column, sign: int, ratio) -> Column:
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
        return F.aggregate(steps, start, lambda a, k: F.struct((a["p"] * ratio(mode + sign * k)).alias("p"), (a["sum"] + a["p"]).alias("sum")), lambda a: a["sum"])

    def walk(steps: Column, sign: int, ratio, aim: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("x"))
        step = lambda a, k: F.struct((a["p"] * ratio(mode + sign * k)).alias("p"), (a["sum"] + a["p"]).alias("sum"), F.coalesce(a["x"], F.when(a["sum"] + a["p"] >= aim, mode + sign * k)).alias("x"))
        return F.aggregate(steps, start, step, lambda a: F.coalesce(a["x"], mode))

    masses = F.struct(mass(up, 1, ratio_up).alias("u"), mass(down, -1, ratio_down).alias("d"))
    drawn = let(masses, lambda m: let(u * (m["u"] + m["d"] - 1), lambda aim: F.when(aim <= m["u"], walk(up, 1, ratio_up, aim)).otherwise(walk(down, -1, ratio_down, aim - m["u"] + 1))))
    return F.when((total <= 0) | (good <= 0) | (draws <= 0), F.lit(0.0)).otherwise(drawn)


def splitting_tree(quotas: DataFrame, mix: Mix) -> DataFrame:
    """source, pass, shard, first and n: the range of permuted blocks that each shard draws.

    ``quotas`` has source, pass and n. A node's row holds the quotas of all
    sources as one array; a level of the tree is one projection and one explode.
    """
    strata = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "pass", "n")))
    node = quotas.groupBy().agg(strata.alias("strata")).where(F.size("strata") > 0).select("strata", F.transform("strata", lambda s: s["n"].cast("double")).alias("n"), F.lit(0).alias("lo"), F.lit(mix.shards).alias("hi"))
    node = node.withColumn("all", F.aggregate("n", F.lit(0.0), lambda a, x: a + x))
    ends = lambda k: F.floor(F.col("all") * k / mix.shards).cast("double")
    for _ in range(mix.shards.bit_length() - 1):
        node = node.withColumn("mid", ((F.col("lo") + F.col("hi")) / 2).cast("int"))
        start = F.struct((ends(F.col("mid")) - ends(F.col("lo"))).alias("draws"), F.aggregate("n", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array().cast("array<double>").alias("out"))

        def split(a: Column, x: Column) -> Column:
            seed = F.xxhash64(F.lit(mix.seed), F.col("lo"), F.col("hi"), F.size(a["out"]))
            return let(_hypergeometric(seed, a["total"], x, a["draws"]), lambda k: F.struct((a["draws"] - k).alias("draws"), (a["total"] - x).alias("total"), F.concat(a["out"], F.array(k)).alias("out")))

        left = F.aggregate("n", start, split, lambda a: a["out"])
        halves = F.array(
            F.struct(F.col("left").alias("n"), F.col("lo"), F.col("mid").alias("hi")),
            F.struct(F.zip_with("n", "left", lambda a, b: a - b).alias("n"), F.col("mid").alias("lo"), F.col("hi")),
        )
        node = node.withColumn("left", left).select("strata", "all", F.explode(halves).alias("h")).select("strata", "all", "h.n", "h.lo", "h.hi")
    leaves = node.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("strata", "n")).alias("z")).select("shard", "z.strata.source", "z.strata.pass", F.col("z.n").cast("long").alias("n"))
    order = Window.partitionBy("source", "pass").orderBy("shard")
    return leaves.withColumn("first", F.sum("n").over(order) - F.col("n"))


def sharded(at: DataFrame, mix: Mix) -> Mix:
    """``mix`` with a number of shards."""
    if mix.shards is not None:
        return mix
    words = at.agg(F.coalesce(F.sum(F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("n")).first()["n"]
    return replace(mix, shards=1 << max(0, -(-words // mix.shard_words) - 1).bit_length())


def _stretches(first: Column, n: Column, mix: Mix) -> Column:
    return F.explode(F.sequence(F.floor(first / mix.stretch), F.floor((first + n - 1) / mix.stretch)))


def drawn(at: DataFrame, mix: Mix) -> DataFrame:
    """``at`` with draws: pass, shard, first block, blocks and words of each, in order."""
    used = F.transform("takes", lambda w, p: F.struct(p.alias("pass"), F.ceil(w / mix.block_words).cast("long").alias("n")))
    quotas = at.select("source", F.explode(used).alias("u")).groupBy("source", "u.pass").agg(F.sum("u.n").alias("n"))
    ranges = splitting_tree(quotas, mix).where("n > 0").withColumn("stretch", _stretches(F.col("first"), F.col("n"), mix))
    ranges = ranges.groupBy("source", "stretch").agg(F.collect_list(F.struct("pass", "shard", "first", "n")).alias("ranges"))

    def piece(r: Column) -> Column:
        take = F.get("takes", r["pass"])
        # the part of the range in this stretch, in blocks of the document
        low = F.greatest(r["first"] - F.col("rank"), F.col("stretch") * mix.stretch - F.col("rank"), F.lit(0))
        high = F.least(r["first"] + r["n"] - F.col("rank"), (F.col("stretch") + 1) * mix.stretch - F.col("rank"), F.ceil(take / mix.block_words).cast("long"))
        return F.struct(r["pass"].alias("pass"), r["shard"].alias("shard"), low.alias("block"), (high - low).alias("blocks"), (F.least(take, high * mix.block_words) - low * mix.block_words).alias("words"))

    names = ["doc_id", "source", "size", "perm", "bucket", "source_size", "target"]
    some = at.where("blocks > 0").withColumn("stretch", _stretches(F.col("rank"), F.col("blocks"), mix)).alias("d")
    met = some.join(ranges.alias("r"), _same("d", "r") & (F.col("d.stretch") == F.col("r.stretch")), "left").select("d.*", "ranges")
    met = met.withColumn("part", F.filter(F.transform("ranges", piece), lambda d: d["blocks"] > 0))
    # a document with blocks is known by its source and rank
    whole = F.array_sort(F.flatten(F.collect_list("part"))).alias("draws")
    taken = met.groupBy("source", "rank").agg(*[F.first(c).alias(c) for c in names if c != "source"], whole).select(*names, "draws")
    return taken.unionByName(at.where("blocks = 0").select(*names, F.array().cast(taken.schema["draws"].dataType).alias("draws")))


def plan(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Each document with its target and its draws: pass, shard, first block, blocks and words of each."""
    at = stage(placed(stage(sized(docs, mix), "mix-sizes"), mix), "mix-placed")
    return drawn(at, sharded(at, mix))


def shuffled(drawn_rows: DataFrame, shards: int, *key: str) -> DataFrame:
    """Rows dealt to their ``shard``'s partition and shuffled there by a seeded hash of ``key``."""
    dealt = drawn_rows.repartitionById(shards, F.col("shard").cast("int"))
    return dealt.sortWithinPartitions("shard", F.xxhash64(F.lit(Mix.seed + 1), *key), *key)


def shards(planned: DataFrame, mix: Mix) -> DataFrame:
    """One row per draw, dealt by shard and shuffled inside each: the order of the mix."""
    return shuffled(planned.select("doc_id", "source", F.inline("draws")), mix.shards, "doc_id", "pass", "block")


def _places(planned: DataFrame) -> tuple[DataFrame, bool]:
    """For each source and bucket, where its shards end (pass, shard, last perm), and whether repeated rows stand at a cut.

    ``due`` is set at the end of a pass: the words still due from all rows that stand there.
    """
    opened = planned.select("source", "bucket", "perm", "size", F.inline("draws")).where("block = 0")
    lasts = opened.groupBy("source", "bucket", "pass", "shard").agg(F.max("perm").alias("perm"))
    words = planned.select("source", "bucket", "perm", "size", F.inline("draws")).groupBy("source", "bucket", "perm", "pass").agg(F.sum("words").alias("due"), F.max("size").alias("size"))
    end = words.groupBy("source", "pass").agg(F.max(F.struct("bucket", "perm", "due", "size")).alias("e")).select("source", "pass", "e.*")
    cuts = stage(end, "mix-ends")
    found = lasts.alias("l").join(cuts.alias("c"), _same("l", "c") & (F.col("l.pass") == F.col("c.pass")) & (F.col("l.bucket") == F.col("c.bucket")) & (F.col("l.perm") == F.col("c.perm")), "left")
    found = found.select("l.*", F.col("c.due").alias("due"))
    listed = found.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(F.struct("pass", "perm", "shard", "due"))).alias("places"))
    repeats = planned.alias("p").join(cuts.alias("c"), _same("p", "c") & (F.col("p.bucket") == F.col("c.bucket")) & (F.col("p.perm") == F.col("c.perm"))).groupBy("c.source", "c.pass").count().where("count > 1")
    return listed, not repeats.isEmpty()


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents of the mix with the columns they came with, one row for each pass that takes one, in the order of the mix.

    A row stands in the shard that draws its document's first block, and shards
    are shuffled inside. The texts move once, to their shards: a document finds
    its shards by its place in the permutation. The last document of a source and
    pass is cut to the words still due, and its white space becomes single spaces.
    Of repeated rows at a cut the first ones stay whole. ``n_chars`` follows a cut text.
    """
    at = stage(placed(stage(sized(docs, mix), "mix-sizes"), mix), "mix-placed")
    mix = sharded(at, mix)
    listed, repeats = _places(stage(drawn(at, mix), "mix-drawn"))
    places = stage(listed, "mix-places")
    size = places.agg(F.coalesce(F.sum(F.size("places") * 32 + 48), F.lit(0)).alias("n")).first()["n"]
    places = F.broadcast(places) if size <= mix.broadcast_bytes else places
    body = docs.select(F.struct(*docs.columns).alias("_row"), "source", "text", _permutation(mix).alias("_perm"))
    met = body.alias("d").join(places.alias("p"), _same("d", "p") & (F.pmod("_perm", F.lit(mix.buckets)).cast("int") == F.col("p.bucket"))).select("d.*", "places")
    # in each pass the first shard whose last place is not before the document's
    hits = F.transform(F.sequence(F.lit(0), F.lit(mix.cap - 1)), lambda p: F.get(F.filter("places", lambda x: (x["pass"] == p) & (x["perm"] >= F.col("_perm"))), 0))
    hit = met.select("_row", "text", "source", "_perm", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("_at"))
    hit = hit.select("_row", "text", "_perm", "source", F.col("_at.pass").alias("pass"), F.col("_at.shard").alias("shard"), F.when(F.col("_at.perm") == F.col("_perm"), F.col("_at.due")).alias("_due"))
    if repeats:  # rows that share a place take what is due in turn
        turn = F.row_number().over(Window.partitionBy("source", "_perm", "pass").orderBy(F.monotonically_increasing_id())) - 1
        cut = hit.where("_due IS NOT NULL").withColumn("_due", F.greatest(F.col("_due") - turn * n_words(F.col("text")), F.lit(0)))
        hit = hit.where("_due IS NULL").unionByName(cut).where("coalesce(_due, 1) > 0")
    short = F.col("_due") < n_words(F.col("text"))  # null away from a cut
    text = F.when(short, F.array_join(F.slice(words(F.col("text")), 1, F.col("_due").cast("int")), " ")).otherwise(F.col("text"))
    out = shuffled(hit.select("_row", "shard", "pass", "_perm", text.alias("_text"), F.coalesce(short, F.lit(False)).alias("_short")), mix.shards, "_perm", "pass")
    fields = {"text": F.col("_text"), "n_chars": F.when(F.col("_short"), F.length("_text")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[fields[c].cast(docs.schema[c].dataType).alias(c) if c in fields else F.col("_row")[c].alias(c) for c in docs.columns])


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_distinct(F.transform("draws", lambda d: d["shard"])).alias("shards"))

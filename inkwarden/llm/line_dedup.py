"""Line dedup by a fixed-depth log-template tree, in native operations.

A line is parsed down a tree of fixed depth: its number of tokens, then its first
``lead`` tokens; the leaf holds the rest. Fields are generalised twice. Tokens that
hold a digit, an ``@`` or ``://`` are variable and become one wildcard at every
level. In a leaf where lines differ, a line of ``fields`` tokens or more is also known
by its templates: the tokens behind the lead are cut into ``bands`` bands, and each
template leaves out two of them, at most a fifth of the line. So two lines of a leaf
that differ in any two fields, or in more within two bands, share a template with
wildcards there. Templates are hashes met by equality; no pairs are formed.

A template recurs if its lines, the tokens of one line times the documents, weigh
``evidence`` tokens at least, in two documents or more: a line of eight tokens
recurs in two documents, one of three in six. The first document, by id and then
text hash, keeps the line, and it goes from the others. Where lines differ, a line
goes only if a line that is kept shares a template with it: lines are taken in the
order in which they first stand, and a line that shares a template with no kept one
is kept. So no chain of small differences takes a line of which no like is left.
These decisions are made in rounds: what leads all its templates is kept, what
shares one with it goes, and the rest waits for the next round.

Only hashes travel, 128 bits wide: a line is known by two independent hashes, and
its text stays in its document. Lines are counted once a document and added up by
task before the shuffle, so a passage in a third of all documents arrives as one
partial count a task; a leaf's lines meet as distinct lines.

Defined results: a null or empty text has one line without tokens and keeps it, as
every text keeps its lines without tokens; a line repeated inside one document is
not a repeat across documents; rows equal in id and text are one document and are
treated alike; an empty table gives an empty result; extra columns are carried
through, and names that clash with working columns are safe because the row
travels as a struct.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.llm.quality_rules import let
from inkwarden.llm.text import GAPS, read
from inkwarden.session import stage


@dataclass(frozen=True)
class Templates:
    lead: int = 3
    evidence: int = 16  # tokens of a line times documents
    min_docs: int = 2
    fields: int = 10  # tokens of a line from which on fields are generalised in its leaf
    bands: int = 10
    #: Bytes of documents' lost lines that may be broadcast to the texts; beyond, they are joined.
    broadcast_bytes: int = 32 << 20


WILDCARD = "<*>"
#: A token with a digit, an address sign or a scheme.
VARIABLE = r"[^\x20\x09-\x0D]*(?:[0-9@]|://)[^\x20\x09-\x0D]*"


def plain(line: Column) -> Column:
    """The tokens of a line, variable ones as wildcards, parted by single spaces."""
    # most lines have neither a variable token nor a gap of more than one space: one search tells
    masked = F.when(line.rlike(r"[0-9@:\x09-\x0D]"), F.regexp_replace(F.regexp_replace(line, VARIABLE, WILDCARD), GAPS, " "))
    return F.trim(masked.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, GAPS, " ")).otherwise(line))


def _key(*values: Column) -> Column:
    """Two independent 64-bit hashes."""
    return F.struct(F.xxhash64(F.lit(1), *values).alias("a"), F.xxhash64(F.lit(2), *values).alias("b"))


def parsed(docs: DataFrame, rule: Templates) -> DataFrame:
    """doc (id and text hash), line number, n (tokens), leaf and line (two hashes) of every line with tokens."""
    body = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64(body).alias("hash")).alias("doc"), F.posexplode(F.split(body, "\n", -1)).alias("line_no", "line"))
    flat = lines.select("doc", "line_no", plain(F.col("line")).alias("t")).where("t <> ''")
    n = F.octet_length("t") - F.octet_length(F.replace("t", F.lit(" "))) + 1
    return flat.select("doc", "line_no", n.alias("n"), F.xxhash64(n, F.substring_index("t", " ", rule.lead)).alias("leaf"), _key(F.col("t")).alias("line"))


def band_start(band: Column, n: Column, rule: Templates) -> Column:
    """The first place (from 0) of a band, in a line of ``n`` tokens; the band after the last starts at ``n``."""
    return (F.ceil(band * (n - rule.lead) / rule.bands) + rule.lead).cast("int")


def _spots(tokens: Column) -> Column:
    """Two hashes of each token with its place; what a line keeps is known by their exclusive or."""
    return F.transform(tokens, lambda t, i: F.struct(F.xxhash64(F.lit(1), t, i).alias("a"), F.xxhash64(F.lit(2), t, i).alias("b")))


def _summed(spots: Column) -> Column:
    start = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    return F.aggregate(spots, start, lambda acc, s: F.struct(acc["a"].bitwiseXOR(s["a"]).alias("a"), acc["b"].bitwiseXOR(s["b"]).alias("b")))


def _stretch(spots: Column, begin: Column, end: Column, n: Column, rule: Templates) -> Column:
    """The spots of the bands from ``begin`` up to ``end``."""
    first = band_start(begin, n, rule)
    return F.slice(spots, first + 1, band_start(end, n, rule) - first)


def templates(tokens: Column, n: Column, rule: Templates) -> Column:
    """Hashes of a line's templates: of every two bands left out whose tokens are a fifth of the line at most.

    Leaving out a band is one step on the hash of the whole line.
    """
    head = F.array_join(F.slice(tokens, 1, rule.lead), " ")

    def bands(spots: Column) -> Column:
        def one(k: Column) -> Column:
            mine = _stretch(spots, k, k + 1, n, rule)
            return let(mine, lambda m: let(_summed(m), lambda t: F.struct(F.size(m).alias("size"), t["a"].alias("a"), t["b"].alias("b"))))

        return F.transform(F.sequence(F.lit(0), F.lit(rule.bands - 1)), one)

    def pairs(found: Column) -> Column:
        every = lambda name: F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, s: acc.bitwiseXOR(s[name]))
        all_ = F.struct(every("a").alias("a"), every("b").alias("b"))

        def without(i: Column, j: Column, whole: Column) -> Column:
            x, y = F.get(found, i), F.get(found, j)
            left = lambda name: whole[name].bitwiseXOR(x[name]).bitwiseXOR(y[name])
            return F.when(5 * (x["size"] + y["size"]) <= n, F.struct(F.xxhash64(n, head, i, j, left("a")).alias("a"), F.xxhash64(head, j, i, n, left("b")).alias("b")))

        grid = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rule.bands - 2)), lambda i: F.transform(F.sequence(i + 1, F.lit(rule.bands - 1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
        return let(all_, lambda whole: F.filter(F.transform(grid, lambda g: without(g["i"], g["j"], whole)), lambda x: x.isNotNull()))

    return let(_spots(tokens), lambda s: let(bands(s), pairs))


def recurring(lines: DataFrame, docs: DataFrame, rule: Templates) -> DataFrame:
    """line and first: the lines that recur, and the document that keeps them."""
    distinct = stage(_once(lines), "distinct-lines")
    enough = (F.col("docs") >= rule.min_docs) & (F.col("docs") * F.col("n") >= rule.evidence)
    exact = distinct.where(enough).select("line", "first")
    # leaves in which lines differ; of each line there, the text that its first document holds
    able = distinct.where(F.col("n") >= rule.fields)
    leaves = able.groupBy("leaf").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.min("first").alias("first"), F.max("last").alias("last")).where("low < high AND first < last").select("leaf")
    some = stage(able.join(leaves, "leaf"), "varied-lines")
    where = some.groupBy(F.col("first").alias("doc")).agg(F.collect_list(F.struct(F.col("no").alias("line_no"), "line")).alias("wanted"))
    texts = _matched(docs, where, "wanted", rule, "inner").dropDuplicates(["doc"])
    held = texts.select("_lines", F.explode("wanted").alias("w")).select("w.line", F.split(plain(F.get("_lines", F.col("w.line_no"))), " ").alias("t"))
    known = held.join(some, "line").select("line", "n", "docs", F.struct("first", "no").alias("at"), "last", F.explode(templates(F.col("t"), F.col("n"), rule)).alias("template"))
    known = stage(known, "line-templates")
    # a template's documents are two at least if a line's are, or if the first and the last of all differ
    groups = known.groupBy("template").agg(F.min("at.first").alias("first"), F.max("last").alias("last"), F.count("*").alias("members"))
    groups = groups.where((F.col("members") > 1) & (F.col("first") != F.col("last")))
    alike = represented(known.join(groups.select("template"), "template", "left_semi").select("template", "line", "at"))
    return exact.unionByName(alike).groupBy("line").agg(F.min("first").alias("first"))


def represented(linked: DataFrame) -> DataFrame:
    """line and first of the lines that a kept line stands for: ``linked`` has the templates of each line and where it first stands.

    A round decides every line that leads all its templates, and every line that
    shares one with such a line. Most groups need one; a chain needs one for two of its lines.
    """
    waiting, gone = stage(linked, "linked-lines"), []
    while not waiting.isEmpty():
        leads = waiting.groupBy("template").agg(F.min(F.struct("at", "line")).alias("lead"))
        led = stage(waiting.join(leads, "template").select("template", "line", "lead"), "led-lines")
        kept = led.groupBy("line").agg(F.bool_and(F.col("lead.line") == F.col("line")).alias("kept")).where("kept").select("line")
        decided = led.join(kept.select(F.col("line").alias("leader")), F.col("lead.line") == F.col("leader")).groupBy("line").agg(F.min("lead.at.first").alias("first"), F.bool_or(F.col("lead.line") == F.col("line")).alias("kept"))
        decided = stage(decided, "decided-lines")
        gone.append(decided.where("NOT kept").select("line", "first"))
        waiting = stage(waiting.join(decided, "line", "left_anti"), "linked-lines")
    return reduce(DataFrame.unionByName, gone) if gone else linked.select("line", F.col("at.first").alias("first")).limit(0)


def _once(lines: DataFrame) -> DataFrame:
    """leaf, line, n, docs, first document and the line's number there, and last document of each distinct line."""
    once = lines.groupBy("leaf", "line", "n", "doc").agg(F.min("line_no").alias("no"))
    found = once.groupBy("leaf", "line", "n").agg(F.count("*").alias("docs"), F.min(F.struct("doc", "no")).alias("at"), F.max("doc").alias("last"))
    return found.select("leaf", "line", "n", "docs", F.col("at.doc").alias("first"), F.col("at.no").alias("no"), "last")


def _matched(docs: DataFrame, found: DataFrame, column: str, rule: Templates, how: str) -> DataFrame:
    """``docs`` (row, doc_id and the lines of text) with ``column`` of ``found`` by document. Few and small lists go to the texts; else both are shuffled."""
    found = stage(found, column)
    size = found.agg(F.coalesce(F.sum(F.size(column) * 24 + 64), F.lit(0)).alias("n")).first()["n"]
    small = F.broadcast(found) if size <= rule.broadcast_bytes else found
    body = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col("doc_id").alias("id"), F.xxhash64(body).alias("hash")).alias("_key"), F.split(body, "\n", -1).alias("_lines"))
    return keyed.alias("k").join(small.alias("g"), F.col("k._key.id").eqNullSafe(F.col("g.doc.id")) & (F.col("k._key.hash") == F.col("g.doc.hash")), how)


def dropped_lines(docs: DataFrame, rule: Templates = Templates()) -> DataFrame:
    """doc and the numbers of the lines that it loses, for documents that lose any."""
    lines = stage(parsed(docs, rule), "lines")
    hits = lines.join(recurring(lines, docs, rule), "line").where(~F.col("doc").eqNullSafe(F.col("first")))
    return hits.groupBy("doc").agg(F.collect_set("line_no").alias("gone"))


def deduplicated(docs: DataFrame, rule: Templates = Templates()) -> DataFrame:
    """``row`` (the document as it came), ``text`` (without recurring lines), ``n_lines`` and ``n_dropped``."""
    joined = _matched(docs, dropped_lines(docs, rule), "gone", rule, "left")
    kept = F.filter("_lines", lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select("row", text.alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))


def deduplicated_documents(docs: DataFrame, rule: Templates = Templates()) -> DataFrame:
    """The documents with the columns they came with; ``n_chars`` follows the text."""
    out = deduplicated(docs, rule)
    fields = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[fields[c].cast(docs.schema[c].dataType).alias(c) if c in fields else F.col("row")[c].alias(c) for c in docs.columns])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "text", "n_lines", "n_dropped")


def lines_sql(table: str, rule: Templates = Templates()) -> str:
    """WITH terms that end in ``deduped``: the rows of ``table`` with new text, n_lines and n_dropped."""
    return rf"""
ld AS (SELECT *, row_number() OVER () AS lid, coalesce(text, '') AS lbody FROM {table}),
lx AS (SELECT lid, doc_id, lbody, k, ls[k] AS l FROM (SELECT lid, doc_id, lbody, string_split(lbody, chr(10)) AS ls, unnest(generate_series(1, len(string_split(lbody, chr(10))))) AS k FROM ld)),
lt AS (SELECT *, struct_pack(a := doc_id IS NOT NULL, b := doc_id, c := lbody) AS doc, regexp_extract_all(regexp_replace(l, '[^\x20\x09-\x0D]*(?:[0-9@]|://)[^\x20\x09-\x0D]*', '{WILDCARD}', 'g'), '[^\x20\x09-\x0D]+') AS t FROM lx),
lo AS (SELECT t, count(DISTINCT doc) AS docs, min(doc) AS first, max(doc) AS last, min(struct_pack(doc := doc, k := k)) AS place FROM lt WHERE len(t) > 0 GROUP BY t),
lb AS (SELECT t, first, last, place, x.i, x.j, [CASE WHEN p <= {rule.lead} OR ((p - 1 - {rule.lead}) * {rule.bands} // (len(t) - {rule.lead})) NOT IN (x.i, x.j) THEN t[p] END FOR p IN generate_series(1, len(t))] AS template
       FROM lo, (SELECT i, j FROM range({rule.bands}) a(i), range({rule.bands}) b(j) WHERE i < j) x WHERE len(t) >= {rule.fields}),
lk AS (SELECT * FROM lb WHERE 5 * len([y FOR y IN template IF y IS NULL]) <= len(template)),
lg2 AS (SELECT template, i, j, min(first) AS first FROM lk GROUP BY ALL HAVING count(*) > 1 AND min(first) <> max(last)),
ln AS (SELECT lk.t, lk.first, lk.place, dense_rank() OVER (ORDER BY lk.template, lk.i, lk.j) AS g FROM lk JOIN lg2 ON lk.template = lg2.template AND lk.i = lg2.i AND lk.j = lg2.j),
lm AS (SELECT t, first, list(g) AS gs, row_number() OVER (ORDER BY place) AS k FROM ln GROUP BY t, first, place),
lw AS (WITH RECURSIVE w AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS held, false AS kept UNION ALL
       SELECT lm.k, CASE WHEN list_has_any(held, gs) THEN held ELSE list_concat(held, gs) END, NOT list_has_any(held, gs) FROM w JOIN lm ON lm.k = w.k + 1) SELECT k FROM w WHERE kept),
lv AS (SELECT k, first, unnest(gs) AS g FROM lm JOIN lw USING (k)),
lu AS (SELECT lm.t, lv.first FROM (SELECT t, k, unnest(gs) AS g FROM lm) lm JOIN lv ON lv.g = lm.g AND lv.k < lm.k),
lr AS (SELECT t, min(first) AS first FROM (SELECT t, first FROM lo WHERE docs >= {rule.min_docs} AND docs * len(t) >= {rule.evidence} UNION ALL SELECT t, first FROM lu) GROUP BY t),
lg AS (SELECT lid, count(lr.t) FILTER (lr.first.b IS DISTINCT FROM doc_id OR lr.first.c <> lbody) AS n_dropped, count(*) AS n_lines,
              string_agg(l, chr(10) ORDER BY k) FILTER (lr.t IS NULL OR (lr.first.b IS NOT DISTINCT FROM doc_id AND lr.first.c = lbody)) AS kept
       FROM lt LEFT JOIN lr USING (t) GROUP BY lid),
deduped AS (SELECT ld.* EXCLUDE (text), CASE WHEN n_dropped = 0 THEN text ELSE coalesce(kept, '') END AS text, n_lines, n_dropped FROM ld JOIN lg USING (lid))"""


SQL = f"WITH {lines_sql('documents')} SELECT doc_id, text, n_lines, n_dropped FROM deduped"

"""Readers: JSON, archive assignments, CSV/TSV, Markdown forms and ZIP files, to one row per record.

Every reader gives ``file``, ``file_no``, ``row_no`` and ``record``, a VARIANT; ``ord``
follows from the two numbers. Input over a limit, or broken, fails as a whole.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwarden.session import stage


@dataclass(frozen=True)
class Limits:
    """Validation options, not capacities: None turns one off."""

    file_bytes: int | None = 30 << 20
    zip_bytes: int | None = 100 << 20
    zip_entries: int | None = 5000
    posts: int | None = None
    text_chars: int | None = None
    total_chars: int | None = None  # of all texts together


# ---------------------------------------------------------------- paths

#: Names of public post files, and of what is never read.
ARCHIVE_FILE = r"(?i)(?:tweets?|posts?)(?:[-_]part\d+)?\.(?:js|json)"
PUBLIC_FILE = r"(?i)(?:tweets?(?:[-_]part\d+)?\.(?:js|json|csv)|posts\.json|records\.json|project\.json|posts\.csv|提交表\.md)"
PRIVATE_PART = r"(?i)direct[-_ ]?messages?|(?:^|[-_])dm(?:[-_]|$)|contacts?|address[-_ ]?book|account|私信|通讯录"


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def safe_path(path: Column) -> Column:
    """Relative, without parent steps and without a drive."""
    p = slashed(path)
    return ~p.startswith("/") & ~F.array_contains(F.split(p, "/"), "..") & ~p.rlike("^[A-Za-z]:")


def private_path(path: Column) -> Column:
    return F.exists(F.split(slashed(path), "/"), lambda part: part.rlike(PRIVATE_PART))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def public_path(path: Column) -> Column:
    return ~private_path(path) & base_name(path).rlike(f"^(?:{PUBLIC_FILE.removeprefix('(?i)')})$|^(?i:{PUBLIC_FILE.removeprefix('(?i)')})$")


def archive_path(path: Column) -> Column:
    """A post file of an archive: at its top or under a folder ``data``."""
    parts = F.split(slashed(path), "/")
    inside = (F.size(parts) == 1) | F.array_contains(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "data")
    return safe_path(path) & inside & base_name(path).rlike(f"^(?i:{ARCHIVE_FILE.removeprefix('(?i)')})$")


def part_number(path: Column) -> Column:
    """The part of an archive file; files without one are part 0."""
    return F.coalesce(F.regexp_extract(path, r"(?i)[-_]part(\d+)\.(?:js|json)$", 1).try_cast("int"), F.lit(0))


def part_gaps(files: DataFrame, *by: str) -> DataFrame:
    """``by`` and whether the parts of its files are other than 0 to their largest."""
    n = files.select(*by, part_number(F.col("file")).alias("n")).groupBy(*by).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.countDistinct("n").alias("parts"))
    return n.select(*by, F.coalesce((F.col("low") != 0) | (F.col("parts") != F.col("high") + 1), F.lit(False)).alias("gap"))


def part_gap(files: DataFrame) -> DataFrame:
    """One row: ``part_gaps`` of all files together."""
    return part_gaps(files)


# ---------------------------------------------------------------- texts


def decoded(content: Column) -> Column:
    """UTF-16 with a byte-order mark, else UTF-8 with or without one; other bytes fail."""
    mark = F.hex(F.substring(content, 1, 2))
    text = F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).otherwise(F.decode(content, "UTF-8"))
    return F.regexp_replace(text, "^﻿", "")


def read_texts(spark: SparkSession, paths: list[str], limits: Limits = Limits()) -> DataFrame:
    """file and text of whole files."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "length", "content")
    if limits.file_bytes is not None:
        files = files.where(F.assert_true(F.col("length") <= limits.file_bytes, F.concat("file", F.lit(" is over the file limit"))).isNull())
    return files.select("file", decoded(F.col("content")).alias("text"))


ASSIGNMENT = r"^\s*window\.YTD\.(?:tweets?|posts?)(?:_part\d+)?\.part\d+\s*=\s*"


#: Fixed value: what the pattern of an assignment takes for space.
SPACE = " \t\n\x0b\f\r"


def assigned(text: Column) -> Column:
    """The JSON of an archive's assignment; nothing is executed, and other text fails."""
    behind = F.rtrim(text.substr(F.length(F.regexp_extract(text, ASSIGNMENT, 0)) + 1, F.length(text)), F.lit(SPACE))
    inner = F.when(behind.endswith(";"), F.rtrim(behind.substr(F.lit(1), F.length(behind) - 1), F.lit(SPACE))).otherwise(behind)
    return F.when(text.isNull() | text.rlike(ASSIGNMENT), inner).otherwise(F.raise_error(F.lit("not an archive assignment")).cast("string"))


def json_records(texts: DataFrame) -> DataFrame:
    """Records of JSON texts: a list, an object with posts, records or tweets, or one record."""
    value = texts.withColumn("v", F.parse_json("text"))
    listed = lambda *path: F.try_variant_get("v", "$" + "".join(path), "array<variant>")
    single = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "variant") for k in ("text", "full_text", "tweet")]).isNotNull()
    rows = F.coalesce(listed(), listed(".posts"), listed(".records"), listed(".tweets"), F.when(single, F.array("v")))
    checked = value.withColumn("rows", F.when(rows.isNull() & F.col("text").isNotNull(), F.raise_error(F.concat(F.lit("no records in "), "file")).cast("array<variant>")).otherwise(rows))
    return checked.select("file", F.posexplode("rows").alias("row_no", "item")).select("file", "row_no", unwrapped("item").alias("record"))


def unwrapped(item: str) -> Column:
    """The record inside a wrapper object, or the item itself."""
    return F.coalesce(F.try_variant_get(item, "$.tweet", "variant"), F.try_variant_get(item, "$.post", "variant"), F.col(item))


def csv_records(texts: DataFrame, known: frozenset[str]) -> DataFrame:
    """Records of CSV texts with a header; the delimiter is sniffed from the head, and ragged rows fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column("file"), batch.column("text"), strict=True):
                rows = list(parse_csv(text.as_py(), known))
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([json.dumps(r, ensure_ascii=False) for r in rows], pa.string())], names=["file", "row_no", "json"])

    return texts.select("file", "text").mapInArrow(run, "file string, row_no int, json string").select("file", "row_no", F.parse_json("json").alias("record"))


#: What may part the fields of a table, of equals the first.
DELIMITERS = (",", "\t", ";")


def delimiter(text: str, known: frozenset[str]) -> str:
    """What parts the header into the most known names, of equals into the most fields. Texts below the header have no say."""

    def header(sign: str) -> list[str]:
        try:
            return [n.strip() for n in next(csv.reader(io.StringIO(text, newline=""), delimiter=sign), [])]
        except csv.Error:
            return []

    found = {sign: header(sign) for sign in DELIMITERS}
    return max(DELIMITERS, key=lambda sign: (len(known & set(found[sign])), len(found[sign])))


def parse_csv(text: str, known: frozenset[str]) -> Iterator[dict[str, str]]:
    """The rows of a table with a header, quoted by double quotes, which are doubled inside."""
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter(text, known), strict=True)
    names = [n.strip() for n in next(reader, [])]
    if not known & set(names):
        raise ValueError("the header has no field of a post")
    for row in reader:
        if len(row) > len(names):
            raise ValueError(f"line {reader.line_num} has more columns than the header")
        if row:
            yield dict(zip(names, row, strict=False))


# ---------------------------------------------------------------- Markdown forms

#: Labels of the submission form.
FORM = {
    "id": "帖子标识（如能取得）", "url": "帖子链接", "date": ("发布时间（含时区；不知道则填未知）", "发布时间"), "type": "类型",
    "complete": "正文或长文是否完整", "thread": "所属线程及顺序", "missing": "无法提供的媒体及原因",
    "text": "帖子原文", "notes": "本人补充说明（可选）", "target": "对应帖子链接或编号",
    "source_text": ("来源原文（用于文字对比，可选）", "来源原文"), "source_url": ("来源链接或出处", "本人在其他平台发布的链接（适用时填写）"),
    "owner": "素材归属", "contribution": "本人新增的分析、观点、报道或创作", "method": "创作方式", "evidence": "证据文件名", "placeholder": "在这里",
}
MEDIA_LABELS = (("图片文件", "image"), ("视频或 GIF 文件", "video"))
UNKNOWN = ("未知", "不确定", "不适用", "无", "none", "null", "unknown", "n/a")


def _told(value: str | None) -> str:
    value = (value or "").strip()
    return "" if value.casefold() in UNKNOWN else value


#: The shapes of a form's lines, and what ends its posts and its sources.
FIELD_LINE = r"[ \t]*-[ \t]*([^：:]+)[：:][ \t]*(.*)"
BODY_LINE = r"\*\*(.+?)[：:]?\*\*(.*)"
HEADING_LINE = r"(#{1,6})\s+(.*?)\s*"
POST_HEADING, SOURCE_HEADING = r"P\d+", r"来源记录\s+S\d+"
POSTS_END, SOURCES_END = "## 四、", "## 五、"
THREAD_PLACE = r"第\s*(\d+)\s*条[，,]\s*共\s*(\d+)\s*条"
MEDIA_SEPARATORS = r"[;；、\n]"


class _Section:
    """A part of a form: the values of its labels, and the texts under its bold labels."""

    def __init__(self, lines: list[str]):
        self.fields: dict[str, str] = {}
        self.texts: dict[str, list[str]] = {}
        under: list[str] = []  # the text that lines go to
        for line in lines:
            if re.match(HEADING_LINE, line):
                under = []
            elif bold := re.match(BODY_LINE, line):
                under = self.texts.setdefault(bold[1].strip(), [])
                under.append(bold[2])
            else:
                under.append(line)
            if value := re.fullmatch(FIELD_LINE, line):
                self.fields[value[1].strip()] = value[2].strip()

    def field(self, labels: str | tuple[str, ...]) -> str:
        return next((v for k in ([labels] if isinstance(labels, str) else labels) if (v := _told(self.fields.get(k)))), "")

    def body(self, label: str) -> str:
        found = "\n".join(self.texts.get(label, ())).strip()
        return "" if found.startswith(FORM["placeholder"]) else found


def _sections(text: str, title: str, end: str) -> Iterator[tuple[str, _Section]]:
    """The parts under headings of the second level or lower that read ``title``, each up to the next or to ``end``."""
    name, lines = "", []
    for line in [*text.split("\n"), None]:
        heading = line is not None and re.fullmatch(HEADING_LINE, line)
        opens = heading and len(heading[1]) > 1 and re.fullmatch(title, heading[2])
        if name and (line is None or opens or line.startswith(end)):
            yield name, _Section(lines)
            name = ""
        if opens:
            name, lines = heading[2], []
        elif name:
            lines.append(line)


def _thread(told: str) -> dict[str, str]:
    """What a form says of a thread: its name, and the post's place in it after a comma."""
    place = re.search(THREAD_PLACE, told)
    name = re.sub(r"[，,]\s*$", "", told[: place.start()]) if place else ""
    if place and name and name != told[: place.start()]:
        return {"thread_id": name.strip(), "thread_order": place[1], "thread_total": place[2]}
    return {"thread_id": told} if told else {}


def parse_form(text: str) -> tuple[list[dict], list[dict]]:
    """Posts and source records of a form, not yet joined."""
    posts, sources = [], []
    for number, s in _sections(text, POST_HEADING, POSTS_END):
        post = {"id": s.field(FORM["id"]) or number, "material_id": number, "url": s.field(FORM["url"]), "text": s.body(FORM["text"]), "created_at": s.field(FORM["date"]), "type": s.field(FORM["type"]), "text_complete": s.field(FORM["complete"]), "notes": s.body(FORM["notes"])}
        post |= _thread(s.field(FORM["thread"]))
        post["media"] = [{"name": n.strip(), "kind": kind} for label, kind in MEDIA_LABELS for n in re.split(MEDIA_SEPARATORS, s.field(label)) if n.strip()]
        if missing := s.field(FORM["missing"]):
            post["missing_media"] = [missing]
        if post["url"] or post["text"] or post["created_at"] or post["media"]:
            posts.append(post)
    for _, s in _sections(text, SOURCE_HEADING, SOURCES_END):
        if target := s.field(FORM["target"]):
            text_ = s.body(FORM["source_text"][0]) or s.field(FORM["source_text"][1])
            sources.append({"target": target, "url": s.field(FORM["source_url"]), "text": text_, "owner": s.field(FORM["owner"]), "contribution": s.field(FORM["contribution"]), "method": s.field(FORM["method"]), "evidence": s.field(FORM["evidence"])})
    return posts, sources


#: Where a form lists its candidates, and what a candidate's link looks like.
CANDIDATES_HEADING, CANDIDATES_END = "## 二、申请候选", "## 三、"
CANDIDATE_LINK = r"https?://(?:www\.)?(?:x|twitter)\.com/[^\s\u3000]+/status/\d+"


def form_candidates(texts: DataFrame) -> DataFrame:
    """file, place and url of the posts that a form puts forward, in its order."""
    part = F.when(F.contains("text", F.lit(CANDIDATES_HEADING)), F.split_part(F.split_part("text", F.lit(CANDIDATES_HEADING), F.lit(2)), F.lit(CANDIDATES_END), F.lit(1))).otherwise("")
    return texts.select("file", F.posexplode(F.regexp_extract_all(part, F.lit(CANDIDATE_LINK), F.lit(0))).alias("place", "url"))


def form_faults(texts: DataFrame) -> DataFrame:
    """file, fault and target: ``blank_form`` where no post is filled in, ``source_unmatched`` for a source record that names no post of its form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                posts, sources = parse_form(text or "")
                named = {p[k] for p in posts for k in ("id", "material_id", "url")}
                rows += [(file, "blank_form", None)] if not posts else [(file, "source_unmatched", s["target"]) for s in sources if s["target"] not in named]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["file", "fault", "target"])

    return texts.select("file", "text").mapInArrow(run, "file string, fault string, target string")


#: Labels of the form's first part, each with the names that it may have.
SCOPE_FORM = {
    "account": ("账号链接或 @用户名", "账号"), "timezone": ("时区（账号评估必填；仅样本初评可填“不适用”）", "时区"), "complete": ("是否包含该期间全部本人发帖",),
    "total_expected": ("已知该期间帖子总数",), "selection": ("选择方式",),
}
MISSING_LABELS, RANGE_LABEL, POSTS_HEADING = ("已知缺失", "缺失详情"), "时间范围", "## 二、"


def parse_scope(text: str) -> dict[str, str]:
    """What a form says of the account and the range: account, timezone, complete, total_expected, selection, known_missing, start and end."""
    head = _Section(text.partition(POSTS_HEADING)[0].split("\n"))
    scope = {name: next((head.fields[k] for k in labels if k in head.fields), "") for name, labels in SCOPE_FORM.items()}
    scope["known_missing"] = "；".join(filter(None, (_told(head.fields.get(k)) for k in MISSING_LABELS)))
    days = next((re.findall(r"\d{4}-\d{2}-\d{2}", v) for k, v in head.fields.items() if k.startswith(RANGE_LABEL)), [])
    return scope | dict(zip(("start", "end"), days[:2] if len(days) > 1 else ("", ""), strict=True))


SCOPE = "account string, timezone string, complete string, total_expected string, selection string, known_missing string, start string, end string"


def form_scopes(texts: DataFrame) -> DataFrame:
    """file and the fields of ``SCOPE`` of Markdown forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCOPE.split(", ")]
        for batch in batches:
            found = [parse_scope(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("file"), *(pa.array([r[n] for r in found], pa.string()) for n in names)], names=["file", *names])

    return texts.select("file", "text").mapInArrow(run, f"file string, {SCOPE}")


def form_records(texts: DataFrame) -> DataFrame:
    """Records of Markdown forms, each with the source records that name its id, number or link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column("file"), batch.column("text"), strict=True):
                found = parse_form(text.as_py())
                rows = [(kind, i, json.dumps(r, ensure_ascii=False)) for kind, part in enumerate(found) for i, r in enumerate(part)]
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.string())))], names=["file", "kind", "row_no", "json"])

    rows = texts.select("file", "text").mapInArrow(run, "file string, kind int, row_no int, json string")
    posts, sources = rows.where("kind = 0").select("file", "row_no", "json"), rows.where("kind = 1").select("file", F.col("row_no").alias("source_no"), F.col("json").alias("source"))
    keys = F.array_distinct(F.filter(F.array(*[F.get_json_object("json", f"$.{k}") for k in ("id", "material_id", "url")]), lambda k: F.coalesce(k, F.lit("")) != ""))
    keyed = posts.select("file", "row_no", F.explode(keys).alias("target"))
    met = keyed.join(sources.withColumn("target", F.get_json_object("source", "$.target")), ["file", "target"]).groupBy("file", "row_no").agg(F.array_sort(F.collect_set(F.struct("source_no", "source"))).alias("s"))
    part = lambda name: F.filter(F.transform("s", lambda x: F.get_json_object(x["source"], f"$.{name}")), lambda v: v != "")
    added = F.to_json(F.struct(F.transform("s", lambda x: F.from_json(x["source"], "text string, url string, owner string")).alias("sources"), F.array_join(part("contribution"), "；").alias("contribution"), F.try_element_at(part("method"), F.lit(-1)).alias("creation_method"), part("evidence").alias("evidence")))
    merged = F.when(F.col("s").isNull(), F.col("json")).otherwise(F.concat(F.expr("left(json, length(json) - 1)"), F.lit(","), F.expr("substring(_added, 2)")))
    return posts.join(met, ["file", "row_no"], "left").withColumn("_added", added).select("file", "row_no", F.parse_json(merged).alias("record"))


# ---------------------------------------------------------------- ZIP


def zip_members(spark: SparkSession, paths: list[str], limits: Limits = Limits()) -> DataFrame:
    """file, member, size, kind (post or media) and content (text of posts) or sha256 (of media), read without unpacking to disk.

    Private members are never opened. Parent paths, encryption, broken checksums, headers
    that differ from the directory and sizes over the limits fail. See ``zips``.
    """
    from inkwarden.sources.zips import ZipMembers

    spark.dataSource.register(ZipMembers)
    most = {k: str(v) for k, v in (("zip_entries", limits.zip_entries), ("zip_bytes", limits.zip_bytes)) if v is not None}
    return spark.read.format("zip_members").options(paths=json.dumps(paths), **most).load()


def link_media(posts: DataFrame, members: DataFrame) -> DataFrame:
    """``posts`` with hashes of the media that exactly one archive member matches by path or name."""
    media = posts.select("id", F.posexplode("media").alias("place", "m"))
    hashed = members.where("sha256 IS NOT NULL").select(F.col("sha256"), F.explode(F.array_distinct(F.array(slashed(F.col("member")), base_name(F.col("member"))))).alias("name"))
    unique = hashed.groupBy("name").agg(F.count("*").alias("n"), F.first("sha256").alias("sha256")).where("n = 1").select("name", "sha256")
    wanted = media.withColumn("name", base_name(F.col("m.name")))
    fixed = F.col("m").withField("hash", F.coalesce("sha256", "m.hash")).withField("hash_origin", F.when(F.col("sha256").isNotNull(), "local_file").otherwise(F.col("m.hash_origin")))
    linked = wanted.join(unique, "name", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", fixed.alias("m")))).alias("l"))
    return posts.join(linked, "id", "left").withColumn("media", F.coalesce(F.transform("l", lambda x: x["m"]), "media")).drop("l")


def ordered(records: DataFrame) -> DataFrame:
    """``records`` with ``ord``, their place by part number, file and row; places are numbered file by file.

    Records are read once and written: they are counted before they are numbered.
    """
    records = stage(records, "records")
    sizes = records.groupBy("file").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(part_number(F.col("file")), "file")) - F.col("n")  # one row per file
    return records.join(sizes.withColumn("before", before).select("file", "before"), "file").withColumn("ord", F.col("before") + F.col("row_no") + 1).drop("before")


def read_records(spark: SparkSession, path: str, limits: Limits = Limits(), known: frozenset[str] | None = None) -> DataFrame:
    """Records of one file by its suffix: .js, .json, .csv, .tsv, .md or .zip."""
    from inkwarden.sources.normalize import KNOWN

    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".zip":
        posts = zip_members(spark, [path], limits).where("kind = 'post'").select(F.col("member").alias("file"), decoded(F.col("content")).alias("text"))


        def by(end: str) -> DataFrame:
            # the text goes with the filter: whatever is evaluated first, other files have none
            own = F.lower("file").endswith(f".{end}")
            return posts.where(own).withColumn("text", F.when(own, F.col("text")))

        found = records_of(by("json"), "json").unionByName(records_of(by("js"), "js")).unionByName(records_of(by("csv"), "csv")).unionByName(records_of(by("md"), "md"))
        return ordered(found)
    if suffix.lstrip(".") not in ("js", "json", "csv", "tsv", "md"):
        raise ValueError(f"no reader for {suffix or 'files without a suffix'}")
    return ordered(records_of(read_texts(spark, [path], limits), suffix.lstrip("."), known or KNOWN))


def records_of(texts: DataFrame, kind: str, known: frozenset[str] | None = None) -> DataFrame:
    from inkwarden.sources.normalize import KNOWN

    if kind in ("csv", "tsv"):
        return csv_records(texts, known or KNOWN)
    if kind == "md":
        return form_records(texts)
    return json_records(texts.withColumn("text", assigned(F.col("text"))) if kind == "js" else texts)

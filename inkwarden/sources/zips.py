"""ZIP archives as a Spark data source: a partition for each member of a large archive, or for many small archives, read by ranges.

    spark.dataSource.register(ZipMembers)
    spark.read.format("zip_members").option("paths", json.dumps([...])).load()

Planning reads the directories of large archives, which are small beside them, and the
sizes alone of others, whose directories tasks read and check; a task opens its archive, checks the member's own header against the directory and streams the member.
No archive is held in memory, so its size has no bound; texts of posts are, one a task.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, member string, size long, kind string, content binary, sha256 string"
MEDIA_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".mp4", ".mov", ".webm", ".m4v")
#: Fixed values of the format: a local header's mark and fields, and the flags that say encrypted and sizes behind the data.
LOCAL_MARK, LOCAL_FIELDS, ENCRYPTED, SIZES_BEHIND = b"PK\x03\x04", "<4s5H3L2H", 1, 8
WIDE = 0xFFFFFFFF
#: Fixed values of the format: marks of the archive's end, of the 64-bit directory's and its locator, and how far back the end may begin.
END_MARK, WIDE_END_MARK, LOCATOR_MARK, LOCATOR_SIZE, END_ROOM = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", 20, 22 + 20 + 65_535


def opened(path: str):
    """A file that can be read from any place, wherever the path's scheme says."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        where, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    else:
        where, name = fs.LocalFileSystem(), path
    return where.open_input_file(name)


def located(file) -> None:
    """An error where an archive names a 64-bit directory that is not where it says."""
    size = file.size()
    file.seek(max(0, size - END_ROOM))
    tail = file.read()
    end = tail.rfind(END_MARK)
    if end >= LOCATOR_SIZE and tail[end - LOCATOR_SIZE :].startswith(LOCATOR_MARK):
        _, disk, place, disks = struct.unpack("<4sLQL", tail[end - LOCATOR_SIZE : end])
        file.seek(min(place, size))
        if disk or disks > 1 or file.read(len(WIDE_END_MARK)) != WIDE_END_MARK:
            raise ValueError("the 64-bit directory is not where its locator says")


def directory(path: str, entries: int | None) -> list[zipfile.ZipInfo]:
    """The members of an archive, or an error for one that is not safe to read."""
    with opened(path) as file:
        located(file)
        members = [m for m in zipfile.ZipFile(file).infolist() if not m.is_dir()]
    if entries is not None and len(members) > entries:
        raise ValueError("more ZIP entries than allowed")
    names = [m.filename.replace("\\", "/") for m in members]
    if len(set(names)) != len(names):
        raise ValueError("two ZIP members have one name")
    if any(m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) for m in members):
        raise ValueError("a ZIP member is neither stored nor deflated")
    spans = sorted((m.header_offset, m.header_offset + m.compress_size) for m in members)
    if any(end > begin for (_, end), (begin, _) in zip(spans, spans[1:], strict=False)):
        raise ValueError("ZIP members overlap")
    for m in members:
        if m.filename.startswith(("/", "\\")) or ".." in PurePosixPath(m.filename.replace("\\", "/")).parts or re.match("[A-Za-z]:", m.filename):
            raise ValueError(f"unsafe member path {m.filename}")
    return members


def reconciled(file, m: zipfile.ZipInfo) -> None:
    """An error where a member's own header says other than the directory."""
    file.seek(m.header_offset)
    raw = file.read(struct.calcsize(LOCAL_FIELDS))
    if len(raw) < struct.calcsize(LOCAL_FIELDS) or not raw.startswith(LOCAL_MARK):
        raise ValueError(f"{m.filename} has no header where the directory says")
    _, _, flags, method, _, _, crc, packed, size, name_size, extra_size = struct.unpack(LOCAL_FIELDS, raw)
    name, extra = file.read(name_size), file.read(extra_size)
    told = name.decode("utf-8" if flags & 0x800 else "cp437")
    if told != m.orig_filename or method != m.compress_type or (flags ^ m.flag_bits) & (ENCRYPTED | SIZES_BEHIND):
        raise ValueError(f"{m.filename} differs from its own header")
    if flags & SIZES_BEHIND:
        return
    wide: list[int] = []
    while len(extra) >= 4:
        kind, n = struct.unpack("<2H", extra[:4])
        if kind == 1:  # sizes of 64 bits
            wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
        extra = extra[4 + n :]
    size = wide.pop(0) if size == WIDE and wide else size
    packed = wide.pop(0) if packed == WIDE and wide else packed
    if (crc, packed, size) != (m.CRC, m.compress_size, m.file_size):
        raise ValueError(f"{m.filename} differs from its own header")


#: Bytes of an archive from which on each member is a partition, and of the smaller ones that make one together, and their number.
LARGE, PACKED, MANY = 32 << 20, 16 << 20, 64


def sized(path: str) -> int:
    with opened(path) as file:
        return file.size()


class Archives(InputPartition):
    """Small archives that one task reads, one after another."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class Member(InputPartition):
    def __init__(self, path: str, name: str, post: bool):
        self.path, self.name, self.post = path, name, post


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        from inkwarden.sources import readers  # names of public and of private files

        self.paths = json.loads(options["paths"])
        self.entries, self.bytes = (int(options[k]) if options.get(k) else None for k in ("zip_entries", "zip_bytes"))
        self.public, self.private = readers.PUBLIC_FILE, readers.PRIVATE_PART

    def __getstate__(self) -> dict:
        return self.__dict__ | {"paths": []}  # tasks have their own; all of them to each would grow with the square

    def members(self, path: str) -> list[Member]:
        """The post files and media of an archive, or an error for one that is over a limit or not safe to read."""
        members = directory(path, self.entries)
        named = [m for m in members if not any(re.search(self.private, p) for p in PurePosixPath(m.filename.replace("\\", "/")).parts)]
        posts = [m for m in named if re.fullmatch(self.public, PurePosixPath(m.filename.replace("\\", "/")).name)]
        media = [m for m in named if m.filename.lower().endswith(MEDIA_SUFFIXES)]
        if not posts:
            raise ValueError("no public post file in the ZIP")
        if self.bytes is not None and sum(m.file_size for m in posts) > self.bytes:
            raise ValueError("post files unpack beyond the limit")
        for m in (*posts, *media):
            if m.flag_bits & ENCRYPTED:
                raise ValueError(f"{m.filename} is encrypted")
        return [Member(path, m.filename, m in posts) for m in (*posts, *media)]

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        held, size = [], 0
        for path in self.paths:
            bytes_ = sized(path)
            if bytes_ >= LARGE:
                out += self.members(path)
                continue
            if held and (size + bytes_ > PACKED or len(held) == MANY):
                out.append(Archives(held))
                held, size = [], 0
            held.append(path)
            size += bytes_
        return [*out, *([Archives(held)] if held else [])]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        if isinstance(part, Archives):
            for path in part.paths:
                yield from self.rows(path, self.members(path))
        else:
            yield from self.rows(part.path, [part])

    def rows(self, path: str, members: list[Member]) -> Iterator[tuple]:
        with opened(path) as file, zipfile.ZipFile(file) as archive:
            for member in members:
                m = archive.getinfo(member.name)
                reconciled(file, m)
                with archive.open(m) as stream:
                    if member.post:
                        yield path, m.filename, m.file_size, "post", stream.read(), None
                        continue
                    digest = hashlib.sha256()
                    while block := stream.read(1 << 20):
                        digest.update(block)
                    yield path, m.filename, m.file_size, "media", None, digest.hexdigest()


class ZipMembers(DataSource):
    """Posts with their content and media with their digest; private members are never opened."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options)

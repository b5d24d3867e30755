"""EPUB files as a Spark data source, to read and to write: ``spark.read.format("epub")``.

Option ``parts`` says what is read, a row each:

- ``spine`` (default): path, page_id (from 1), href, html, title, author, error of linear spine items
- ``images``: path, href, media_type, data of image files
- ``links``: path, entry, position, stored, role, kind, value, target, fragment of everything that a
  structural check looks at (see ``operators.book_check``)

A broken file gives one row with error E103 (spine) or kind "broken" (links). Written rows are
chapters, images and style sheets of books, see WRITE_SCHEMA. Files are reached by pyarrow's file
systems; where only Spark can reach them, ``sources.epub.read_epub`` reads them as binary files.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

from .epub import Book, resolve

#: Bytes of files that one task reads; larger files are cut by spine ranges, small ones share a task.
SPLIT_BYTES = 32 << 20
SCHEMAS = {
    "spine": "path string, page_id bigint, href string, html string, title string, author string, error string",
    "images": "path string, href string, media_type string, data binary",
    "links": "path string, entry string, position int, stored boolean, role string, kind string, value string, target string, fragment string",
}
#: part is chapter, image or style; rows of a book stand together in a partition.
WRITE_SCHEMA = "file string, title string, author string, part string, seq int, name string, heading string, xhtml string, data binary"
BROKEN = (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration, UnicodeDecodeError, EOFError)


def _fs(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _local(el: ET.Element) -> str:
    return el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""


@dataclass
class Piece(InputPartition):
    """Files of a task, each with which of how many spine ranges it reads."""

    files: list[tuple[str, int, int]]


class Container:
    """What a package file says of a book."""

    def __init__(self, blob: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(blob))
        box = ET.fromstring(self.zip.read("META-INF/container.xml"))
        self.opf = next(e.get("full-path") for e in box.iter() if _local(e) == "rootfile")
        self.package = list(ET.fromstring(self.zip.read(self.opf)).iter())
        self.items = [e for e in self.package if _local(e) == "item"]
        self.names = set(self.zip.namelist())

    def said(self, tag: str) -> str | None:
        return next((e.text for e in self.package if _local(e) == tag and e.text), None)

    def spine(self) -> list[str]:
        hrefs = {e.get("id"): e.get("href") for e in self.items}
        wanted = [hrefs.get(e.get("idref")) for e in self.package if _local(e) == "itemref" and e.get("linear") != "no"]
        return [p for h in wanted if h and (p := resolve(self.opf, h)) in self.names]

    def images(self) -> Iterator[tuple[str, str, bytes]]:
        for e in self.items:
            kind, p = e.get("media-type") or "", resolve(self.opf, e.get("href") or "")
            if kind.startswith("image/") and p in self.names:
                yield p, kind, self.zip.read(p)

    def links(self) -> Iterator[tuple]:
        """entry, position, stored, role, kind, value, target, fragment (of items: the media type, none for the contents page)."""
        pages = {resolve(self.opf, e.get("href") or ""): e for e in self.items}
        targets = {e.get("id"): p for p, e in pages.items()}
        for i, info in enumerate(self.zip.infolist()):
            name, item = info.filename, pages.get(info.filename)
            kind = "" if item is None else item.get("media-type") or ""
            role = "package" if name == self.opf else "nav" if item is not None and "nav" in (item.get("properties") or "").split() else "chapter" if kind == "application/xhtml+xml" else "toc" if "ncx" in kind else "other"
            at = (name, i, info.compress_type == zipfile.ZIP_STORED, role)
            yield (*at, "entry", None, None, None)
            if role == "other":
                continue
            try:
                found = self.package if role == "package" else ET.fromstring(self.zip.read(name)).iter()
                for e in found:
                    yield from self._refs(at, name, e, targets)
            except ET.ParseError as error:
                yield (*at, "unreadable", str(error), None, None)

    @staticmethod
    def _refs(at: tuple, name: str, e: ET.Element, targets: dict) -> Iterator[tuple]:
        tag = _local(e)
        if e.get("id") is not None:
            yield (*at, "id", e.get("id"), None, None)
        if tag == "item":
            yield (*at, "item", e.get("id"), resolve(name, e.get("href") or ""), None if "nav" in (e.get("properties") or "").split() else e.get("media-type"))
        elif tag == "itemref":
            yield (*at, "itemref", e.get("idref"), targets.get(e.get("idref")), None)
        else:
            for k in ("href", "src"):
                v = e.get(k)
                target = None if v is None else name if v.startswith("#") else resolve(name, v)
                if target is not None:
                    yield (*at, "link", v, target, v.partition("#")[2] or None)


class EpubReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"].rstrip("/"), options.get("parts", "spine")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.kept: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Conditions on path choose files before any is opened; all others are left to Spark."""
        for f in filters:
            on_path = getattr(f, "attribute", None) == ("path",)
            if on_path and isinstance(f, EqualTo):
                self.kept.append(("in", {f.value}))
            elif on_path and isinstance(f, In):
                self.kept.append(("in", set(f.value)))
            elif on_path and isinstance(f, StringStartsWith):
                self.kept.append(("starts", f.value))
            elif on_path and isinstance(f, StringEndsWith):
                self.kept.append(("ends", f.value))
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        test = {"in": lambda v: path in v, "starts": path.startswith, "ends": path.endswith}
        return all(test[how](v) for how, v in self.kept)

    def files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, root = _fs(self.path)
        head = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        if system.get_file_info(root).type == fs.FileType.File:
            found = [system.get_file_info(root)]
        else:
            found = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(".epub") and "/_temporary/" not in i.path]
        return sorted((head + i.path, i.size) for i in found if self._wanted(head + i.path))

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for path, n in self.files():
            ranges = max(1, -(-n // self.split)) if self.parts == "spine" else 1
            if ranges > 1:
                out += [Piece([(path, i, ranges)]) for i in range(ranges)]
                continue
            if held and size + n > self.split:
                out.append(Piece(held))
                held, size = [], 0
            held.append((path, 0, 1))
            size += n
        return [*out, Piece(held)] if held or not out else out

    def read(self, partition: Piece) -> Iterator[tuple]:
        for path, i, n in partition.files:
            system, inner = _fs(path)
            with system.open_input_file(inner) as f:
                blob = f.read()
            try:
                rows = list(self._rows(path, Container(blob), i, n))
            except BROKEN:
                empty = [None] * 4
                rows = {"spine": [(path, None, *empty, "E103")] if not i else [], "images": [], "links": [(path, None, None, None, None, "broken", None, None, None)]}[self.parts]
            yield from rows

    def _rows(self, path: str, box: Container, i: int, n: int) -> Iterator[tuple]:
        if self.parts == "spine":
            spine = box.spine()
            for k in range(len(spine) * i // n, len(spine) * (i + 1) // n):
                yield path, k + 1, spine[k], box.zip.read(spine[k]).decode("utf-8", "replace"), box.said("title"), box.said("creator"), None
        else:
            yield from ((path, *r) for r in (box.images() if self.parts == "images" else box.links()))


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class EpubWriter(DataSourceWriter):
    """Each task writes its books aside; commit moves them into place, abort drops them.

    Only files that a successful task has named are moved, so attempts that were lost or ran twice
    leave nothing. A book that is there already is an error, unless the mode is overwrite.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        self.aside = f"{self.path}/_temporary/{self.job}"

    def write(self, iterator: Iterator) -> Written:
        moves: list[tuple[str, str]] = []
        book, at = None, None

        def put() -> None:
            aside = f"{self.aside}/{uuid.uuid4().hex}"
            system, inner = _fs(aside)
            system.create_dir(posixpath.dirname(inner), recursive=True)
            with system.open_output_stream(inner) as f:
                f.write(book.close())
            moves.append((aside, f"{self.path}/{at}"))

        for r in iterator:
            if r["file"] != at:
                if book is not None:
                    put()
                at, book = r["file"], Book(r["title"] or "", r["author"] or "", f"urn:book:{r['file']}")
            if r["part"] == "image":
                book.image(r["name"], r["data"] or b"")
            elif r["part"] == "style":
                book.style(r["xhtml"] or "")
            else:
                book.chapter(r["name"], r["heading"], r["xhtml"] or "")
        if book is not None:
            put()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        moves = [m for w in messages if w is not None for m in w.moves]
        system, root = _fs(self.path)
        system.create_dir(root, recursive=True)
        finals = [_fs(b)[1] for _, b in moves]
        there = {i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File}
        clash = sorted({f for f in finals if finals.count(f) > 1} if len(set(finals)) < len(finals) else ([] if self.overwrite else there & set(finals)))
        if clash:
            self.abort(messages)
            raise ValueError(f"books written twice or there already: {clash[:5]}")
        if self.overwrite:
            for old in (f for f in there if f.endswith(".epub") and f not in set(finals)):
                system.delete_file(old)
        for (aside, _), final in zip(moves, finals):
            system.move(_fs(aside)[1], final)
        self._clear(system)

    def abort(self, messages: list) -> None:
        self._clear(_fs(self.path)[0])

    def _clear(self, system) -> None:
        from pyarrow import fs

        inner = _fs(self.aside)[1]
        if system.get_file_info(inner).type == fs.FileType.Directory:
            system.delete_dir(inner)


class EpubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("parts", "spine")]

    def reader(self, schema) -> DataSourceReader:
        return EpubReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return EpubWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make format("epub") known to a session, with conditions on path pushed to the reader."""
    spark.dataSource.register(EpubSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, parts: str = "spine") -> DataFrame:
    register(spark)
    return spark.read.format("epub").option("parts", parts).load(path)


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows of WRITE_SCHEMA as books, one file for each value of ``file``.

    A book's rows meet in one task: style sheets, chapters by seq, then images. What bounds a book (the
    size budget of a volume) bounds the task. No rows write nothing.
    """
    register(rows.sparkSession)
    names = [c.split()[0] for c in WRITE_SCHEMA.split(", ")]
    rows = rows.filter(F.col("file").isNotNull()).select(*names).repartition("file").sortWithinPartitions("file", F.expr("part <> 'style'"), F.expr("part = 'image'"), "seq", "name")
    rows.write.format("epub").mode(mode).save(path)

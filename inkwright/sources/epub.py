"""EPUB containers: a scan in spine order, and a writer."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
PAGE = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{title}</title>{style}</head><body>{body}</body></html>'


def spine(blob: bytes) -> list[tuple[int, str, bytes]]:
    """Position, path and content of the spine's linear items; items without a file are skipped."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        box = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in box.iter() if local(e) == "rootfile")
        package = ET.fromstring(z.read(opf))
        files = {e.get("id"): e.get("href") for e in package.iter() if local(e) == "item"}
        wanted = [files.get(e.get("idref")) for e in package.iter() if local(e) == "itemref" and e.get("linear") != "no"]
        names = set(z.namelist())
        paths = [resolve(opf, h) for h in wanted if h]
        return [(i, p, z.read(p)) for i, p in enumerate(p for p in paths if p in names)]


def resolve(base: str, link: str) -> str | None:
    """Path of a relative link inside a container; null for addresses elsewhere."""
    if re.match(r"(?i)(https?:|data:|//)", link):
        return None
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), link.partition("#")[0]))


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """path, page_id (from 1), href, html for each spine item of each file; a broken file gives one row with error E103."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for p, blob in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    rows = [(p, i + 1, h, x.decode("utf-8", "replace"), None) for i, h, x in spine(blob)]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration):
                    rows = [(p, None, None, None, "E103")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 5, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["path", "page_id", "href", "html", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, page_id bigint, href string, html string, error string")


#: Media types by suffix; others count as PNG, as images are made in that form.
MEDIA = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "png": "image/png"}
STYLE_LINK = '<link rel="stylesheet" type="text/css" href="{href}"/>'


class Book:
    """Writes a book part by part: the type first and stored, then what is added, then contents and package.

    Equal parts give equal bytes. Only names and titles are kept beside the container itself.
    """

    def __init__(self, title: str, author: str, uid: str, modified: str = "2000-01-01T00:00:00Z"):
        self.title, self.author, self.uid, self.modified = title, author, uid, modified
        self.out = io.BytesIO()
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        self._put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        self._put("META-INF/container.xml", CONTAINER)
        self.items: list[str] = []
        self.spine: list[str] = []
        self.contents: list[tuple[str, str]] = []
        self.styled = False

    def _put(self, name: str, data: str | bytes, how: int = zipfile.ZIP_DEFLATED) -> None:
        self.zip.writestr(zipfile.ZipInfo(name), data, how)

    def style(self, css: str) -> None:
        """A style sheet, which chapters added later refer to."""
        self._put("OEBPS/style.css", css)
        self.items.append('<item id="css" href="style.css" media-type="text/css"/>')
        self.styled = True

    def chapter(self, name: str, heading: str | None, body: str) -> None:
        link = STYLE_LINK.format(href="../style.css") if self.styled else ""
        self._put(f"OEBPS/text/{name}.xhtml", PAGE.format(title=escape(heading or self.title), body=body, style=link))
        self.items.append(f'<item id="{name}" href="text/{name}.xhtml" media-type="application/xhtml+xml"' + (' properties="svg"' if "<svg" in body else "") + "/>")
        self.spine.append(f'<itemref idref="{name}"/>')
        if heading:
            self.contents.append((name, heading))

    def image(self, name: str, data: bytes) -> None:
        """name: with its suffix, or without one for PNG."""
        stem, _, suffix = name.rpartition(".")
        file = name if stem else f"{name}.png"
        self._put(f"OEBPS/images/{file}", data)
        self.items.append(f'<item id="img_{escape(stem or name)}" href="images/{escape(file)}" media-type="{MEDIA.get(suffix.lower(), "image/png")}"/>')

    def close(self) -> bytes:
        links = "".join(f'<li><a href="text/{n}.xhtml">{escape(t)}</a></li>' for n, t in self.contents)
        points = "".join(f'<navPoint id="n{i}" playOrder="{i}"><navLabel><text>{escape(t)}</text></navLabel><content src="text/{n}.xhtml"/></navPoint>' for i, (n, t) in enumerate(self.contents, 1))
        self._put("OEBPS/nav.xhtml", PAGE.format(title=escape(self.title), body=f'<nav epub:type="toc"><ol>{links}</ol></nav>', style=""))
        self._put("OEBPS/toc.ncx", f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{escape(self.uid)}"/></head><docTitle><text>{escape(self.title)}</text></docTitle><navMap>{points}</navMap></ncx>')
        self._put("OEBPS/content.opf", f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="uid">{escape(self.uid)}</dc:identifier><dc:title>{escape(self.title)}</dc:title><dc:creator>{escape(self.author)}</dc:creator><dc:language>en</dc:language><meta property="dcterms:modified">{self.modified}</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{"".join(self.items)}</manifest><spine toc="ncx">{"".join(self.spine)}</spine></package>')
        self.zip.close()
        return self.out.getvalue()


def build(title: str, author: str, uid: str, chapters: list[tuple[str | None, str]], images: dict[str, bytes] | None = None, modified: str = "2000-01-01T00:00:00Z", css: str | None = None) -> bytes:
    """The bytes of a book of these chapters (heading, body), images and style sheet."""
    book = Book(title, author, uid, modified)
    if css is not None:
        book.style(css)
    for i, (heading, body) in enumerate(chapters, 1):
        book.chapter(f"chapter_{i:03d}", heading, body)
    for name in sorted(images or {}):
        book.image(name, images[name])
    return book.close()


def resolved(base: Column, link: Column) -> Column:
    """resolve() without Python: the folder of base, then the link, parent steps worked off."""
    parts = F.split(F.concat(F.regexp_extract(base, "^(.*/)?", 0), F.substring_index(link, "#", 1)), "/")
    steps = F.filter(parts, lambda p: (p != "") & (p != "."))
    up = lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(p)))
    path = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/")
    return F.when(~link.rlike("(?i)^(https?:|data:|//)"), path)


def volume_name(stem: str, i: int, n: int) -> str:
    return stem if n == 1 else f"{i}_of_{n}_{stem}"


def volume_title(title: str, i: int, n: int) -> str:
    return title if n == 1 else f"{title} — Volume {i} of {n}"


def write_books(chapters: DataFrame) -> DataFrame:
    """book, volume, name, epub (binary) from rows book, title, volume (from 0), volumes, file, chapter_title, xhtml.

    A volume's chapters meet in one task, which the size budget of a volume bounds.
    """

    def run(key, table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["file"])
        i, n = rows[0]["volume"] + 1, rows[0]["volumes"]
        stem = str(rows[0]["book"])
        blob = build(volume_title(rows[0]["title"], i, n), "", f"urn:book:{stem}:{i}", [(r["chapter_title"], r["xhtml"]) for r in rows])
        return pa.table({"book": [stem], "volume": pa.array([i], pa.int32()), "name": [volume_name(stem, i, n) + ".epub"], "epub": pa.array([blob], pa.binary())})

    return chapters.groupBy("book", "volume").applyInArrow(run, "book string, volume int, name string, epub binary")


def guards(files: DataFrame, xhtml: str = "xhtml") -> DataFrame:
    """Add bytes, too_large (over 300000) and dangling references of drawings, which must be none."""
    from ..functions.svg import orphans
    from ..operators.ordered import FILE_BYTES

    each = F.transform(F.regexp_extract_all(xhtml, F.lit(r"(?s)<svg\b.*?</svg>"), F.lit(0)), orphans)
    size = F.octet_length(xhtml)
    return files.withColumn("bytes", size).withColumn("too_large", size > FILE_BYTES).withColumn("dangling", F.flatten(each))


def checker_errors(lines: DataFrame, line: str = "line") -> DataFrame:
    """A checker's error lines, warnings left out."""
    return lines.filter(F.col(line).contains("ERROR") & ~F.col(line).contains("WARNING"))

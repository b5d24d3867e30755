"""Books as a data source, and their structural check."""

import io
import zipfile

import pytest

from inkwright.operators import book_check
from inkwright.sources import epub, epub_source


def rows(spark, books):
    out = []
    for file, chapters in books.items():
        out.append((file, f"T {file}", "An Author", "style", 0, "style", None, "p {}", None))
        out += [(file, f"T {file}", "An Author", "chapter", i, f"c{i}", h, b, None) for i, (h, b) in enumerate(chapters)]
        out.append((file, f"T {file}", "An Author", "image", 0, "pic.jpg", None, None, bytearray(b"\x01\x02")))
    return spark.createDataFrame(out, epub_source.WRITE_SCHEMA).repartition(5)


BOOKS = {"a.epub": [("One", "<p>1 &amp; 2</p>"), (None, "<p>x</p>"), ("Three", "<svg/>")], "b.epub": [("B", "<p>é漢</p>")]}


def test_written_and_read(spark, tmp_path):
    folder = str(tmp_path / "books")
    epub_source.write(rows(spark, BOOKS), folder)
    got = epub_source.read(spark, folder).orderBy("path", "page_id").collect()
    assert [(r.path.rpartition("/")[2], r.page_id, r.href, r.title, r.author, r.error) for r in got] == [
        (f, i + 1, f"OEBPS/text/c{i}.xhtml", f"T {f}", "An Author", None) for f in sorted(BOOKS) for i in range(len(BOOKS[f]))]
    assert all(b in r.html and '<link rel="stylesheet" type="text/css" href="../style.css"/>' in r.html for r, b in zip(got, [b for f in sorted(BOOKS) for _, b in BOOKS[f]]))
    # the reader of binary files sees the same
    plain = epub.read_epub(spark, folder).orderBy("path", "page_id").collect()
    assert [(r.page_id, r.href, r.html) for r in plain] == [(r.page_id, r.href, r.html) for r in got]
    images = epub_source.read(spark, folder, "images").collect()
    assert sorted((r.path.rpartition("/")[2], r.href, r.media_type, bytes(r.data)) for r in images) == [(f, "OEBPS/images/pic.jpg", "image/jpeg", b"\x01\x02") for f in sorted(BOOKS)]
    assert not list((tmp_path / "books").glob("_temporary/*"))
    with zipfile.ZipFile(tmp_path / "books" / "a.epub") as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert book_check.problems(epub_source.read(spark, folder, "links")).collect() == []


def test_modes_and_clashes(spark, tmp_path):
    folder = str(tmp_path / "books")
    epub_source.write(rows(spark, BOOKS), folder)
    before = (tmp_path / "books" / "a.epub").read_bytes()
    with pytest.raises(Exception, match="there already"):
        epub_source.write(rows(spark, {"b.epub": [("New", "<p/>")]}), folder)
    assert sorted(p.name for p in (tmp_path / "books").glob("*.epub")) == ["a.epub", "b.epub"]
    epub_source.write(rows(spark, {"c.epub": [("C", "<p/>")]}), folder)
    assert (tmp_path / "books" / "a.epub").read_bytes() == before
    epub_source.write(rows(spark, {"a.epub": BOOKS["a.epub"]}), folder, "overwrite")
    assert sorted(p.name for p in (tmp_path / "books").glob("*.epub")) == ["a.epub"]
    assert (tmp_path / "books" / "a.epub").read_bytes() == before  # equal parts, equal bytes
    epub_source.write(rows(spark, {}), folder)


def test_failed_write_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "books")
    bad = rows(spark, BOOKS).withColumn("xhtml", F.when(F.col("file") == "b.epub", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("xhtml")))
    with pytest.raises(Exception, match="lost"):
        epub_source.write(bad, folder)
    assert not list((tmp_path / "books").rglob("*.epub")) and not list((tmp_path / "books").glob("_temporary/*"))


def test_conditions_on_path_choose_files(spark, tmp_path):
    folder = str(tmp_path / "books")
    epub_source.write(rows(spark, {f"{x}.epub": [("H", "<p/>")] * 2 for x in "abcdef"}), folder)
    (tmp_path / "books" / "zz.epub").write_bytes(b"no zip")
    reader = epub_source.EpubReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    left = list(reader.pushFilters([EqualTo(("path",), f"{folder}/c.epub"), GreaterThan(("page_id",), 1), StringStartsWith(("path",), folder)]))
    assert left == [GreaterThan(("page_id",), 1)] and [p for p, _ in reader.files()] == [f"{folder}/c.epub"]
    got = epub_source.read(spark, folder).filter(f"path = '{folder}/c.epub' and page_id > 1")
    assert [(r.path, r.page_id) for r in got.collect()] == [(f"{folder}/c.epub", 2)]
    assert [(r.path, r.error) for r in epub_source.read(spark, folder).filter("error is not null").collect()] == [(f"{folder}/zz.epub", "E103")]


def test_large_books_are_cut_by_spine_ranges(spark, tmp_path):
    folder = str(tmp_path / "books")
    epub_source.write(rows(spark, {"a.epub": [(f"H{i}", "<p/>") for i in range(11)], "b.epub": [("B", "")]}), folder)
    epub_source.register(spark)
    df = spark.read.format("epub").option("splitBytes", 1000).load(folder)
    assert df.rdd.getNumPartitions() > 4
    assert sorted((r.path.rpartition("/")[2], r.page_id) for r in df.collect()) == [("a.epub", i) for i in range(1, 12)] + [("b.epub", 1)]


def book(entries, opf, first="mimetype", how=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(first, "application/epub+zip", how)
        z.writestr("META-INF/container.xml", epub.CONTAINER)
        z.writestr("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf">{opf}</package>')
        for name, text in entries.items():
            z.writestr(f"OEBPS/{name}", text)
    return out.getvalue()


def test_faults(spark, tmp_path):
    x = 'media-type="application/xhtml+xml"'
    opf = f'<manifest><item id="a" href="a.xhtml" {x}/><item id="b" href="b.xhtml" {x}/><item id="gone" href="gone.xhtml" {x}/><item id="c" href="c.xhtml" {x}/><item id="p" href="p.png" media-type="image/png"/></manifest><spine><itemref idref="a"/><itemref idref="gone"/><itemref idref="nobody"/></spine>'
    entries = {
        "a.xhtml": '<html xmlns="http://www.w3.org/1999/xhtml"><p id="i"/><p id="i"/><p id="j"/><a href="b.xhtml#k"/><a href="b.xhtml#l"/><a href="#j"/><a href="#m"/><img src="p.png"/><img src="q.png"/><a href="https://elsewhere"/></html>',
        "b.xhtml": '<html><p id="k"/></html>', "c.xhtml": "<html><p></html>", "p.png": "", "extra.css": "",
    }
    (tmp_path / "bad.epub").write_bytes(book(entries, opf, how=zipfile.ZIP_DEFLATED))
    (tmp_path / "fine.epub").write_bytes(epub.build("T", "A", "u", [("One", '<p id="x"/><a href="chapter_002.xhtml#y">2</a>'), (None, '<p id="y"/>')], {"pic": b"1"}, css="p {}"))
    (tmp_path / "zip.epub").write_bytes(b"nothing")
    got = book_check.problems(epub_source.read(spark, str(tmp_path), "links")).collect()
    assert sorted(((r.path.rpartition("/")[2], r.code, r.entry, r.detail if r.code != "unreadable_entry" else None) for r in got), key=repr) == sorted([
        ("bad.epub", "mimetype", "mimetype", "mimetype"), ("bad.epub", "missing_file", "OEBPS/content.opf", "OEBPS/gone.xhtml"), ("bad.epub", "unknown_item", "OEBPS/content.opf", "nobody"),
        ("bad.epub", "duplicate_id", "OEBPS/a.xhtml", "i"), ("bad.epub", "dangling_fragment", "OEBPS/a.xhtml", "b.xhtml#l"), ("bad.epub", "dangling_fragment", "OEBPS/a.xhtml", "#m"),
        ("bad.epub", "dangling_link", "OEBPS/a.xhtml", "q.png"), ("bad.epub", "not_in_manifest", "OEBPS/extra.css", "OEBPS/extra.css"), ("bad.epub", "unreachable", "OEBPS/content.opf", "OEBPS/c.xhtml"),
        ("bad.epub", "unreadable_entry", "OEBPS/c.xhtml", None), ("zip.epub", "unreadable_container", None, None)], key=repr)

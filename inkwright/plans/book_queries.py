"""Queries on books: pages written as EPUB files, read back and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import book_check
from ..operators import markup as M
from ..sources import epub, epub_source
from ..sources.shared import shared_folder
from .table_queries import ORACLES as TABLE_ORACLES

#: Pages of one file, and what the books share.
PAGES_A_BOOK = 100
CSS = "p { margin: 0 }"
PIXEL = b"\x89PNG"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chapters(pages: DataFrame, body, heading) -> DataFrame:
    """Books of at most PAGES_A_BOOK pages, one or more for each host."""
    host = F.regexp_extract("url", "://([^/]+)", 1)
    file = F.concat(host, F.lit("_"), F.expr(f"page_id div {PAGES_A_BOOK}"), F.lit(".epub"))
    return pages.select(file.alias("file"), host.alias("title"), F.concat(F.lit("Host "), host).alias("author"), F.lit("chapter").alias("part"), F.col("page_id").cast("int").alias("seq"), F.concat(F.lit("page_"), "page_id").alias("name"), heading.alias("heading"), body.alias("xhtml"), F.lit(None).cast("binary").alias("data"))


def _with_assets(chapters: DataFrame) -> DataFrame:
    books = chapters.select("file", "title", "author").distinct()
    asset = lambda part, name, css, data: books.select("file", "title", "author", F.lit(part).alias("part"), F.lit(0).alias("seq"), F.lit(name).alias("name"), F.lit(None).cast("string").alias("heading"), F.lit(css).cast("string").alias("xhtml"), F.lit(data).cast("binary").alias("data"))
    return chapters.unionByName(asset("style", "style", CSS, None)).unionByName(asset("image", "cover", None, PIXEL))


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Chapters are the blocks of pages as paragraphs; each book has a style sheet and a cover."""
    pages = _table(spark, sf_dir, "pages")
    blocks = M.page_blocks(pages).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("b"))
    body = F.coalesce(F.array_join(F.transform("b", lambda x: F.concat(F.lit("<p>"), T.escape(x["text"]), F.lit("</p>"))), ""), F.lit(""))
    folder = shared_folder(spark, "books")
    epub_source.write(_with_assets(_chapters(pages.join(blocks, "page_id", "left"), body, M.title(F.col("html")))), folder)
    return folder


def _file():
    return F.regexp_extract("path", "[^/]+$", 0).alias("file")


def books_round_trip(spark, sf_dir):
    found = epub_source.read(spark, _written(spark, sf_dir))
    return found.select(_file(), "page_id", "href", "html", "title", "author", "error")


def book_images(spark, sf_dir):
    """Image files of books, with their bytes."""
    found = epub_source.read(spark, _written(spark, sf_dir), "images")
    return found.select(_file(), "href", "media_type", F.octet_length("data").alias("bytes"), F.hex("data").alias("data"))


def book_problems(spark, sf_dir):
    """Faults of books whose chapters link to the pages that their navigation names, and to the page before."""
    pages = _table(spark, sf_dir, "pages")
    slugs = F.transform(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)), lambda s: F.regexp_replace(s, '[&<>"#;:]', ""))
    links = F.array_join(F.transform(slugs, lambda s: F.concat(F.lit('<p id="'), s, F.lit('"><a href="'), s, F.lit('.xhtml">x</a></p>'))), "")
    body = F.concat(links, F.lit('<p><a href="page_'), F.col("page_id") - 1, F.lit('.xhtml#x">x</a></p>'))
    folder = shared_folder(spark, "books")
    epub_source.write(_chapters(pages, body, F.concat(F.lit("Page "), "page_id")), folder)
    found = book_check.problems(epub_source.read(spark, folder, "links"))
    return found.select(_file(), "code", "entry", "detail")


QUERIES = {f.__name__: f for f in (books_round_trip, book_images, book_problems)}


def oracles(blocks_sql: str, titles_sql: str) -> dict[str, str]:
    """SQL, given that of page_blocks and page_titles."""
    file = f"regexp_extract(url, '://([^/]+)', 1) || '_' || (page_id // {PAGES_A_BOOK}) || '.epub'"
    esc = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    page = epub.PAGE.replace("'", "''").replace("{style}", epub.STYLE_LINK.format(href="../style.css"))
    head, _, rest = page.partition("{title}")
    middle, _, tail = rest.partition("{body}")
    quoted_title = f"replace({esc.format('coalesce(nullif(t.title, repeat(host, 0)), host)')}, '''', '&#x27;')"
    return {
        "books_round_trip": f"""
WITH b AS ({blocks_sql}), t AS ({titles_sql}),
body AS (SELECT page_id, string_agg('<p>' || {esc.format("text")} || '</p>', '' ORDER BY seq) AS body FROM b GROUP BY page_id),
p AS (SELECT *, {file} AS file, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY page_id) AS page_id, 'OEBPS/text/page_' || p.page_id || '.xhtml' AS href, '{head}' || {quoted_title} || '{middle}' || coalesce(body, '') || '{tail}' AS html, host AS title, 'Host ' || host AS author, NULL::VARCHAR AS error
FROM p JOIN t USING (page_id) LEFT JOIN body USING (page_id)""",
        "book_images": f"SELECT DISTINCT {file} AS file, 'OEBPS/images/cover.png' AS href, 'image/png' AS media_type, {len(PIXEL)}::INT AS bytes, '{PIXEL.hex().upper()}' AS data FROM pages",
        "book_problems": f"""
WITH p AS (SELECT page_id, {file} AS file, html FROM pages),
s AS (SELECT page_id, file, regexp_replace(unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)), '[&<>"#;:]', '', 'g') AS slug FROM p)
SELECT file, 'dangling_link' AS code, 'OEBPS/text/page_' || page_id || '.xhtml' AS entry, slug || '.xhtml' AS detail FROM s
UNION ALL SELECT file, 'duplicate_id', 'OEBPS/text/page_' || page_id || '.xhtml', slug FROM s GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT a.file, unnest(CASE WHEN b.page_id IS NULL THEN ['dangling_link', 'dangling_fragment'] ELSE ['dangling_fragment'] END), 'OEBPS/text/page_' || a.page_id || '.xhtml', 'page_' || (a.page_id - 1) || '.xhtml#x' FROM p a LEFT JOIN p b ON b.page_id = a.page_id - 1 AND b.file = a.file""",
    }


ORACLES = oracles(TABLE_ORACLES["page_blocks"], TABLE_ORACLES["page_titles"])

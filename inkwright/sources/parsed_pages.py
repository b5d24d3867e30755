"""Nested JSON of a page parser to text, equation and figure rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import latex as L
from ..functions import text as T
from ..functions.strings import let

_SPAN = "struct<type:string,content:string,bbox:array<double>,html:string>"
_LINES = f"array<struct<spans:array<{_SPAN}>>>"
_INNER = f"struct<type:string,bbox:array<double>,index:double,lines:{_LINES}>"
_BLOCK = f"struct<type:string,bbox:array<double>,index:double,lines:{_LINES},blocks:array<{_INNER}>>"
SCHEMA = f"pdf_info array<struct<page_idx:int,page_size:array<double>,para_blocks:array<{_BLOCK}>,discarded_blocks:array<{_BLOCK}>>>"
NOTE_ORDER = 1_000_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, page (absolute), page_size, blocks, discarded. The first page of a batch is in its folder's name."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True).withColumn("file", F.input_file_name())
    return rebase(raw)


def each(rows: DataFrame, items: Column, name: str, *keep: str) -> DataFrame:
    """keep and one item a row. An outer explode, less the rows without a place: for an inner one Spark adds a
    condition on the array, which works it out a second time."""
    return rows.select(*keep, F.posexplode_outer(items).alias("__at", name)).filter("__at is not null").drop("__at")


def rebase(raw: DataFrame) -> DataFrame:
    offset = F.coalesce(F.regexp_extract("file", r"batch_(\d+)_", 1).try_cast("int"), F.lit(0))
    rows = each(raw.withColumn("offset", offset), F.col("pdf_info"), "p", "file", "offset")
    return rows.select("file", (F.col("p.page_idx") + F.col("offset")).alias("page"), F.col("p.page_size").alias("page_size"), F.col("p.para_blocks").alias("blocks"), F.col("p.discarded_blocks").alias("discarded"))


def preferred(files: DataFrame, stem: str, path: str = "path") -> DataFrame:
    """The one parse to read: that named after the document, else the first of any other name."""
    found = files.filter(F.col(path).endswith("_middle.json")).withColumn("preference", F.when(F.col(path).endswith(f"/{stem}_middle.json"), 0).otherwise(1))
    return found.orderBy("preference", path).limit(1)


def preferred_each(files: DataFrame, document: str = "document", path: str = "path") -> DataFrame:
    """document, path, preference: one parse a document, chosen as by preferred(), the document's name
    being the stem. Documents without a parse have no row; a null document has none either."""
    named = F.col(path).endswith(F.concat(F.lit("/"), F.col(document), F.lit("_middle.json")))
    found = files.filter(F.col(path).endswith("_middle.json") & F.col(document).isNotNull())
    best = F.min(F.struct(F.when(named, 0).otherwise(1).alias("preference"), F.col(path).alias("path")))
    return found.groupBy(document).agg(best.alias("b")).select(document, F.col("b.path").alias(path), F.col("b.preference").alias("preference"))


def pending(expected: DataFrame, present: DataFrame, whole_present: bool, key: str = "dir") -> DataFrame:
    """Batches still to parse: none once the whole document is parsed, else those that are not there."""
    return expected.filter(F.lit(not whole_present)).join(present.select(key), key, "left_anti")


def spans(lines: Column) -> Column:
    return F.flatten(F.transform(F.coalesce(lines, F.array()), lambda x: F.coalesce(x["spans"], F.array())))


def _is_formula(s: Column) -> Column:
    return s["type"].isin("inline_equation", "interline_equation")


def _joined(lines: Column, page: Column, before: Column) -> Column:
    """A block's text, its formulas as placeholders of their ids; ``before`` of the page's stand before it."""

    def shown(all_: Column) -> Column:
        seq = lambda i: before + F.size(F.filter(F.slice(all_, F.lit(1), i + 1), _is_formula))
        return F.transform(all_, lambda s, i: F.when(_is_formula(s), T.placeholder(F.concat_ws("_", F.lit("eq"), page, seq(i)))).otherwise(F.trim(F.coalesce(s["content"], F.lit("")))))

    return F.array_join(F.filter(let(spans(lines), shown), lambda t: t != ""), " ")


def flat_blocks(pages: DataFrame) -> DataFrame:
    """file, page, type, parent, reading_order, lines: a list's sub-blocks follow it by fractions. Pages are
    read once, a block with sub-blocks giving them in its place."""
    top = pages.select("file", "page", F.posexplode("blocks").alias("pos", "b"))
    order = F.coalesce("b.index", F.col("pos").cast("double"))
    row = lambda b, parent, at: F.struct(b["type"].alias("type"), parent.cast("string").alias("parent"), at.alias("reading_order"), b["lines"].alias("lines"))
    sub = F.transform("b.blocks", lambda s, i: row(s, F.col("b.type"), order + i / 1024))
    whole = F.array(row(F.col("b"), F.lit(None), order))
    return each(top, F.when(F.size(F.coalesce("b.blocks", F.array())) == 0, whole).otherwise(sub), "r", "file", "page").select("file", "page", "r.*")


def _numbered(blocks: DataFrame) -> DataFrame:
    """Add before: the formulas of the page in blocks before this one."""
    w = W.partitionBy("file", "page").orderBy("reading_order").rowsBetween(W.unboundedPreceding, -1)
    own = F.size(F.filter(spans(F.col("lines")), _is_formula))
    return blocks.withColumn("before", F.coalesce(F.sum(own).over(w), F.lit(0)))


def text_rows(blocks: DataFrame) -> DataFrame:
    """file, page, kind, reading_order, text: titles are headings, list parts list items, the rest
    text; formulas stand as placeholders of their region ids (see equation_rows). Blank rows go, and
    pipe tables, which are figures."""
    body = _numbered(blocks).filter((F.col("type") != "interline_equation") & ~F.coalesce(F.col("type").endswith("_body"), F.lit(False)))
    kind = F.when(F.col("type") == "title", "heading").when(F.col("parent").isNotNull() & ~F.col("parent").isin("image", "table"), "list_item").otherwise("text")
    rows = body.select("file", "page", kind.alias("kind"), "reading_order", _joined(F.col("lines"), F.col("page"), F.col("before")).alias("text"))
    return rows.filter((F.col("text") != "") & ~T.is_pipe_table(F.col("text")))


def figure_rows(blocks: DataFrame) -> DataFrame:
    """file, page, reading_order, alt_text, table_html of images, tables and pipe tables. Blocks are read once."""
    figure = lambda alt, html: F.array(F.struct(alt.alias("alt_text"), html.alias("table_html")))

    def drawn(all_: Column) -> Column:
        alt = F.regexp_replace(F.trim(F.array_join(F.transform(all_, lambda s: F.coalesce(s["content"], F.lit(""))), " ")), r"\s+", " ")
        return figure(alt, F.get(F.filter(F.transform(all_, lambda s: s["html"]), lambda h: h.isNotNull()), F.lit(0)))

    def piped(all_: Column) -> Column:
        shown = F.filter(F.transform(all_, lambda s: F.trim(F.coalesce(s["content"], F.lit("")))), lambda t: t != "")
        html = F.when(~F.exists(all_, lambda s: F.coalesce(_is_formula(s), F.lit(False))), T.pipe_table_html(F.array_join(shown, " ")))
        return F.filter(figure(F.lit("table"), html), lambda f: f["table_html"].isNotNull())

    # an array a block, so that a condition on what comes out isn't worked out a second time before it
    found = let(spans(F.col("lines")), lambda all_: F.when(F.col("type") == "text", piped(all_)).otherwise(drawn(all_)))
    kinds = blocks.filter(F.col("type").isin("text", "image_body", "table_body"))
    return each(kinds, found, "f", "file", "page", "reading_order").select("file", "page", "reading_order", "f.*")


def tables_and_formulas(figures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """figure_rows() with the formulas of table cells as placeholders, and these formulas as rows like
    those of equation_rows(): inline, named eq_<page>_t<number>, numbered through a page by reading order."""
    from ..functions.table_functions import formulas_in_tables

    named = figures.withColumn("stem", F.concat_ws("_", F.lit("eq"), "page"))
    rows = formulas_in_tables(named, "table_html", "stem", ["file", "page"], ["reading_order"])
    shown = rows.filter("row_kind = 'table'").select("file", "page", "reading_order", "alt_text", F.col("html").alias("table_html"))
    found = rows.filter("row_kind = 'formula'").select("file", "page", F.col("formula").alias("seq"), "reading_order", "region_id", F.lit("inline").alias("formula_class"), F.col("latex").alias("raw_latex"), F.lit(None).cast("string").alias("equation_number"), L.simple_text(F.col("latex")).alias("inline_text_repr"))
    return shown, found.withColumn("render_as_text", F.col("inline_text_repr").isNotNull())


def equation_rows(blocks: DataFrame) -> DataFrame:
    """file, page, seq, reading_order, region_id, formula_class, raw_latex (without tags), equation_number,
    render_as_text, inline_text_repr."""
    one = _numbered(blocks).select("file", "page", "reading_order", "before", F.posexplode(F.filter(spans(F.col("lines")), _is_formula)).alias("k", "s"))
    seq, raw = (F.col("before") + F.col("k") + 1).cast("int"), F.col("s.content")
    rows = one.select("file", "page", seq.alias("seq"), "reading_order", F.concat_ws("_", F.lit("eq"), "page", seq).alias("region_id"), F.when(F.col("s.type") == "inline_equation", "inline").otherwise("display").alias("formula_class"), L.without_tags(raw).alias("raw_latex"), L.equation_number(raw).alias("equation_number"))
    simple = F.when(F.col("formula_class") == "inline", L.simple_text(F.col("raw_latex")))
    return rows.withColumn("inline_text_repr", simple).withColumn("render_as_text", F.col("inline_text_repr").isNotNull())


def footnote_rows(pages: DataFrame) -> DataFrame:
    """file, page, note_id, number, reading_order, text of page footnotes among what the parser set aside."""
    notes = pages.select("file", "page", F.posexplode("discarded").alias("pos", "b")).filter("b.type = 'page_footnote'")
    k = F.row_number().over(W.partitionBy("file", "page").orderBy("pos"))
    contents = F.filter(F.transform(spans(F.col("b.lines")), lambda s: F.trim(F.coalesce(s["content"], F.lit("")))), lambda t: t != "")
    number = F.nullif(F.regexp_extract(F.get(contents, F.lit(0)), r"^\^\s*\{\s*(\d+)\s*\}$", 1), F.lit(""))
    return notes.select("file", "page", F.concat_ws("_", F.lit("fn"), "page", k).alias("note_id"), number.alias("number"), (F.lit(NOTE_ORDER) + k - 1).cast("double").alias("reading_order"), F.array_join(contents, " ").alias("text"))


VERSION = 1
_EQUATION = "page int, `order` double, region_id string, class string, raw_latex string, render_as_text boolean, inline_text_repr string, equation_number string, deduped boolean"
SNAPSHOT = f"version int, counts struct<equations:bigint,display:bigint,inline:bigint,render_as_text:bigint,deduped:bigint,pages:bigint>, equations array<struct<{', '.join(f.replace(' ', ':', 1) for f in _EQUATION.split(', '))}>>"


def snapshot_json(equations: DataFrame, book: str) -> DataFrame:
    """book, value: one JSON object a book, of a version, counts, and the equations in order (order,
    then region id as text). A book's equations meet in one row, as they do in its file."""
    names = [f.split(" ")[0].strip("`") for f in _EQUATION.split(", ")]
    rows = equations.select(book, *[(F.col(f"`{n}`") if n in equations.columns else F.lit(None)).cast(t).alias(n) for n, t in zip(names, (f.split(" ")[1] for f in _EQUATION.split(", ")))])
    key = F.struct(F.coalesce("order", F.lit(0.0)).alias("o"), F.col("region_id").alias("r"))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = F.struct(F.count("*").alias("equations"), n(F.col("class") == "display").alias("display"), n(F.col("class") == "inline").alias("inline"), n(F.col("render_as_text")).alias("render_as_text"), n(F.col("deduped")).alias("deduped"), F.countDistinct("page").alias("pages"))
    got = rows.groupBy(book).agg(counts.alias("counts"), F.sort_array(F.collect_list(F.struct(key.alias("k"), F.struct(*[f"`{x}`" for x in names]).alias("e")))).alias("all"))
    return got.select(book, F.to_json(F.struct(F.lit(VERSION).alias("version"), "counts", F.col("all.e").alias("equations"))).alias("value"))


def snapshot_rows(files: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    """The equations of snapshots, numbered from 0 in their order; other versions give none."""
    one = files.select(*keep, F.from_json(value, SNAPSHOT).alias("s")).filter(F.col("s.version") == VERSION)
    return one.select(*keep, F.posexplode("s.equations").alias("seq", "e")).select(*keep, "seq", "e.*")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Equation rows of the snapshot files under path, with file and seq."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return snapshot_rows(files, "value", "file")


def write_snapshot(equations: DataFrame, path: str, book: str) -> None:
    """A folder a book, each with one snapshot file."""
    snapshot_json(equations, book).repartition(book).write.mode("overwrite").partitionBy(book).text(path)

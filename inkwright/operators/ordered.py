"""Reading order, merging, chapters, size splits, volumes, notes: order is data here."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Ends of a finished paragraph, budgets.
TERMINAL = r"[.!?:;…\"”'’)\]]\s*$"
FILE_CHARS, FILE_BYTES, VOLUME_SVGS = 220_000, 300_000, 900


def units(texts: DataFrame, figures: DataFrame, equations: DataFrame) -> DataFrame:
    """One table of units; class_rank keeps text before figures before equations on a tie."""
    parts = [d.withColumn("class_rank", F.lit(i)).withColumn("unit", F.lit(u)) for i, (u, d) in enumerate((("text", texts), ("figure", figures), ("equation", equations)))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def reading_order(df: DataFrame, doc: str, keys: tuple[str, ...] = ("page", "order", "y0", "class_rank", "seq")) -> DataFrame:
    """Add pos, from 0, within the document."""
    return df.withColumn("pos", F.row_number().over(W.partitionBy(doc).orderBy(*keys)) - 1)


def merge_continuations(df: DataFrame, doc: str, order: str, page: str | None = None, kind: str = "kind", text: str = "text", tail: str | None = None) -> DataFrame:
    """doc, island, first (order of its first unit), kind, page, parts, text: paragraphs that a page
    break cut are joined.

    A text unit goes on from the one before if that is text, on this page or the last, and its
    visible tail is neither blank nor finished. A hyphen at the end of a part is dropped; else parts
    join by a space.
    """
    w = W.partitionBy(doc).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    end = tail or text
    near = (F.col(page) - before(page)).between(0, 1) if page else F.lit(True)
    joins = (F.col(kind) == "text") & (before(kind) == "text") & near & (F.trim(before(end)) != "") & ~before(end).rlike(TERMINAL)
    marked = df.withColumn("island", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    head = F.struct(order, kind, *([page] if page else []))
    grouped = marked.groupBy(doc, "island").agg(F.min(head).alias("head"), F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct(order, F.col(text).alias("t")))).alias("p"))

    def glue(a: Column, x: Column) -> Column:
        left = F.rtrim(a)
        return F.when(left.endswith("-"), F.concat(F.left(left, F.length(left) - 1), x)).otherwise(F.concat(left, F.lit(" "), x))

    # parts but the first are glued to what stands before them
    whole = F.aggregate(F.slice("p.t", F.lit(2), F.size("p")), F.element_at("p.t", 1), glue)
    return grouped.select(doc, "island", F.col(f"head.{order}").alias("first"), F.col(f"head.{kind}").alias("kind"), *([F.col(f"head.{page}").alias("page")] if page else []), "parts", whole.alias("text"))


def chapters_by_heading(df: DataFrame, doc: str, order: str, kind: str = "kind", text: str = "text", book_title: str | None = None) -> DataFrame:
    """Add chapter (0 before the first heading) and chapter_title."""
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    head = F.col(kind) == "heading"
    title = F.last(F.when(head, F.col(text)), ignorenulls=True).over(w)
    return df.withColumn("chapter", F.sum(head.cast("int")).over(w)).withColumn("chapter_title", F.coalesce(title, F.col(book_title) if book_title else F.lit(None)))


def chapters_by_page(df: DataFrame, doc: str, order: str, page: str, titles: DataFrame | None = None, stem: str | None = None) -> DataFrame:
    """Add chapter: a new one with each change of page; titles (doc, page, title) are joined, the
    stem stands in for a missing one."""
    w = W.partitionBy(doc).orderBy(order)
    new = F.coalesce(F.col(page) != F.lag(page).over(w), F.lit(True))
    out = df.withColumn("__new", new.cast("int")).withColumn("chapter", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("__new")
    if titles is None:
        return out
    out = out.join(titles.select(doc, page, F.col("title").alias("chapter_title")), [doc, page], "left")
    return out.withColumn("chapter_title", F.coalesce("chapter_title", F.col(stem) if stem else F.lit(None)))


def toc(df: DataFrame, volume: list[str], order: str, title: str = "title") -> DataFrame:
    """Titled files, numbered anew in each volume."""
    return df.filter(F.col(title).isNotNull()).withColumn("toc_no", F.row_number().over(W.partitionBy(*volume).orderBy(order)))


def size_split(df: DataFrame, doc: str, order: str, size: str, heading: str | None = None, breaks: str | None = None, budget: int = FILE_CHARS) -> DataFrame:
    """Add file (from 0 within the document) and split (its first unit continues a chapter).

    Units are taken in order; a file closes before the unit that would take it over the budget, but
    not right after a heading, and wherever ``breaks`` says. Serial within a document by nature:
    rows stream through in order, so a document takes no memory, only one task's time.
    """
    w_head, w_break = (F.col(c) if c else F.lit(False) for c in (heading, breaks))
    rows = df.withColumn("__s", F.col(size).cast("long")).withColumn("__h", F.coalesce(w_head, F.lit(False))).withColumn("__b", F.coalesce(w_break, F.lit(False)))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]) + ", file int, split boolean"
    n_own = len(df.columns)
    at_doc = df.columns.index(doc)

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, file, held, empty, after_head = object(), 0, 0, True, False
        for b in batches:
            docs, sizes, heads, cuts = (b.column(i).to_pylist() for i in (at_doc, n_own, n_own + 1, n_own + 2))
            files, splits = [], []
            for d, s, h, c in zip(docs, sizes, heads, cuts):
                if d != now:
                    now, file, held, empty, after_head = d, 0, 0, True, False
                over = not empty and not after_head and held + (s or 0) > budget
                split = False
                if not empty and (c or over):
                    file, held, split = file + 1, 0, not c
                held, empty, after_head = held + (s or 0), False, h
                files.append(file)
                splits.append(split)
            yield pa.RecordBatch.from_arrays([*b.columns[:n_own], pa.array(files, pa.int32()), pa.array(splits)], [*b.schema.names[:n_own], "file", "split"])

    return rows.repartition(doc).sortWithinPartitions(doc, order).mapInArrow(fold, schema)


def pack_volumes(df: DataFrame, book: str, order: str, count: str, titled: str, budget: int = VOLUME_SVGS) -> DataFrame:
    """book, order, volume: chapters in order, a new volume before a titled chapter that would take
    it over the budget; 0 or less: one volume. A chapter and its untitled continuations stay together.
    """
    one = F.struct(F.col(order).alias("o"), F.col(count).cast("long").alias("n"), F.coalesce(F.col(titled), F.lit(False)).alias("t"))
    lists = df.groupBy(book).agg(F.sort_array(F.collect_list(one)).alias("c"))
    # groups: a titled chapter with what continues it
    group = F.aggregate("c", F.array().cast("array<struct<n:bigint,k:int>>"), lambda a, x: F.when(x["t"] | (F.size(a) == 0), F.concat(a, F.array(F.struct(x["n"].alias("n"), F.lit(1).alias("k"))))).otherwise(F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct((F.element_at(a, -1)["n"] + x["n"]).alias("n"), (F.element_at(a, -1)["k"] + 1).alias("k"))))))
    state = "struct<v:int,held:bigint,out:array<int>>"
    start = F.struct(F.lit(0).alias("v"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("out")).cast(state)

    def step(a: Column, g: Column) -> Column:
        new = (F.lit(budget) > 0) & (F.size(a["out"]) > 0) & (a["held"] + g["n"] > budget)
        v = a["v"] + new.cast("int")
        return F.struct(v.alias("v"), (F.when(new, F.lit(0)).otherwise(a["held"]) + g["n"]).cast("long").alias("held"), F.concat(a["out"], F.array_repeat(v, g["k"])).alias("out")).cast(state)

    volumes = F.aggregate(group, start, step)["out"]
    rows = lists.select(book, F.explode(F.arrays_zip(F.col("c.o").alias("o"), volumes.alias("v"))).alias("z"))
    return rows.select(book, F.col("z.o").alias(order), F.col("z.v").alias("volume"))


def place_notes(notes: DataFrame, files: DataFrame, markers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, note_id, file, linked: where each note is printed.

    Linked notes (a marker points at them) go to their marker's file; others to the first file that
    holds content of a later page; the rest, and those without a page, to the last file. files: doc,
    file, max_page. An as-of join: a document's notes and files are sorted once, not paired.
    """
    at = markers.groupBy(doc, "note_id").agg(F.min("file").alias("marker_file"))
    last = files.groupBy(doc).agg(F.max("file").alias("last_file"))
    # from the last page back, notes meet the smallest file among those that end on a later page
    ends = files.select(doc, F.col("max_page").alias("page"), "file", F.lit(None).cast(dict(notes.dtypes)["note_id"]).alias("note_id"), F.lit(True).alias("ends"))
    asked = notes.select(doc, "page", F.lit(None).cast(dict(files.dtypes)["file"]).alias("file"), "note_id", F.lit(False).alias("ends"))
    back = W.partitionBy(doc).orderBy(F.col("page").desc(), "ends").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = ends.union(asked).withColumn("later_file", F.min("file").over(back)).filter("not ends and page is not null")
    later = met.groupBy(doc, "note_id").agg(F.min("later_file").alias("later_file"))
    out = notes.join(at, [doc, "note_id"], "left").join(later, [doc, "note_id"], "left").join(last, doc, "left")
    return out.select(doc, "note_id", F.coalesce("marker_file", "later_file", "last_file").alias("file"), F.col("marker_file").isNotNull().alias("linked"))


def number_within(df: DataFrame, by: list[str], order: list[str], prefix: str, name: str = "id") -> DataFrame:
    """Ids such as eq_3_7: the row's number within its page."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, F.concat_ws("_", F.lit(prefix), F.col(by[-1]).cast("string"), n.cast("string")))


def images_of_volumes(chapters: DataFrame, images: DataFrame, volume: list[str], xhtml: str = "xhtml", image: str = "image") -> DataFrame:
    """volume, image: the images whose file a chapter of the volume shows."""
    shown = chapters.select(*volume, F.explode(F.regexp_extract_all(xhtml, F.lit(r"images/([^\"/]+)\.png"), F.lit(1))).alias(image)).distinct()
    return shown.join(images.select(image), image, "left_semi").select(*volume, image)


def drawing_totals(chapters: DataFrame, book: str, volume: str, chapter: str, xhtml: str = "xhtml") -> DataFrame:
    """drawings of each chapter, of each volume (chapter null) and of each book (both null)."""
    from ..functions.svg import count

    rows = chapters.select(book, volume, chapter, count(F.col(xhtml)).cast("long").alias("n"))
    return rows.groupingSets([[book], [book, volume], [book, volume, chapter]], book, volume, chapter).agg(F.sum("n").alias("drawings"))

"""Structural check of books: every reference in a container against what it refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Entries that no manifest lists.
OUTSIDE = r"^(mimetype$|META-INF/)"


def problems(links: DataFrame) -> DataFrame:
    """path, code, entry, detail of every fault in books, from rows of format epub with parts "links".

    mimetype: the first entry isn't the stored file of that name. missing_file: a manifest item
    without file. unknown_item: a spine reference to no item. dangling_link, dangling_fragment: a
    link to no file, or to no id (a link to an id in no file is both). duplicate_id: an id that stands more than once in an entry,
    told once. not_in_manifest: a file that no item lists. unreachable: a chapter that neither spine nor
    links reach. unreadable_entry, unreadable_container: markup or a file that can't be parsed.

    Each row states facts and needs by name; names meet in one exchange, and a need without a fact is
    a fault. A name with very many references in one book is the largest group. No rows, no faults.
    """
    c = F.col
    never = F.lit("never")

    def claim(when: Column, space: Column | str, name: Column, code: str | Column | None = None, detail: Column | None = None) -> Column:
        """A need with a code, a fact without one; null where the condition doesn't hold."""
        space = F.lit(space) if isinstance(space, str) else space
        code = F.lit(code).cast("string") if code is None or isinstance(code, str) else code
        return F.when(when, F.struct(space.alias("space"), name.alias("name"), code.alias("code"), (F.lit(None).cast("string") if detail is None else detail).alias("detail")))

    kind = lambda k: c("kind") == k
    anchor = F.concat_ws("#", "target", "fragment")
    xhtml = kind("item") & (c("fragment") == "application/xhtml+xml")
    chapter = F.lower("target").rlike(r"\.(xhtml|html|htm)$")
    claims = F.array(
        claim(kind("entry"), "file", c("entry")),
        claim(kind("id"), "id", F.concat_ws("#", "entry", "value"), detail=c("value")),
        claim(kind("item"), "item", c("value")),
        claim(kind("item") & c("target").isNotNull(), "listed", c("target")),
        claim((kind("link") | kind("itemref")) & c("target").isNotNull(), "reached", c("target")),
        claim(kind("item"), "file", c("target"), "missing_file", c("target")),
        claim(kind("itemref"), "item", c("value"), "unknown_item", c("value")),
        claim(kind("link"), "file", c("target"), "dangling_link", c("value")),
        claim(kind("link") & c("fragment").isNotNull() & chapter, "id", anchor, "dangling_fragment", c("value")),
        claim(kind("entry") & ~c("entry").rlike(OUTSIDE) & (c("role") != "package") & ~c("entry").endswith("/"), "listed", c("entry"), "not_in_manifest", c("entry")),
        claim(xhtml, "reached", c("target"), "unreachable", c("target")),
        claim(kind("entry") & (c("position") == 0) & ~((c("entry") == "mimetype") & c("stored")), never, c("entry"), "mimetype", c("entry")),
        claim(kind("unreadable"), never, c("entry"), "unreadable_entry"),
        claim(kind("broken"), never, F.lit(""), "unreadable_container"),
    )
    rows = links.select("path", "entry", "position", F.explode(F.filter(claims, lambda x: x.isNotNull())).alias("x")).select("path", "entry", "x.*")
    here = W.partitionBy("path", "space", "name")
    facts = F.sum(c("code").isNull().cast("int")).over(here)
    rows = rows.withColumn("facts", facts).withColumn("nth", F.row_number().over(here.orderBy(c("code").asc_nulls_first())))
    twice = c("code").isNull() & (c("space") == "id") & (c("facts") > 1) & (c("nth") == 1)
    fault = F.when(twice, "duplicate_id").when(c("code").isNotNull() & (c("facts") == 0), c("code"))
    found = rows.withColumn("fault", fault).filter("fault is not null")
    return found.select("path", c("fault").alias("code"), "entry", "detail")

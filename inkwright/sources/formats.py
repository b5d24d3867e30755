"""What a file is, and what can be told about scanned pages before they are parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Font name prefixes of mathematical fonts, thresholds.
MATH_FONTS = ("cmmi", "cmsy", "cmex", "msam", "msbm", "stmary", "esint", "mtmi", "mtsy")
FONT_PAGES, SCAN_PAGES, SCAN_CHARS = 10, 5, 50


def source_kind(path: Column, is_zip: Column) -> Column:
    """epub, html or pdf by suffix; anything else, or an epub that is no zip, is the error E001."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when((suffix == "epub") & is_zip, "epub").when(suffix.isin("html", "htm", "xhtml"), "html").when(suffix == "pdf", "pdf").otherwise("E001")


def is_math_font(name: Column) -> Column:
    return F.lower(name).rlike("^(?:" + "|".join(MATH_FONTS) + ")")


def has_math_fonts(fonts: DataFrame, doc: str = "doc_id", page: str = "page", name: str = "font") -> DataFrame:
    return fonts.filter(F.col(page) < FONT_PAGES).groupBy(doc).agg(F.bool_or(is_math_font(F.col(name))).alias("math_fonts"))


def scanned_vote(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """sampled, sparse, scanned: more than half of the first pages have hardly any text. page counts from 0."""
    few = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", "")) < SCAN_CHARS
    got = pages.filter(F.col(page) < SCAN_PAGES).groupBy(doc).agg(F.count("*").alias("sampled"), F.count_if(few).alias("sparse"))
    return got.withColumn("scanned", F.col("sparse") > F.floor(F.col("sampled") / 2))


def column_layout(boxes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """left, right, layout from blocks x0, x1 on pages of page_width: double if over 0.3 of the
    blocks off the middle are on the right."""
    centre, middle = (F.col("x0") + F.col("x1")) / 2, F.col("page_width") / 2
    got = boxes.groupBy(doc).agg(F.count_if(centre < middle * 0.9).alias("left"), F.count_if(centre > middle * 1.1).alias("right"))
    share = F.col("right") / F.nullif(F.col("left") + F.col("right"), F.lit(0))
    return got.withColumn("layout", F.when(F.coalesce(share, F.lit(0.0)) > 0.3, "double").otherwise("single"))


def pdf_kind(scanned: Column, math_fonts: Column) -> Column:
    """visual for scans, latex_pdf where mathematical fonts are, else visual; also where nothing is known."""
    return F.when(F.coalesce(scanned, F.lit(True)), "visual_pdf").when(math_fonts, "latex_pdf").otherwise("visual_pdf")


def pdf_error(encrypted: Column, pages: Column) -> Column:
    return F.when(encrypted, "E002").when(pages == 0, "E003")


def crop_box(x0: Column, y0: Column, x1: Column, y1: Column, sx: Column, sy: Column, width: Column, height: Column, pad: int = 4) -> Column:
    """Pixel box of a region given in points, padded and clamped to the page; null under 2 pixels."""
    box = F.struct(F.greatest(F.lit(0), F.floor(x0 * sx) - pad).alias("x0"), F.greatest(F.lit(0), F.floor(y0 * sy) - pad).alias("y0"), F.least(width, F.floor(x1 * sx) + pad).alias("x1"), F.least(height, F.floor(y1 * sy) + pad).alias("y1"))
    return F.when((box["x1"] - box["x0"] >= 2) & (box["y1"] - box["y0"] >= 2), box)


def memory_ladder(total: Column, free: Column, rungs: tuple[float, ...] = (0.70, 0.55), reserve: float = 0.5) -> Column:
    """The first share of a device's memory that fits into what is free less a reserve (GiB); null if none does."""
    return F.coalesce(*[F.when(F.lit(r) * total <= free - reserve, F.lit(r)) for r in rungs])

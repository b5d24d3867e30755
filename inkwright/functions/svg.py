"""Inline SVG: sizes, colours, ids, dangling references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import replace_all, rewrite_all, strip

# Spellings of black, definitions and references of glyphs.
BLACK = ('fill="black"', 'fill="#000000"', 'fill="#000"', 'stroke="black"', 'stroke="#000000"', 'stroke="#000"')
DEFINED = r"<path\s+id=[\"']([^\"']+)[\"']"
USED = r"(?:xlink:)?href=[\"']#([^\"']+)[\"']"
ROOT = r"(?s)<svg\b[^>]*>"


def strip_font_size(x: Column) -> Column:
    return rewrite_all(x, [(r"font-size\s*:\s*[\d.]+px\s*;?", ""), (r"\bfont-size=\"[\d.]+(?:px)?\"\s*", "")])


def em_dimensions(x: Column, body_pt: float = 12.0) -> Column:
    """Width and height of the root in em, a viewBox where there is none, a fixed style."""
    root = F.regexp_extract(x, ROOT, 0)

    def points(name: str) -> Column:
        raw = F.regexp_replace(F.regexp_extract(root, rf"\s{name}=[\"']([^\"']*)[\"']", 1), "[^0-9.]", "")
        return F.coalesce(raw.try_cast("double"), F.lit(0.0))

    w, h = points("width"), points("height")
    em = lambda v: F.concat(F.bround(v / body_pt, 4).cast("string"), F.lit("em"))
    bare = rewrite_all(root, [(r"\s(?:width|height|style)=(?:\"[^\"]*\"|'[^']*')", "")])
    box = F.when(~root.rlike(r"\sviewBox=") & (w > 0) & (h > 0), F.concat(F.lit(' viewBox="0 0 '), w.cast("string"), F.lit(" "), h.cast("string"), F.lit('"'))).otherwise("")
    end = F.when(bare.endswith("/>"), "/>").otherwise(">")
    new = F.concat(F.regexp_replace(bare, r"\s*/?>$", ""), F.lit(' width="'), em(w), F.lit('" height="'), em(h), F.lit('"'), box, F.lit(' style="vertical-align: middle;"'), end)
    at = F.instr(x, root)
    return F.when(root == "", x).otherwise(F.concat(F.left(x, at - 1), new, F.substring(x, at + F.length(root), F.length(x))))


def current_color(x: Column) -> Column:
    return replace_all(x, [(b, b.split("=")[0] + '="currentColor"') for b in BLACK])


def clean(x: Column) -> Column:
    """Without XML declaration and xlink names."""
    x = replace_all(F.regexp_replace(x, r"<\?xml[^?]*\?>", ""), [(f"xlink:{a}=", f"{a}=") for a in ("href", "show", "type")])
    return strip(F.regexp_replace(x, r"\s+xmlns:xlink=[\"'][^\"']*[\"']", ""))


def namespace_ids(x: Column, prefix: Column) -> Column:
    """Ids declared here and references to them with the prefix; other references stay."""
    ids = F.array_distinct(F.regexp_extract_all(x, F.lit(r"\bid=\"([^\"]+)\""), F.lit(1)))

    def rename(s: Column, i: Column) -> Column:
        new = F.concat(prefix, F.lit("__"), i)
        for attr in ('id="', 'href="#'):
            s = F.replace(s, F.concat(F.lit(attr), i, F.lit('"')), F.concat(F.lit(attr), new, F.lit('"')))
        return s

    return F.aggregate(ids, x, rename)


def orphans(x: Column) -> Column:
    """References that no path in the same image defines, sorted."""
    return F.array_sort(F.array_except(F.regexp_extract_all(x, F.lit(USED), F.lit(1)), F.regexp_extract_all(x, F.lit(DEFINED), F.lit(1))))


def count(x: Column) -> Column:
    return F.size(F.split(x, "<svg")) - 1


def postprocess(x: Column, prefix: Column, body_pt: float = 12.0) -> Column:
    return namespace_ids(clean(current_color(em_dimensions(strip_font_size(x), body_pt))), prefix)

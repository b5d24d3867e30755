"""Escaping, links, placeholders, delimiters, pipe tables, numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import count_of, let, replace_all, strip

# Patterns and formats.
DELIMITED = r"(?s)\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|\$([^$\n]+?)\$"
CELL_DELIMITED = r"(?s)\\\[(.+?)\\\]|\\\((.+?)\\\)|\$\$(.+?)\$\$|\$(.+?)\$"
PLACEHOLDER = r"\[\[EQ:([A-Za-z0-9_]+)\]\]"
URL = r"(?i)(?<![\w@.])(?:https?://[^\s<>\"]+|www\.[^\s<>\"]+|doi:\s*10\.\d{4,}/[^\s<>\"]+|10\.\d{4,}/[^\s<>\"]+)"
#: What may be peeled off the end of an address.
URL_TAIL = r"[.,;:!?'\")\]}]*\z"
URL_SAFE = r"^[A-Za-z0-9\-._~:/?#@!$&'()*+,;=%]+$"
ALLOWED_TABLE_TAGS = ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup", "col", "a", "b", "br", "code", "em", "i", "p", "span", "strong", "sub", "sup")
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def escape(x: Column) -> Column:
    return replace_all(x, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


def escape_alt(x: Column) -> Column:
    """For alt attributes: a greater-than sign becomes its full-width form."""
    return escape(F.replace(x, F.lit(">"), F.lit("\uff1e")))


def unescape(x: Column) -> Column:
    return replace_all(x, ENTITIES)


def delimiters(x: Column) -> Column:
    """Formulas in delimiters, as written, left to right."""
    return F.regexp_extract_all(x, F.lit(DELIMITED), F.lit(0))


def is_display(span: Column) -> Column:
    return span.startswith("$$") | span.startswith("\\[")


def inside(span: Column) -> Column:
    """A formula without its delimiters."""
    wide = span.startswith("$$") | span.startswith("\\")
    return strip(F.when(wide, F.substring(span, F.lit(3), F.length(span) - 4)).otherwise(F.substring(span, F.lit(2), F.length(span) - 2)))


def placeholder(region: Column) -> Column:
    return F.concat(F.lit("[[EQ:"), region, F.lit("]]"))


def trim_url(url: Column) -> Column:
    """Without sentence marks and unpaired closers at the end, peeled in turn until neither is left.

    A turn that peels takes one at least, so there are as many turns as marks and closers at the end."""

    def peel(u: Column, _: Column) -> Column:
        last = F.right(u, F.lit(1))
        spare = F.lit(False)
        for a, b in ("()", "[]", "{}"):
            spare |= (last == b) & (count_of(u, b) > count_of(u, a))
        return F.when(last.isin(*".,;:!?'\""), F.regexp_replace(u, r"[.,;:!?'\"]+$", "")).when(spare, F.left(u, F.length(u) - 1)).otherwise(u)

    return let(url, lambda u: F.aggregate(F.sequence(F.lit(0), F.length(F.regexp_extract(u, URL_TAIL, 0))), u, peel))


def link(match: Column) -> Column:
    """The markup for one match of URL in escaped text; what the address does not include follows it."""
    doi = F.lit("https://doi.org/")

    def target(url: Column) -> Column:
        low = F.lower(url)
        return F.when(low.rlike("^https?://"), url).when(low.startswith("www."), F.concat(F.lit("http://"), url)).when(low.startswith("doi:"), F.concat(doi, strip(F.substring(url, F.lit(5), F.length(url))))).otherwise(F.concat(doi, url))

    def shown(match: Column, url: Column, href: Column) -> Column:
        fine = (url != "") & F.replace(href, F.lit("&amp;"), F.lit("&")).rlike(URL_SAFE)
        rest = F.substring(match, F.length(url) + 1, F.length(match))
        return F.when(fine, F.concat(F.lit('<a href="'), href, F.lit('">'), url, F.lit("</a>"), rest)).otherwise(match)

    cut = lambda m: F.regexp_extract(m, r"(?s)^(.*?)(?:&lt;|&gt;|&quot;|$)", 1)
    return let(match, lambda m: let(trim_url(cut(m)), lambda url: let(target(url), lambda href: shown(m, url, href))))


def linkify(escaped: Column) -> Column:
    """Bare addresses and DOIs as links; no text is lost. Each text is searched once, each address cut once."""

    def joined(p: Column) -> Column:
        return F.array_join(F.transform(p["gaps"], lambda g, i: F.concat(g, F.coalesce(link(F.get(p["found"], i)), F.lit("")))), "")

    cut = lambda x: F.struct(F.regexp_extract_all(x, F.lit(URL), F.lit(0)).alias("found"), F.split(x, URL).alias("gaps"))
    return let(escaped, lambda x: F.when(x.rlike(URL), let(cut(x), joined)).otherwise(x))


def _table_lines(x: Column) -> Column:
    return F.filter(F.split(strip(x), r"\r\n|\r|\n"), lambda s: strip(s) != "")


def _are_pipe_table(lines: Column) -> Column:
    rule = F.get(lines, F.lit(1))
    return (F.size(lines) >= 3) & F.forall(lines, lambda s: s.rlike(r"(?U)^\s*\|(.+)\|\s*$")) & rule.rlike(r"(?U)^[\s|:-]+$") & rule.contains("-")


def is_pipe_table(x: Column) -> Column:
    return let(_table_lines(x), _are_pipe_table)


def pipe_table_html(x: Column) -> Column:
    """A table for a pipe table, rows padded to the widest; null for anything else."""
    cells = lambda s: F.transform(F.split(F.regexp_extract(s, r"(?U)^\s*\|(.+)\|\s*$", 1), r"\|"), strip)
    read = lambda lines: F.struct(cells(F.get(lines, F.lit(0))).alias("head"), F.transform(F.slice(lines, F.lit(3), F.size(lines)), cells).alias("body"))
    widest = lambda t: F.array_max(F.transform(F.concat(F.array(t["head"]), t["body"]), F.size))

    def row(c: Column, tag: str, width: Column) -> Column:
        padded = F.concat(c, F.array_repeat(F.lit(""), width - F.size(c)))
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(padded, lambda v: F.concat(F.lit(f"<{tag}>"), v, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    def table(t: Column, width: Column) -> Column:
        return F.concat(F.lit("<table>"), row(t["head"], "th", width), F.array_join(F.transform(t["body"], lambda c: row(c, "td", width)), ""), F.lit("</table>"))

    return let(_table_lines(x), lambda lines: F.when(_are_pipe_table(lines), let(read(lines), lambda t: let(widest(t), lambda width: table(t, width)))))


def unknown_table_tags(x: Column) -> Column:
    """Tags in a table's markup that readers may not accept."""
    used = F.transform(F.regexp_extract_all(x, F.lit(r"</?([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), F.lower)
    return F.array_sort(F.array_except(used, F.array(*map(F.lit, ALLOWED_TABLE_TAGS))))


def number_span(number: Column) -> Column:
    return F.when(F.coalesce(number, F.lit("")) == "", "").otherwise(F.concat(F.lit('<span class="eq-number">'), escape(number), F.lit("</span>")))


def marker_id(note: Column) -> Column:
    return F.concat(F.lit("fnref_"), F.when(note.startswith("fn_"), F.substring(note, F.lit(4), F.length(note))).otherwise(note))


def footnote_html(note: Column, inner: Column, back_link: Column) -> Column:
    back = F.when(back_link & note.isNotNull(), F.concat(F.lit(' <a class="footnote-back" href="#'), marker_id(note), F.lit('">↩</a>'))).otherwise("")
    return F.concat(F.lit('<p class="footnote"'), F.coalesce(F.concat(F.lit(' id="'), note, F.lit('"')), F.lit("")), F.lit(">"), inner, back, F.lit("</p>"))


def noteref_html(note: Column, inner: Column) -> Column:
    span = F.concat(F.lit('<span class="eq-text">'), inner, F.lit("</span>"))
    return F.when(note.isNull(), span).otherwise(F.concat(F.lit('<a class="noteref" id="'), marker_id(note), F.lit('" href="#'), note, F.lit('">'), span, F.lit("</a>")))


def progress(line: Column) -> Column:
    """done and total of a log line such as 3/10; null without one."""
    p = r"(\d+)\s*/\s*(\d+)"
    return F.when(line.rlike(p), F.struct(F.regexp_extract(line, p, 1).cast("long").alias("done"), F.regexp_extract(line, p, 2).cast("long").alias("total")))


def check_timeout(size_bytes: Column) -> Column:
    """Seconds that checking a book of this size may take."""
    return (F.lit(120) + F.floor(size_bytes / 1048576 * 12)).cast("long")

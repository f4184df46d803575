"""Text columns: markdown words and plain text, white space, caps, csv cells, links. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, which the reference's field splitting uses.
SPACE = r"(?U)\s+"
# Fixed patterns of markdown.
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
LINK = r"\[([^\]]*)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"
NOISE = r"[#*_`>~\-|\[\]()!]+"


def collapse(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def fields(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def markdown_words(text: Column) -> Column:
    """Words of markdown: images count nothing, links their text, fence lines nothing, marks nothing."""
    plain = F.regexp_replace(F.regexp_replace(text, IMAGE, ""), LINK, "$1")
    lines = F.filter(F.split(plain, "\n"), lambda line: ~F.ltrim(line).startswith("```"))
    counts = F.transform(lines, lambda line: F.size(fields(F.regexp_replace(line, NOISE, " "))))
    return F.aggregate(counts, F.lit(0), lambda a, x: a + x)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<[^>]+>", " ")


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def plain_text(markdown: Column) -> Column:
    """Markdown without its marks: fences go, images and links leave their text, three blank lines become one."""
    steps = (
        (r"`{3}[^`]*`{3}", ""), (IMAGE, "$1"), (LINK, "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"(^|[\s(])\*([^*\n]+)\*([\s).,;:!?]|$)", "$1$2$3"), (r"`([^`\n]+)`", "$1"),
        (r"(?m)^#{1,6}\s+", ""), (r"(?m)^[ \t]*>[ \t]?", ""), (r"[ \t]+", " "), (r"(?m)^[ \t]+", ""), (r"\n{3,}", "\n\n"),
    )
    out = markdown
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(F.regexp_replace(out, r"^\s+|\s+\z", ""))


def cap_words(text: Column, n: int) -> Column:
    """The first n words, joined by one space, if there are more; else the text as it is."""
    words = fields(text)
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(text)


def cap_sentences(text: Column, n: int) -> Column:
    """Up to the nth . ! or ?, or all if there are fewer."""
    found = F.regexp_extract(text, rf"^((?:[^.!?]*[.!?]){{{n}}})", 1)
    return F.when(found != "", F.trim(found)).otherwise(F.trim(text))


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def csv_cell(cell: Column) -> Column:
    """Cells that a spreadsheet would take for a formula get a quote in front, unless they are numbers."""
    formula = cell.rlike(r"^[=+\-@\t\r]") & cell.try_cast("double").isNull()
    return F.when(formula, F.concat(F.lit("'"), cell)).otherwise(cell)


def css_identifier(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_\-]", "")


def is_numeric_text(text: Column) -> Column:
    return text.rlike(r"^[$€£]?-?\d[\d,.]*%?$")


def markdown_links(markdown: Column) -> Column:
    """Distinct (text, url) of links in order; anchors within the page and images are left out."""
    whole = F.regexp_extract_all(F.regexp_replace(markdown, IMAGE, ""), F.lit(LINK), F.lit(0))
    pairs = F.transform(whole, lambda m: F.struct(F.regexp_extract(m, LINK, 1).alias("text"), F.regexp_extract(m, LINK, 2).alias("url")))
    kept = F.filter(pairs, lambda p: ~p["url"].startswith("#"))
    return F.array_distinct(F.transform(kept, lambda p: F.struct(F.when(F.trim(p["text"]) == "", p["url"]).otherwise(p["text"]).alias("text"), p["url"].alias("url"))))


def hex_colors(css: Column) -> Column:
    """Sorted distinct hex colours, in lower case."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(css, F.lit(r"(#(?:[0-9a-fA-F]{6}|[0-9a-fA-F]{3}))\b"), F.lit(1)), F.lower)))


def title(html: Column) -> Column:
    """The first title's text, trimmed; null if there is none. The five basic references are decoded."""
    return F.nullif(F.trim(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def unescape(raw: Column) -> Column:
    """The five basic character references, decoded."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(name), F.lit(sign))
    return raw


def html_lang(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\slang=\"([^\"]*)\"", 1), F.lit(""))


def is_short_line(line: Column) -> Column:
    """A line like a logo or a menu entry: short, without punctuation, and no markdown block."""
    t = F.trim(line)
    return (t != "") & (F.octet_length(t) < 40) & ~t.rlike(r"[.!?|:]") & ~t.rlike(r"^(#|\||- |>)")


def redact_proxy(url: Column) -> Column:
    """host:port of a proxy URL, without its login."""
    return F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"^[^@/]*@|/.*$", "")

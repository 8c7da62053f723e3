"""Text as columns. All functions take and return ``Column`` and stay inside generated code, but for ``unescape``."""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.strip`` and ``\s`` see it; Java's ``\s`` alone misses most of these.
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


normalize_label = collapse


def depth(raw: Column) -> Column:
    """Half the number of leading spaces."""
    raw = F.coalesce(raw, F.lit(""))
    return F.floor((F.length(raw) - F.length(F.ltrim(raw))) / 2).cast("int")


def leading_spaces(raw: Column) -> Column:
    raw = F.coalesce(raw, F.lit(""))
    return F.substring(raw, F.lit(1), F.length(raw) - F.length(F.ltrim(raw)))


def escape_html(c: Column, quotes: bool = False) -> Column:
    """``&``, ``<`` and ``>``; with ``quotes`` also both quotation marks."""
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(c, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quotes else c


def unescape(c: Column) -> Column:
    """Character references decoded; the table of names needs Python, in Arrow batches."""

    @F.pandas_udf("string")
    def decode(s):  # noqa: ANN001
        return s.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)

    return decode(c)


def normalize_edit(c: Column, decode: bool = True) -> Column:
    """Text of an edited element: references decoded (a second time, by contract), no-break spaces and blank runs to one space, blank lines dropped, stripped."""
    c = unescape(c) if decode else c
    c = F.regexp_replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), r"[ \t\r\f\x0b]+", " ")
    return strip(F.regexp_replace(c, r"\n{2,}", "\n"))


def strip_markup(c: Column) -> Column:
    """``<br>`` to a line break; tags dropped if both angle brackets occur; no-break spaces to spaces."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.when(F.contains(c, F.lit("<")) & F.contains(c, F.lit(">")), F.regexp_replace(c, r"<[^>]+>", "")).otherwise(c)
    return F.replace(c, F.lit("\u00a0"), F.lit(" "))


def normalize_patch(c: Column) -> Column:
    """A proposed text: markup dropped, references decoded, stripped."""
    return strip(F.replace(unescape(strip_markup(c)), F.lit("\u00a0"), F.lit(" ")))


def safe_name(c: Column, default: str, extension: str = "") -> Column:
    """Runs of other than ``[0-9A-Za-z._-]`` to ``_``, none at the ends; a default for nothing; the extension, if it is missing."""
    name = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9A-Za-z._-]+", "_"), r"^_+|_+$", "")
    name = F.when(name == "", F.lit(default)).otherwise(name)
    return F.when(F.endswith(F.lower(name), F.lit(extension.lower())), name).otherwise(F.concat(name, F.lit(extension))) if extension else name


def name_from_url(url: Column, default: str, extension: str) -> Column:
    """The safe last part of a URL's path."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return safe_name(F.element_at(F.split(path, "/"), -1), default, extension)


def stamped_name(prefix: str, name: Column, at: Column) -> Column:
    """``prefix-name_YYYYmmdd_HHMMSS``, the time in the session's zone."""
    return F.concat(F.lit(f"{prefix}-"), name, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))


#: Form of a picture request inside a text: an optional prompt, caption and ratio, parted by bars.
MARKER = r"\[IMAGE(?::([^\]]+))?\]"


def markers(c: Column) -> Column:
    """Picture requests in a text, as array<struct<prompt, caption, ratio>>."""

    def parse(body: Column) -> Column:
        parts = F.transform(F.split(body, r"\|"), strip)
        at = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
        return F.struct(at(0).alias("prompt"), at(1).alias("caption"), at(2).alias("ratio"))

    return F.transform(F.regexp_extract_all(c, F.lit(MARKER), F.lit(1)), lambda b: parse(strip(b)))


def without_markers(c: Column) -> Column:
    """The text without picture requests; white space runs of two or more to one space; stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, MARKER, ""), f"{SPACE}{{2,}}", " "))


def checkbox(old: Column, new: Column) -> Column:
    """For an empty box in the old text: the old text with ticks, unless the new one has a bracket itself."""
    box = F.contains(F.coalesce(old, F.lit("")), F.lit("[  ]"))
    return F.when(box & ~F.contains(new, F.lit("[")), F.replace(old, F.lit("[  ]"), F.lit("[✓]"))).otherwise(new)


def starts_with_digit(c: Column) -> Column:
    """Python's ``isdigit`` of the first character: decimal digits and superscripts."""
    return F.rlike(c, F.lit(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]"))


def style_summary(name: Column, char: Column, para: Column) -> Column:
    """``S:style=…,size=…,bold,italic,color=…,align=…`` without the parts that are missing; empty if all are."""
    some = lambda c: c.isNotNull() & (c != "")
    at = lambda m, k: F.element_at(m, F.lit(k))
    part = lambda label, c: F.when(some(c), F.concat(F.lit(label), c))
    parts = F.concat_ws(",", part("style=", name), part("size=", at(char, "height")), F.when(some(at(char, "bold")), F.lit("bold")), F.when(some(at(char, "italic")), F.lit("italic")), part("color=", at(char, "textColor")), part("align=", at(para, "align_horizontal")))
    return F.when(parts == "", F.lit("")).otherwise(F.concat(F.lit("S:"), parts))

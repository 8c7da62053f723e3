"""Lengths, colours and style maps as columns. Lengths are numbers here; ``px`` makes their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Document units in a millimetre and in an inch; the value from which a length counts as unset (fixed values).
UNITS_PER_MM, UNITS_PER_INCH, UNSET = 283.465, 7200, 4294967295


def to_mm(units: Column) -> Column:
    """Whole millimetres, halves to even; 0 for nothing or less."""
    return F.when(units > 0, F.bround(units / F.lit(UNITS_PER_MM), 0)).otherwise(F.lit(0)).cast("int")


def units_to_px(value: Column) -> Column:
    """Pixels at 96 an inch; null for what is no number or unset."""
    number = value.cast("string").try_cast("double")
    return F.when(number < UNSET, number / UNITS_PER_INCH * 96)


def mm_to_px(value: Column) -> Column:
    """Pixels of a text such as ``0.12 mm``."""
    return F.replace(value, F.lit(" mm"), F.lit("")).try_cast("double") / 25.4 * 96


def _bound(value: Column, of) -> Column:
    """``of(value)``, where ``value`` is worked out and planned once however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def decimals(number: Column, places: int) -> Column:
    """A double as text with decimals, rounded as C's printf does: by its exact binary value, ties to even.

    A double times a power of two is exact, so its digits are those of a whole number; the rest is whole-number arithmetic.
    """
    tens = F.lit(10**places).cast(f"decimal({places + 1},0)")

    def parts(x: Column) -> Column:
        size = F.abs(x)
        small = size < 1024
        whole = F.when(small, size * float(1 << 52)).otherwise(size * float(1 << 42)).cast("long").cast("decimal(19,0)") * tens
        unit = F.when(small, F.lit(1 << 52)).otherwise(F.lit(1 << 42)).cast("decimal(16,0)")
        return F.struct(whole.alias("whole"), unit.alias("unit"), (x < 0).alias("negative"))

    def text(s: Column) -> Column:
        rest = s["whole"] % s["unit"]
        low = ((s["whole"] - rest) / s["unit"]).cast("decimal(20,0)")
        up = (rest * 2 > s["unit"]) | ((rest * 2 == s["unit"]) & (low % 2 == 1))
        units = F.when(up, low + 1).otherwise(low).cast("decimal(20,0)")
        digits = (units / tens).cast(f"decimal({20 + places},{places})").cast("string")
        return F.when(s["negative"] & (units > 0), F.concat(F.lit("-"), digits)).otherwise(digits)

    return _bound(_bound(number, parts), text)


def two_decimals(number: Column) -> Column:
    return decimals(number, 2)


def px(number: Column) -> Column:
    """``12.34px``."""
    return F.concat(two_decimals(number), F.lit("px"))


def color(value: Column, swap: bool = False) -> Column:
    """``#AARRGGBB`` to ``#RRGGBB``; with ``swap`` the first and third byte of a 7-character colour change places."""
    six = F.when((F.length(value) == 9) & F.startswith(value, F.lit("#")), F.concat(F.lit("#"), F.substring(value, 4, 6))).otherwise(F.nullif(value, F.lit("")))
    if not swap:
        return six
    swapped = F.concat(F.lit("#"), F.substring(six, 6, 2), F.substring(six, 4, 2), F.substring(six, 2, 2))
    return F.when((F.length(six) == 7) & F.startswith(six, F.lit("#")), swapped).otherwise(six)


def visible_fill(value: Column) -> Column:
    """A fill colour, but null for white."""
    c = color(value, swap=True)
    return F.when(~F.lower(c).isin("#ffffff", "#ffffffff"), c)


def css(styles: Column) -> Column:
    """map or array of entries to ``key:value; …``, without keys that have no value. Entries keep their order."""
    entries = F.filter(styles, lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "; ")


def css_quote(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))


def points(height: Column) -> Column:
    """Hundredths of a point as ``10pt`` or ``10.5pt``; null for other than digits."""
    size = F.regexp_replace(F.regexp_replace((height.try_cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(F.rlike(height, F.lit(r"^[0-9]+$")), F.concat(size, F.lit("pt")))


def edge(kind: Column, width: Column, colour: Column) -> Column:
    """CSS of one border edge; NONE and nothing give ``none``."""
    line = F.when(kind == "DASHED", F.lit("dashed")).when(kind == "DOTTED", F.lit("dotted")).otherwise(F.lit("solid"))
    return F.when(kind.isNull() | (kind == "NONE"), F.lit("none")).otherwise(F.concat_ws(" ", F.coalesce(width, F.lit("1px")), line, F.coalesce(colour, F.lit("#000"))))


def padding_top_bottom(value: Column) -> Column:
    """struct<top, bottom> in pixels of a CSS shorthand of one to four lengths."""
    parts = F.transform(F.split(F.trim(value), r"\s+"), lambda p: F.coalesce(F.replace(p, F.lit("px"), F.lit("")).try_cast("double"), F.lit(0.0)))
    top, third = F.get(parts, F.lit(0)), F.get(parts, F.lit(2))
    return F.struct(F.coalesce(top, F.lit(0.0)).alias("top"), F.coalesce(third, top, F.lit(0.0)).alias("bottom"))


def table_scale(available: Column, bottom: Column) -> Column:
    """Factor that fits a table to the page, 0.5 at least; null where it fits as it is."""
    return F.when(bottom > available, F.greatest(F.lit(0.5), available / bottom))


def box_entries(entries: Column) -> Column:
    """The entries of borders, padding and background."""
    return F.filter(entries, lambda e: F.startswith(e["key"], F.lit("border-")) | F.startswith(e["key"], F.lit("padding")) | F.startswith(e["key"], F.lit("background")))


def max_chars(width_mm: Column) -> Column:
    """How many characters a cell of this width holds: 30 if unknown, else width / 3.5, 10 to 40."""
    return F.when(F.coalesce(width_mm, F.lit(0)) <= 0, F.lit(30)).otherwise(F.greatest(F.lit(10), F.least(F.lit(40), F.bround(width_mm / 3.5, 0).cast("int"))))

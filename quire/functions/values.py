"""Dates, measures, colors and merges of style values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

#: Fixed values of the style model.
FONT_COMPRESSION = 160.0
SIGNIFICANT = 6
#: CSS units to points.
POINTS = {"pt": 1.0, "px": 0.75, "pc": 12.0, "in": 72.0, "cm": 72 / 2.54, "mm": 72 / 25.4}
#: Basic color names.
COLORS = {"black": "000000", "white": "ffffff", "red": "ff0000", "green": "008000", "blue": "0000ff", "yellow": "ffff00", "gray": "808080", "silver": "c0c0c0", "maroon": "800000", "purple": "800080", "fuchsia": "ff00ff", "lime": "00ff00", "olive": "808000", "navy": "000080", "teal": "008080", "aqua": "00ffff"}


def metadata_date(text: Column) -> Column:
    """YYYY, YYYY-MM, YYYY-MM-DD or DD.MM.YYYY as an ISO date of that precision, null else."""
    s = F.regexp_replace(text, f"\\A{WS}+|{WS}+\\z", "")
    iso = F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z") & F.try_to_date(s, "yyyy-MM-dd").isNotNull(), s)
    dotted = F.when(s.rlike("^[0-9]{2}[.][0-9]{2}[.][0-9]{4}\\z"), F.date_format(F.try_to_date(s, "dd.MM.yyyy"), "yyyy-MM-dd"))
    return (
        F.when(s.rlike("^[0-9]{4}\\z"), s)
        .when(s.rlike("^[0-9]{4}-(0[1-9]|1[0-2])\\z"), s)
        .when(F.length(s) == 10, F.coalesce(iso, dotted))
    )


def book_date(machine: Column, display: Column, year: Column) -> Column:
    """struct(value, error): the title's date, if any, decides alone; else the year of publication."""
    title = F.coalesce(F.date_format(machine, "yyyy-MM-dd"), F.nullif(F.trim(display), F.lit("")))
    chosen = F.coalesce(title, F.nullif(F.trim(year), F.lit("")))
    value = metadata_date(chosen)
    return F.struct(value.alias("value"), F.when(chosen.isNotNull() & value.isNull(), F.concat(F.lit("invalid date: "), chosen)).alias("error"))


def round_significant(v: Column, digits: int = SIGNIFICANT) -> Column:
    """v with so many significant digits, halves away from 0."""
    m = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(v))))
    scaled = v * m
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / m)


def percent_to_rem(percent: Column) -> Column:
    """Font size; what exceeds 100 % is compressed."""
    return round_significant(F.when(percent > 100, 1 + (percent - 100) / FONT_COMPRESSION).otherwise(percent / 100))


def font_multiplier(value: Column, unit: Column) -> Column:
    """Font size against the parent's: rem expanded again, em as it is, 1 for other units."""
    rem = F.when(value > 1, (value - 1) * FONT_COMPRESSION / 100 + 1).otherwise(value)
    return F.when(F.coalesce(value, F.lit(0.0)) == 0, 1.0).when(unit == "rem", rem).when(unit == "em", value).otherwise(1.0)


def length_points(value: Column, unit: Column, font_size: Column) -> Column:
    """A CSS length in points; null for an unknown unit."""
    out = F.when(unit.isin("em", "rem"), value * font_size).when(unit == "%", value * font_size / 100).when(unit == "ex", value * font_size / 2)
    for u, p in POINTS.items():
        out = out.when(unit == u, value * p)
    return out


def collapsed_margin(a: Column, b: Column) -> Column:
    """Two margins that meet: the larger of two positive ones, the smaller of two negative ones, else their sum."""
    return F.when((a >= 0) & (b >= 0), F.greatest(a, b)).when((a <= 0) & (b <= 0), F.least(a, b)).otherwise(a + b)


def section_size_version(positions: Column) -> Column:
    """1 up to 65536 positions, then one more for each 16384 begun, 256 at most."""
    return F.when(positions <= 65536, 1).otherwise(F.least(F.floor((positions - 65536) / 16384).cast("long") + 2, F.lit(256))).cast("long")


def color(text: Column) -> Column:
    """struct(r, g, b) of #rgb, #rrggbb, rgb(r, g, b) or a basic color name; null else."""
    s = F.lower(F.trim(text))
    named = None
    for n, h in COLORS.items():
        named = F.when(s == n, h) if named is None else named.when(s == n, h)
    h = F.when(s.rlike("^#[0-9a-f]{6}$"), F.substring(s, 2, 6)).when(s.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(F.substring(s, 2, 3), "(.)", "$1$1")).otherwise(named)
    hexes = F.struct(*(F.conv(F.substring(h, i, 2), 16, 10).cast("int").alias(c) for i, c in ((1, "r"), (3, "g"), (5, "b"))))
    call = r"^rgb\(\s*([0-9]{1,3})\s*,\s*([0-9]{1,3})\s*,\s*([0-9]{1,3})\s*\)$"
    calls = F.struct(*(F.regexp_extract(s, call, i).cast("int").alias(c) for i, c in ((1, "r"), (2, "g"), (3, "b"))))
    return F.when(h.isNotNull(), hexes).when(s.rlike(call), calls)


def ordered_union(a: Column, b: Column) -> Column:
    """Distinct values of both lists in order of appearance."""
    return F.array_union(F.coalesce(a, b), F.coalesce(b, a))


def overlay(a: Column, b: Column) -> Column:
    """A map with b's entries over a's."""
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)


def signature(m: Column) -> Column:
    """A map as a string that is equal for equal maps."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def date_text(machine: Column, display: Column) -> Column:
    """The date as a form would show it: the machine's, else the display text; empty without both."""
    return F.coalesce(F.date_format(machine, "yyyy-MM-dd"), F.trim(display), F.lit(""))


#: CSS units and the style model's.
MODEL_UNITS = {"em": "em", "ex": "em", "%": "percent", "px": "px", "pt": "pt", "cm": "cm", "mm": "mm", "in": "in", "rem": "rem", "lh": "lh", "": "lh"}


def model_unit(unit: Column) -> Column:
    """The style model's unit of a CSS unit, null for an unknown one."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MODEL_UNITS.items() for x in kv)), unit)


def page_points(width: Column, height: Column, dpi: Column) -> Column:
    """struct(width, height, error): a screen of pixels in points."""
    error = None
    for name, c in (("width", width), ("height", height), ("dpi", dpi)):
        message = F.concat(F.lit(f"invalid {name}: "), c.cast("string"))
        error = F.when(c <= 0, message) if error is None else error.when(c <= 0, message)
    size = lambda c: F.when(error.isNull(), c * 72.0 / dpi)
    return F.struct(size(width).alias("width"), size(height).alias("height"), error.alias("error"))


def jpeg_density(dpi: Column, default: int = 300) -> Column:
    """Density in a picture's header: 15 bits, the default for none."""
    return F.when(dpi <= 0, default).otherwise(F.least(dpi, F.lit(32767))).cast("int")


#: A style value: a measure (value and unit), a plain number (value), a word, or a list of words.
STYLE_VALUE = "struct<value:double,unit:string,word:string,list:array<string>>"


def measure(value: Column, unit: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), unit.alias("unit"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("array<string>").alias("list"))


def word(text: Column) -> Column:
    return F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), text.alias("word"), F.lit(None).cast("array<string>").alias("list"))


def _present(old: Column, new: Column, merged: Column) -> Column:
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(merged)


def merge_override(old: Column, new: Column) -> Column:
    """The new value."""
    return F.coalesce(new, old)


def merge_cumulative(old: Column, new: Column) -> Column:
    """Lists become one, each entry once; measures of one unit and plain numbers add up; else the new value."""
    items = lambda v: F.coalesce(v["list"], F.array().cast("array<string>"))
    lists = F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("word"), F.array_union(items(old), items(new)).alias("list"))
    numbers = old["value"].isNotNull() & new["value"].isNotNull() & old["unit"].eqNullSafe(new["unit"])
    return _present(old, new, F.when((F.size(items(old)) > 0) | (F.size(items(new)) > 0), lists).when(numbers, measure(old["value"] + new["value"], new["unit"])).otherwise(new))


def merge_relative(old: Column, new: Column) -> Column:
    """A new measure in percent or em scales the old measure, whose unit stays; else the new value."""
    both = old["value"].isNotNull() & new["value"].isNotNull() & old["unit"].isNotNull() & new["unit"].isNotNull()
    scaled = F.when(new["unit"] == "percent", measure(old["value"] * new["value"] / 100, old["unit"])).when(new["unit"] == "em", measure(old["value"] * new["value"], old["unit"]))
    return _present(old, new, F.when(both & new["unit"].isin("percent", "em"), scaled).otherwise(new))


def merge_maximum(old: Column, new: Column) -> Column:
    """Of two measures of one unit, or two plain numbers, the greater, the new one of equals; else the new value."""
    comparable = old["value"].isNotNull() & new["value"].isNotNull() & old["unit"].eqNullSafe(new["unit"])
    return _present(old, new, F.when(comparable & (old["value"] > new["value"]), old).otherwise(new))


def merge_baseline(old: Column, new: Column) -> Column:
    """The new value, unless it is normal and the old one isn't."""
    return _present(old, new, F.when((new["word"] == "normal") & ~old["word"].eqNullSafe(F.lit("normal")), old).otherwise(new))


def merge_horizontal(old: Column, new: Column) -> Column:
    """Two different words become `both`."""
    words = old["word"].isNotNull() & new["word"].isNotNull()
    return _present(old, new, F.when(words & (old["word"] != new["word"]), word(F.lit("both"))).otherwise(new))


def merge_repeat(old: Column, new: Column) -> Column:
    """Of two background repeats the one that repeats more, the old one of equals."""
    rank = lambda v: F.when(v["word"] == "repeat", 3).when(v["word"].isin("repeat_x", "repeat_y"), 2).when(v["word"] == "no_repeat", 1).when(v["word"].isNotNull(), 0).otherwise(-1)
    return _present(old, new, F.when(rank(old) >= rank(new), old).otherwise(new))


MERGES = {"override": merge_override, "cumulative": merge_cumulative, "relative": merge_relative, "override-maximum": merge_maximum, "baseline-style": merge_baseline, "horizontal-position": merge_horizontal, "background-repeat": merge_repeat}


def merged_value(rule: Column, old: Column, new: Column) -> Column:
    """What the named rule makes of two values; an unknown rule overrides."""
    out = None
    for name, merge in MERGES.items():
        out = F.when(rule == name, merge(old, new)) if out is None else out.when(rule == name, merge(old, new))
    return out.otherwise(merge_override(old, new))


#: Words of a border's line.
BORDER_LINES = ("solid", "dashed", "dotted", "double", "groove", "ridge", "inset", "outset", "none", "hidden")


def border_parts(value: Column) -> Column:
    """struct(line, color, width) of a border: of several parts of a kind the last one counts."""
    parts = F.filter(F.split(F.lower(F.trim(value)), "[ \t\r\n]+"), lambda x: x != "")
    last = lambda test: F.try_element_at(F.filter(parts, test), F.lit(-1))
    is_line, is_color = (lambda x: x.isin(*BORDER_LINES)), (lambda x: color(x).isNotNull())
    is_width = lambda x: ~is_line(x) & ~is_color(x) & x.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)[a-z%]*$") & ~x.rlike("^[+-]?0*[.]?0*$")
    return F.struct(last(is_line).alias("line"), last(is_color).alias("color"), last(is_width).alias("width"))


def box_sides(value: Column) -> Column:
    """struct(top, right, bottom, left) of a margin or padding of one to four parts."""
    p = F.filter(F.split(F.trim(value), "[ \t\r\n]+"), lambda x: x != "")
    at = lambda *order: F.coalesce(*(F.try_element_at(p, F.lit(i)) for i in order))
    return F.struct(at(1).alias("top"), at(2, 1).alias("right"), at(3, 1).alias("bottom"), at(4, 2, 1).alias("left"))


def auto_margins(sides: Column, align: Column) -> Column:
    """struct(top, right, bottom, left, align): automatic margins above and below are none, at the sides they align the box unless something else does."""
    left, right = sides["left"] == "auto", sides["right"] == "auto"
    none = lambda c: F.when(c == "auto", "0em").otherwise(c)
    gone = lambda c: F.when(c != "auto", c)
    box = F.coalesce(align, F.when(left & right, "center").when(left, "right").when(right, "left"))
    return F.struct(none(sides["top"]).alias("top"), gone(sides["right"]).alias("right"), none(sides["bottom"]).alias("bottom"), gone(sides["left"]).alias("left"), box.alias("align"))

"""Text functions. All are Column expressions, so they stay in generated code and can be pushed through plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .language import LETTERS

#: Unicode white space, for Java's regular expressions (whose \s is ASCII only).
WS = r"[\t-\r \x85\xA0  -     　]"
NOT_WS = "[^" + WS[1:]
#: The same without the no-break spaces.
WS_BREAKING = r"[\t-\r \x85  -    　]"

#: Schemes of external links.
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "mailto:")


def _set(symbols: str) -> str:
    return "[" + "".join("\\" + c if not c.isalnum() else c for c in symbols) + "]"


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(text, WS + "+", " ")


def surrounding_whitespace(text: Column) -> Column:
    """struct(leading, core, trailing)."""
    lead = F.regexp_extract(text, f"^({WS}*)", 1)
    core = F.regexp_replace(text, f"^{WS}+|{WS}+$", "")
    trail = F.when(core == "", F.lit("")).otherwise(F.regexp_extract(text, f"({WS}*)$", 1))
    return F.struct(lead.alias("leading"), core.alias("core"), trail.alias("trailing"))


def split_words(text: Column, ignore_nbsp: bool = False) -> Column:
    """Words between single white-space characters; empty ones stay, and "" gives one empty word."""
    return F.split(text, WS_BREAKING if ignore_nbsp else WS, -1)


def speech(text: Column, symbols: str, to: str) -> Column:
    """A leading symbol with the white space after it becomes `to`, if anything else follows."""
    return F.regexp_replace(text, f"^{_set(symbols)}{WS}*(?={NOT_WS})", _literal(to))


def dashes(text: Column, symbols: str, to: str) -> Column:
    """A symbol with white space on both sides becomes `to`."""
    return F.regexp_replace(text, f"(?<={WS}){_set(symbols)}(?={WS})", _literal(to))


def dialogue(text: Column, symbols: str, to: str) -> Column:
    """White space before a symbol, or none, becomes `to`; other runs keep their last character.

    The first character of a text is never such a symbol; a text of one white space becomes empty.
    """
    single = F.regexp_replace(text, f"{WS}(?={WS})", "")
    marked = F.regexp_replace(single, f"(?<!^){WS}?(?<!^)({_set(symbols)})|^{WS}({_set(symbols)})", f"{_literal(to)}$1$2")
    return F.when(text.rlike(f"\\A{WS}\\z"), "").otherwise(marked)


def escape_markdown(text: Column) -> Column:
    """Backslashes before Markdown's inline characters, and before a list or heading mark at the start."""
    return F.regexp_replace(F.regexp_replace(text, r"([\\`*_\[\]<>])", r"\\$1"), r"^([#\-+=])", r"\\$1")


def escape_url(url: Column) -> Column:
    """Spaces and parentheses of a Markdown link target."""
    return F.replace(F.replace(F.replace(url, F.lit(" "), F.lit("%20")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def escape_link_text(text: Column) -> Column:
    """Text of a Markdown link that is rendered already."""
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def escape_cell(text: Column) -> Column:
    """Text in a Markdown table cell."""
    return F.replace(F.replace(text, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))


def escape_attribute(text: Column) -> Column:
    """Text in an HTML attribute."""
    out = text
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return out


def longest_backticks(text: Column) -> Column:
    """Length of the longest run of backticks."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def code_span(text: Column) -> Column:
    """Inline code: a fence longer than any run inside, padded where the text touches it."""
    fence = F.repeat(F.lit("`"), longest_backticks(text) + 1)
    pad = F.when(F.startswith(text, F.lit("`")) | F.endswith(text, F.lit("`")), F.lit(" ")).otherwise("")
    return F.concat(fence, pad, text, pad, fence)


def code_block(text: Column) -> Column:
    """Fenced code: three backticks at least."""
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_backticks(text) + 1))
    return F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence)


def prefix_lines(text: Column, prefix: str) -> Column:
    """The prefix before each line."""
    return F.concat(F.lit(prefix), F.replace(text, F.lit("\n"), F.lit("\n" + prefix)))


def path_segment(text: Column) -> Column:
    """Letters, digits, hyphen, underscore and period stay; the rest become underscores, trimmed with periods at the ends."""
    return F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}_.\-]", "_"), F.lit("._"))


def anchor(id: Column) -> Column:
    """An id as an anchor: trimmed, without a leading #, escaped."""
    return escape_attribute(F.regexp_replace(F.regexp_replace(id, f"^{WS}+|{WS}+$", ""), "^#", ""))


def link_class(href: Column) -> Column:
    """internal (#id), empty, external (a known scheme with anything after it) or broken."""
    low = F.lower(href)
    external = None
    for s in SCHEMES:
        this = low.startswith(s) & (F.length(href) > len(s))
        external = this if external is None else external | this
    return F.when(F.coalesce(href, F.lit("")) == "", "empty").when(F.startswith(href, F.lit("#")), "internal").when(external, "external").otherwise("broken")


def broken_link_text(target: Column, text: Column, kind: Column) -> Column:
    """What takes the place of a link that leads nowhere: its text and a remark."""
    remark = F.when(kind == "empty", F.lit("[empty link]")).when(kind == "broken", F.concat(F.lit("[broken external link: "), target, F.lit("]"))).otherwise(F.concat(F.lit("[broken link: #"), target, F.lit("]")))
    return F.when(F.coalesce(text, F.lit("")) == "", remark).otherwise(F.concat_ws(" ", text, remark))


def isbn(text: Column) -> Column:
    """struct(value, kind) of a valid ISBN-10 or ISBN-13, null else. Hyphens and spaces go, x becomes X."""
    s = F.upper(F.regexp_replace(text, "[- ]", ""))
    digit = lambda i: F.when(F.substring(s, i, 1) == "X", F.lit(10)).otherwise(F.try_to_number(F.substring(s, i, 1), F.lit("9")).cast("int"))
    ten = sum((digit(i) * (11 - i) for i in range(1, 11)), F.lit(0)) % 11 == 0
    thirteen = sum((digit(i) * (1 if i % 2 else 3) for i in range(1, 14)), F.lit(0)) % 10 == 0
    kind = F.when(s.rlike("^[0-9]{9}[0-9X]$") & ten, "ISBN-10").when(s.rlike("^[0-9]{13}$") & thirteen, "ISBN-13")
    return F.when(kind.isNotNull(), F.struct(s.alias("value"), kind.alias("kind")))


def asin(text: Column) -> Column:
    """A product number of ten letters and digits, upper case; null if it isn't one."""
    s = F.upper(F.regexp_replace(text, f"{WS}+", ""))
    return F.when(s.rlike("^[0-9A-Z]{10}$"), s)


def person_name(first: Column, middle: Column, last: Column, nickname: Column) -> Column:
    """Name parts with single spaces, or the nickname."""
    part = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(F.nullif(F.concat_ws(" ", part(first), part(middle), part(last)), F.lit("")), nickname)


def html_text(html: Column) -> Column:
    """Readable text: scripts, styles and link texts go, then tags; the five basic entities are decoded, white space collapses."""
    t = F.regexp_replace(html, r"(?s)<(script|style|a)\b[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for e, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(e), F.lit(c))
    return F.trim(F.regexp_replace(t, "[ \t\r\n]+", " "))


def ascii_letters(text: Column) -> Column:
    """Lower-case letters with their transliteration, the rest as it is."""
    one = {k: v for k, v in LETTERS.items() if len(v) == 1}
    out = F.translate(text, "".join([*one, *(k for k, v in LETTERS.items() if not v)]), "".join(one.values()))
    for k, v in LETTERS.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def slug(text: Column) -> Column:
    """Lower case, transliterated, anything but letters, digits, hyphens and underscores as hyphens, none at the ends or in a row."""
    s = ascii_letters(F.lower(F.trim(text)))
    s = F.regexp_replace(F.replace(F.replace(s, F.lit("&"), F.lit("and")), F.lit("@"), F.lit("at")), "['\u2019\"]", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9_-]", "-"), "-+", "-")
    return F.regexp_replace(s, "^[-_]+|[-_]+$", "")


def quoted(text: Column) -> Column:
    """A double-quoted scalar: backslashes, quotes and control characters escaped."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\n", "n"), ("\t", "t"), ("\r", "r"), ("\x0b", "v"), ("\x0c", "f"), ("\x08", "b"), ("\x07", "a")):
        out = F.replace(out, F.lit(c), F.lit("\\" + e))
    for n in (*range(7), *range(14, 32), 127):
        out = F.replace(out, F.lit(chr(n)), F.lit(f"\\x{n:02x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def series_text(series: Column) -> Column:
    """`name #number` of an array of struct(name, number), with commas; blank names are left out."""
    named = F.filter(series, lambda x: F.trim(F.coalesce(x["name"], F.lit(""))) != "")
    return F.array_join(F.transform(named, lambda x: F.concat(F.trim(x["name"]), F.when(x["number"].isNotNull(), F.concat(F.lit(" #"), x["number"].cast("string"))).otherwise(""))), ", ")


def joined_title(pieces: Column) -> Column:
    """Pieces of a title, with ". " between, or a space after one that ends in a period."""
    used = F.filter(pieces, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    step = lambda out, x: F.when(out == "", x).otherwise(F.concat(out, F.when(F.endswith(out, F.lit(".")), F.lit(" ")).otherwise(". "), x))
    return F.aggregate(used, F.lit("").cast("string"), step)


def toc_title(pieces: Column, alts: Column, fallback: Column) -> Column:
    """The pieces of a title, else the alternative texts of its pictures, else the fallback."""
    none = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(none(joined_title(pieces)), none(F.trim(F.array_join(F.filter(alts, lambda x: F.coalesce(x, F.lit("")) != ""), " "))), fallback)


def title_or_none(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("[No Title]"))


def id_title(id: Column) -> Column:
    """What stands for the title of something that has only an id."""
    return F.concat(F.lit("~ "), id, F.lit(" ~"))


def resource_filename(url: Column) -> Column:
    """The last part of a path without a leading #, ".." and slash; empty if there is none."""
    s = F.regexp_replace(F.replace(F.regexp_replace(url, "^#", ""), F.lit("..")), "^/", "")
    base = F.regexp_extract(F.regexp_replace(s, "/+$", ""), "([^/]*)$", 1)
    return F.when(F.trim(s).isin("", "."), "").when(base == "", F.when(s.rlike("^/+$"), "/").otherwise("")).otherwise(base)


#: MIME types of fonts and pictures, and their endings.
FONT_ENDINGS = {"font/woff": ".woff", "font/woff2": ".woff2", "font/ttf": ".ttf", "application/x-font-ttf": ".ttf", "application/font-sfnt": ".ttf", "font/otf": ".otf", "application/x-font-otf": ".otf", "application/font-woff": ".woff", "application/font-woff2": ".woff2", "image/svg+xml": ".svg", "application/vnd.ms-fontobject": ".eot"}
ENDING_TYPES = {".woff": "font/woff", ".woff2": "font/woff2", ".ttf": "font/ttf", ".otf": "font/otf", ".eot": "application/vnd.ms-fontobject", ".svg": "image/svg+xml"}
IMAGE_ENDINGS = {"image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/svg+xml": "svg", "image/webp": "webp", "image/bmp": "bmp", "image/tiff": "tiff"}


def _looked_up(key: Column, table: dict[str, str], default: str = "") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def resource_ending(mime: Column) -> Column:
    """The file ending of a style sheet's resource; empty if its type isn't known."""
    return _looked_up(mime, FONT_ENDINGS)


def ending_type(ending: Column) -> Column:
    """The MIME type of a file ending, whatever its case."""
    return _looked_up(F.lower(ending), ENDING_TYPES)


def image_ending(mime: Column) -> Column:
    """The ending of a picture's file, by its type."""
    return _looked_up(F.lower(mime), IMAGE_ENDINGS, "img")


def is_image_type(mime: Column) -> Column:
    return F.startswith(mime, F.lit("image/"))


def is_font_type(mime: Column) -> Column:
    return F.startswith(mime, F.lit("font/")) | F.startswith(mime, F.lit("application/font-")) | F.startswith(mime, F.lit("application/x-font-")) | (mime == "application/vnd.ms-fontobject")


#: The alphabet of hashed names.
NAME_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def hashed_name(text: Column, length: int) -> Column:
    """`length` letters and digits from the bytes of the text's SHA-256, used again from the first after the last; null for an empty text."""
    h = F.sha2(text, 256)
    letter = lambda i: F.substring(F.lit(NAME_ALPHABET), F.conv(F.substring(h, 2 * (i % 32) + 1, 2), 16, 10).cast("int") % len(NAME_ALPHABET) + 1, 1)
    return F.when(text != "", F.concat(*(letter(i) for i in range(length))))


_URL = r"""url\s*\(\s*(?:["']([^"']*)["']|([^)"]*))\s*\)"""


def css_urls(value: Column) -> Column:
    """Trimmed addresses of url() in a style value, in order, each once."""
    both = F.arrays_zip(F.regexp_extract_all(value, F.lit(_URL), 1).alias("a"), F.regexp_extract_all(value, F.lit(_URL), 2).alias("b"))
    found = F.transform(both, lambda x: F.trim(F.when(x.a != "", x.a).otherwise(x.b)))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def rewritten_urls(value: Column, change) -> Column:
    """A style value with every url() replaced by what `change` (Column to Column) makes of its address, in double quotes."""
    begins = F.regexp_extract_all(value, F.lit(f"(?s)(.*?){_URL}"), 1)
    quoted_, plain = (F.regexp_extract_all(value, F.lit(_URL), i) for i in (1, 2))
    rest = F.regexp_replace(value, f"(?s)^.*{_URL}", "")
    made = F.zip_with(begins, F.zip_with(quoted_, plain, lambda a, b: F.trim(F.when(a != "", a).otherwise(b))), lambda x, u: F.concat(x, F.lit('url("'), F.replace(F.replace(change(u), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('")')))
    return F.when(F.size(begins) == 0, value).otherwise(F.concat(F.array_join(made, ""), rest))


def clean_file_name(name: Column) -> Column:
    """A name without separators and NUL, and without periods at its start; a fixed name if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(name, r"[\x00/:]", ""), r"^[.]+", "")
    return F.when(out == "", "_bad_file_name_").otherwise(out)


def output_path(folder: Column, name: Column, ending: str, slugs: bool = False) -> Column:
    """folder/name.ending; slashes in the name make folders, and each part is cleaned."""
    parts = F.filter(F.split(name, "/"), lambda x: x != "")
    clean = (lambda x: clean_file_name(slug(x))) if slugs else clean_file_name
    path = F.array_join(F.transform(parts, clean), "/")
    return F.when(F.size(parts) == 0, folder).otherwise(F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), path, F.lit(ending)))


def default_file_name(source: Column, ending: str, slugs: bool = False) -> Column:
    """The source's name with another ending."""
    base = F.regexp_replace(F.regexp_extract(source, "([^/]*)$", 1), r"[.][^.]*$", "")
    return F.concat(clean_file_name(slug(base) if slugs else base), F.lit(ending))


def image_label(href: Column, filename: Column) -> Column:
    """The file of a picture, else the id that refers to it."""
    id = F.regexp_replace(F.trim(href), "^#", "")
    return F.when(id == "", "").otherwise(F.coalesce(F.nullif(F.trim(filename), F.lit("")), id))


def _once(values: Column) -> Column:
    """Values in order, each once whatever its case."""
    keys = F.transform(values, F.lower)
    return F.filter(values, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def keywords(text: Column) -> Column:
    """Trimmed parts between commas and semicolons, each once whatever its case; blank ones are left out."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda x: F.regexp_replace(x, f"^{WS}+|{WS}+$", ""))
    return _once(F.filter(parts, lambda x: x != ""))


def subjects(genres: Column, words: Column) -> Column:
    """Genres, then keywords: array of struct(value, kind), each value once whatever its case."""
    trimmed = F.filter(F.transform(F.coalesce(genres, F.array().cast("array<string>")), F.trim), lambda x: x != "")
    all_ = F.concat(trimmed, keywords(words))
    n = F.size(_once(trimmed))
    return F.transform(_once(all_), lambda x, i: F.struct(x.alias("value"), F.when(i < n, "genre").otherwise("keyword").alias("kind")))


def is_upper(text: Column) -> Column:
    """Whether a text has letters, and all are capitals."""
    return text.rlike(r"\p{L}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]")

"""Books in FictionBook XML, single or in zip archives, as tables of nodes, metadata and binaries.

Files come through Spark's `binaryFile` source, so any file system will do and a folder is listed
once. Each book is parsed in a task by itself; one that fails gives a row with `error` and no other
row is lost. Mixed text and elements keep their order, which is why a parser in Python is used.

Nodes carry pre-order numbers: a subtree is `seq BETWEEN x.seq AND x.last_seq`.
"""

from __future__ import annotations

import base64
import datetime
import html.entities
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = (
    "book_id string, seq long, parent_seq long, last_seq long, depth int, body_no int, body_kind string, kind string, ord int, xml_id string, lang string, "
    "style string, href string, alt string, ref_type string, align string, row int, col int, colspan int, rowspan int, header boolean, text string, error string"
)
_FIELD, _PERSON = "struct<text:string,lang:string>", "struct<name:string,first:string,middle:string,last:string,nickname:string,home_pages:array<string>,emails:array<string>,id:string>"
BOOKS = (
    "book_id string, title string, authors array<string>, genres array<string>, keywords string, lang string, date_value string, date_display string, "
    "publisher string, year string, isbn string, series array<struct<name:string,number:string,parent:int>>, id string, "
    f"people array<{_PERSON}>, translators array<{_PERSON}>, annotation string, cover array<string>, src_lang string, date date, title_field {_FIELD}, "
    "book_name string, city string, published_series array<struct<name:string,number:string,parent:int>>, document_authors array<string>, program string, document_date string, source_urls array<string>, "
    "source_ocr string, version string, history string, custom array<struct<kind:string,value:string>>, stylesheets array<struct<kind:string,text:string>>, "
    "output array<struct<mode:string,include:string,price:double,currency:string>>, error string"
)
BINARIES = "book_id string, id string, mime string, data binary, error string"

#: Names of bodies that hold notes.
NOTES = ("notes", "comments", "footnotes")
#: Elements that become nodes under their own name.
KINDS = frozenset("section title subtitle epigraph annotation image p empty-line poem stanza v text-author date cite table tr th td strong emphasis style a strikethrough sub sup code".split())
DEPTH = 1024
#: Bytes at a file's beginning that tell its encoding, and rows of an archive's books that go on together.
PEEK, MOST_ROWS = 2048, 50_000
#: Elements of running text, and those that become paragraphs where they don't belong.
INLINE = frozenset("strong emphasis style a strikethrough sub sup code image".split())
TEXTUAL = frozenset("text-author date v stanza epigraph annotation".split())
#: Elements whose children are blocks, and what may stand in them beside those.
FLOWS = {"section": {"title", "epigraph", "image", "annotation"}, "cite": {"text-author"}, "epigraph": {"text-author"}, "annotation": set(), "history": set()}
BLOCK_KINDS = frozenset("p poem cite subtitle empty-line table image section".split())
#: Elements of mixed content.
MIXED = frozenset("p v subtitle text-author td th date".split()) | (INLINE - {"image"}) | {"span"}
#: Modes and directives of output instructions.
SHARING, INCLUDING = ("free", "paid"), ("require", "allow", "deny")
#: Largest decoded binary.
BINARY = 256 << 20


def safe_name(name: str) -> bool:
    """Whether an archive entry's name stays inside the archive."""
    return not (name.startswith(("/", "\\")) or re.match("^[A-Za-z]:", name) or ".." in re.split(r"[/\\]", name))


def decoded(raw: bytes) -> str:
    """Text of an XML file: by byte order mark (UTF-32 before UTF-16), else as UTF-8 if it is that, else as declared."""
    for mark, name in ((b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name)
    declared = re.match(rb'\s*<\?xml[^>]*encoding=["\']([A-Za-z0-9_.\-]+)', raw)
    name = declared[1].decode().lower() if declared else "utf-8"
    if name in ("utf-8", "utf8"):
        return raw.decode("utf-8", "replace")
    # a declaration of another encoding doesn't count if the beginning is UTF-8 with more than ASCII
    peek = complete(raw[:PEEK])
    try:
        peek.decode("utf-8")
        is_utf8 = any(b > 127 for b in peek)
    except UnicodeDecodeError:
        is_utf8 = False
    return raw.decode("utf-8" if is_utf8 else name, "replace")


def complete(raw: bytes) -> bytes:
    """raw without a UTF-8 character that is cut at its end."""
    for k in range(1, min(4, len(raw)) + 1):
        b = raw[-k]
        if b >= 0xC0:
            return raw[:-k] if k < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else raw
        if b < 0x80:
            return raw
    return raw


def root_of(raw: bytes) -> ET.Element:
    """The parsed root; HTML's named entities are accepted."""
    text = re.sub(r"^\s*<\?xml[^>]*\?>", "", decoded(raw))
    text = re.sub(r"&([A-Za-z][A-Za-z0-9]*);", lambda m: m[0] if m[1] in ("amp", "lt", "gt", "quot", "apos") else html.entities.html5.get(m[1] + ";", m[0]), text)
    root = ET.fromstring(text)
    if local(root) != "FictionBook":
        raise ValueError(f"the root is {local(root)}")
    return root


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def child(e: ET.Element | None, *names: str) -> ET.Element | None:
    for n in names:
        e = next((c for c in e if local(c) == n), None) if e is not None else None
    return e


def text_of(e: ET.Element | None) -> str | None:
    return (re.sub(r"\s+", " ", "".join(e.itertext())).strip() or None) if e is not None else None


def number(text: str | None, default: int = 1) -> int:
    return int(text) if text and text.isdigit() else default


def node_rows(book: str, raw: bytes, notes: tuple[str, ...] = NOTES) -> list[dict]:
    """Rows of all bodies in pre-order. The first body is main whatever its name."""
    out: list[dict] = []

    def add(kind: str, parent: dict | None, **more) -> dict:
        row = {"book_id": book, "seq": len(out), "parent_seq": parent["seq"] if parent else None, "depth": parent["depth"] + 1 if parent else 0, "body_no": more.pop("body_no", parent and parent["body_no"]), "body_kind": more.pop("body_kind", parent and parent["body_kind"]), "kind": kind} | more
        if row["depth"] > DEPTH:
            raise ValueError("nested too deeply")
        out.append(row)
        return row

    def node(c: ET.Element, kind: str, parent: dict, at: int, **extra) -> dict:
        style = attribute(c, "style") or attribute(c, "name")
        more = {"xml_id": attribute(c, "id"), "lang": attribute(c, "lang"), "style": style, "href": attribute(c, "href"), "alt": attribute(c, "alt"), "ref_type": attribute(c, "type"), "align": attribute(c, "align")}
        return add(kind, parent, ord=at, **more | extra)

    def mixed(e: ET.Element, parent: dict, at: int = 0) -> None:
        """Text and elements of running text in order; an element that doesn't belong there keeps its text, as a span."""
        if e.text:
            add("text", parent, ord=at, text=e.text)
            at += 1
        for c in e:
            if isinstance(c.tag, str):
                at = inline(c, parent, at)
            if c.tail:
                add("text", parent, ord=at, text=c.tail)
                at += 1

    def inline(c: ET.Element, parent: dict, at: int) -> int:
        row = node(c, local(c) if local(c) in INLINE else "span", parent, at)
        if local(c) != "image":
            mixed(c, row)
        row["last_seq"] = len(out) - 1
        return at + 1

    def pieces(e: ET.Element, parent: dict, at: int) -> int:
        """A paragraph with blocks inside: a paragraph for each stretch of running text, the blocks between. The first one has its id and style."""
        held: list = []
        named, begun = False, at

        def flush() -> None:
            nonlocal held, named, at
            if any(not isinstance(x, str) or x.strip() for x in held):
                row = node(e, "p", parent, at) if not named else add("p", parent, ord=at)
                named, at, k = True, at + 1, 0
                for x in held:
                    if isinstance(x, str):
                        add("text", row, ord=k, text=x)
                        k += 1
                    else:
                        k = inline(x, row, k)
                row["last_seq"] = len(out) - 1
            held = []

        held += [e.text] if e.text else []
        for c in (c for c in e if isinstance(c.tag, str)):
            if local(c) in INLINE:
                held.append(c)
            else:
                flush()
                at = block(c, parent, at)
            held += [c.tail] if c.tail else []
        flush()
        if at == begun:
            row = node(e, "p", parent, at)
            mixed(e, row)
            row["last_seq"], at = len(out) - 1, at + 1
        return at

    def block(c: ET.Element, parent: dict, at: int) -> int:
        """A block of a flow; known elements of text become paragraphs where they don't belong, others are left out."""
        kind = local(c)
        if kind == "p" and any(isinstance(x.tag, str) and local(x) not in INLINE for x in c):
            return pieces(c, parent, at)
        if kind not in BLOCK_KINDS:
            if kind not in TEXTUAL:
                return at
            row = node(c, "p", parent, at, style=f"unexpected {kind}" + (f" {attribute(c, 'style')}" if attribute(c, "style") else ""))
            if text := "".join(c.itertext()):
                add("text", row, ord=0, text=text)
        else:
            row = node(c, kind, parent, at)
            walk(c, row)
        row["last_seq"] = len(out) - 1
        return at + 1

    def walk(e: ET.Element, parent: dict) -> None:
        kind, at, n = local(e), 0, 0
        if kind in MIXED:
            mixed(e, parent)
            return
        for c in (c for c in e if isinstance(c.tag, str)):
            name = local(c)
            if kind in FLOWS and name not in FLOWS[kind]:
                at = block(c, parent, at)
            elif name in KINDS:
                extra = {"row": n} if name == "tr" else {"row": parent.get("row"), "col": n, "colspan": number(attribute(c, "colspan")), "rowspan": number(attribute(c, "rowspan")), "header": name == "th"} if name in ("td", "th") else {}
                row = node(c, name, parent, at, **extra)
                at, n = at + 1, n + 1
                walk(c, row)
                row["last_seq"] = len(out) - 1

    bodies = [e for e in root_of(raw) if local(e) == "body"]
    for i, body in enumerate(bodies):
        name = attribute(body, "name")
        kind = "main" if i == 0 else "notes" if (name or "").lower() in notes else "other"
        row = add("body", None, ord=i, body_no=i, body_kind=kind, xml_id=attribute(body, "id"), lang=attribute(body, "lang"), style=name)
        walk(body, row)
        row["last_seq"] = len(out) - 1
    for row in out:
        row.setdefault("last_seq", row["seq"])
    return out


def book_rows(book: str, raw: bytes) -> list[dict]:
    """One row of metadata. The last title-info counts; blank is null."""
    desc = child(root_of(raw), "description")
    info = next((c for c in reversed(desc if desc is not None else []) if local(c) == "title-info"), None)
    info = ET.Element("none") if info is None else info
    pub, doc, date = child(desc, "publish-info"), child(desc, "document-info"), child(info, "date")
    named = lambda e, name: [c for c in (e if e is not None else []) if isinstance(c.tag, str) and local(c) == name]

    def person(a: ET.Element) -> dict:
        parts = {k: text_of(child(a, f"{k}-name")) for k in ("first", "middle", "last")}
        every = lambda name: [t for c in named(a, name) if (t := text_of(c))]
        nickname = text_of(child(a, "nickname"))
        return parts | {"name": " ".join(p for p in parts.values() if p) or nickname, "nickname": nickname, "home_pages": every("home-page"), "emails": every("email"), "id": text_of(child(a, "id"))}

    def sequences(e: ET.Element | None) -> list[dict]:
        out: list[dict] = []

        def add(e: ET.Element | None, parent: int | None) -> None:
            for c in named(e, "sequence"):
                if name := (attribute(c, "name") or "").strip():
                    out.append({"name": name, "number": attribute(c, "number"), "parent": parent})
                    add(c, len(out) - 1)

        add(e, None)
        return out

    def output(e: ET.Element) -> dict:
        mode, include, price = attribute(e, "mode"), attribute(e, "include-all"), attribute(e, "price")
        if mode not in SHARING or include not in INCLUDING:
            raise ValueError(f"output instruction {mode}, {include}")
        return {"mode": mode, "include": include, "price": float(price) if price else None, "currency": attribute(e, "currency")}

    people = [person(a) for a in named(info, "author")]
    cover = child(info, "coverpage")
    title = child(info, "book-title")
    root = root_of(raw)
    return [
        {
            "book_id": book,
            "title": text_of(title),
            "title_field": {"text": text_of(title), "lang": attribute(title, "lang")} if title is not None else None,
            "authors": [p["name"] for p in people if p["name"]],
            "people": people,
            "translators": [person(a) for a in named(info, "translator")],
            "genres": [t for c in named(info, "genre") if (t := text_of(c))],
            "keywords": text_of(child(info, "keywords")),
            "annotation": text_of(child(info, "annotation")),
            "cover": [h.removeprefix("#") for c in (cover if cover is not None else []) if (h := attribute(c, "href"))],
            "lang": text_of(child(info, "lang")),
            "src_lang": text_of(child(info, "src-lang")),
            "date_value": attribute(date, "value") if date is not None else None,
            "date": iso_date(attribute(date, "value")) if date is not None else None,
            "date_display": text_of(date),
            "publisher": text_of(child(pub, "publisher")),
            "book_name": text_of(child(pub, "book-name")),
            "city": text_of(child(pub, "city")),
            "year": text_of(child(pub, "year")),
            "isbn": text_of(child(pub, "isbn")),
            "published_series": sequences(pub),
            "series": sequences(info),
            "id": text_of(child(doc, "id")),
            "document_authors": [p for a in named(doc, "author") if (p := person(a)["name"])],
            "program": text_of(child(doc, "program-used")),
            "document_date": text_of(child(doc, "date")),
            "source_urls": [t for c in named(doc, "src-url") if (t := text_of(c))],
            "source_ocr": text_of(child(doc, "src-ocr")),
            "version": text_of(child(doc, "version")),
            "history": text_of(child(doc, "history")),
            "custom": [{"kind": attribute(c, "info-type"), "value": text_of(c)} for c in named(desc, "custom-info")],
            "stylesheets": [{"kind": attribute(c, "type"), "text": (c.text or "").strip()} for c in root if isinstance(c.tag, str) and local(c) == "stylesheet"],
            "output": [output(c) for c in named(desc, "output")],
        }
    ]


def iso_date(value: str | None) -> datetime.date | None:
    """The date of YYYY-MM-DD, with a zone or without one; null for anything else."""
    m = re.fullmatch(r"\s*(\d{4}-\d{2}-\d{2})(Z|[+-]\d{2}:\d{2})?\s*", value or "")
    try:
        return datetime.date.fromisoformat(m[1]) if m else None
    except ValueError:
        return None


def binary_rows(book: str, raw: bytes) -> list[dict]:
    """Embedded files. A corrupt end keeps what was decoded before it; nothing decoded is an error."""
    out = []
    for e in (e for e in root_of(raw) if local(e) == "binary"):
        text, error, data = re.sub(r"\s+", "", e.text or ""), None, None
        if len(text) * 3 // 4 > BINARY:
            error = "too large"
        else:
            good = re.match("^[A-Za-z0-9+/]*", text)[0]
            good = good[: len(good) // 4 * 4] if len(good) % 4 == 1 else good
            data = base64.b64decode(good + "=" * (-len(good) % 4)) or None
            error = None if data else "nothing decoded"
        out.append({"book_id": book, "id": attribute(e, "id"), "mime": attribute(e, "content-type"), "data": data, "error": error})
    return out


def entry_name(info: zipfile.ZipInfo, code_page: str | None) -> str:
    """An entry's name; names that aren't marked as UTF-8 are read in the code page, if one is given."""
    return info.filename.encode("cp437").decode(code_page, "replace") if code_page and not info.flag_bits & 0x800 else info.filename


def is_book(raw: bytes) -> bool:
    """Whether the first bytes look like a book: XML with its root element."""
    try:
        return "<FictionBook" in decoded(complete(raw[:8192]))
    except UnicodeDecodeError:
        return False


def entries(path: str, raw: bytes, prefix: str = "", code_page: str | None = None) -> Iterator[tuple[str, bytes]]:
    """(id, bytes) of the books in a file: itself, or the entries of a zip archive below a prefix, by name or by what they hold. An unsafe entry name is an error."""
    if raw[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for i in z.infolist():
                name = entry_name(i, code_page)
                if not safe_name(name):
                    raise ValueError(f"unsafe entry name {name}")
                if i.is_dir() or not name.startswith(prefix):
                    continue
                data = None if name.lower().endswith(".fb2") else z.read(i)
                if data is None or is_book(data):
                    yield f"{path}!{name}", z.read(i) if data is None else data
    else:
        yield path, raw


def resolved(spark: SparkSession, source: str) -> tuple[str, str]:
    """The longest part of a path that exists, and the rest, which is a prefix in an archive. A rest behind a folder is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    head, tail = source.rstrip("/"), ""
    while head:
        p = jvm.org.apache.hadoop.fs.Path(head)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            if tail and fs.getFileStatus(p).isDirectory():
                raise FileNotFoundError(source)
            return head, tail
        head, _, last = head.rpartition("/")
        tail = f"{last}/{tail}" if tail else last
    raise FileNotFoundError(source)


def single(books: DataFrame) -> DataFrame:
    """The one book of a source; none or several are an error."""
    n = books.select("book_id").distinct().limit(2).count()
    if n != 1:
        raise ValueError("the source has no book" if not n else "the source has several books")
    return books


def _parsed(files: DataFrame, parse: Callable[[str, bytes], list[dict]], schema: str, prefix: str = "", code_page: str | None = None) -> DataFrame:
    """files: path, content."""
    kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in files.sparkSession.createDataFrame([], schema).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows: list[dict] = []
                try:
                    for book, data in entries(path, raw, prefix, code_page):
                        try:
                            rows += parse(book, data)
                        except Exception as e:  # one bad book doesn't stop the others
                            rows.append({"book_id": book, "error": str(e)})
                        if len(rows) > MOST_ROWS:  # books of an archive go on one by one
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows = []
                except (ValueError, zipfile.BadZipFile) as e:
                    rows.append({"book_id": path, "error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("path", "content").mapInArrow(run, schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def files(spark: SparkSession, path: str, pattern: str = "*.{fb2,zip,FB2,ZIP}") -> DataFrame:
    """path and content of the book files below a folder, or of one file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def nodes(books: DataFrame, notes: tuple[str, ...] = NOTES, prefix: str = "", code_page: str | None = None) -> DataFrame:
    """prefix and code_page: of the entries of archives."""
    return _parsed(books, lambda b, raw: node_rows(b, raw, notes), NODES, prefix, code_page)


def metadata(books: DataFrame, prefix: str = "", code_page: str | None = None) -> DataFrame:
    return _parsed(books, book_rows, BOOKS, prefix, code_page)


def binaries(books: DataFrame, prefix: str = "", code_page: str | None = None) -> DataFrame:
    return _parsed(books, binary_rows, BINARIES, prefix, code_page)


def from_texts(df: DataFrame, id: str, text: str, title: str | None = None) -> DataFrame:
    """Book files made of texts, a paragraph for each line: path, content."""
    escaped = F.replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit("<p>"), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    head = F.concat(F.lit("<description><title-info><book-title>"), F.col(title or id).cast("string"), F.lit("</book-title></title-info></description>"))
    xml = F.concat(F.lit('<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0">'), head, F.lit("<body><section>"), body, F.lit("</section></body></FictionBook>"))
    return df.select(F.col(id).cast("string").alias("path"), F.encode(xml, "UTF-8").alias("content"))

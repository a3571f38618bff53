"""Books as plain text or Markdown, one row each, and their output paths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, collapse_whitespace, escape_markdown, isbn, keywords, path_segment, prefix_lines, quoted
from ..functions.values import book_date
from ..operators import tables, trees
from ..operators.sequences import scan
from ..plans.books import titles

#: Elements that stand in a block of their own.
BLOCKS = ("p", "v", "subtitle", "text-author", "td", "th")


def block_texts(nodes: DataFrame, links: bool = True) -> DataFrame:
    """book_id, seq, kind, level, in_title, text of each block, inline text in order; links: whether link texts count.

    An inline text belongs to the last block that began before it, so a window over pre-order
    numbers does without a join.
    """
    w = Window.partitionBy("book_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    t = nodes.where("error IS NULL")
    is_block = F.col("kind").isin(*BLOCKS)
    t = t.withColumn("__block", F.max(F.when(is_block, F.struct("seq", "kind", "depth", "last_seq"))).over(w))
    t = t.withColumn("__title", F.max(F.when(F.col("kind") == "title", F.struct("seq", "last_seq"))).over(w))
    t = t.withColumn("__link", F.max(F.when(F.col("kind") == "a", F.struct("seq", "last_seq"))).over(w))
    t = t.where((F.col("kind") == "text") & (F.col("seq") <= F.col("__block.last_seq")))
    if not links:
        t = t.where(F.col("__link").isNull() | (F.col("seq") > F.col("__link.last_seq")))
    title = F.coalesce(F.col("__block.seq") <= F.col("__title.last_seq"), F.lit(False))
    t = t.groupBy("book_id", F.col("__block.seq").alias("seq"), F.col("__block.kind").alias("kind"), F.col("__block.depth").alias("level"), title.alias("in_title"))
    t = t.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("seq").alias("s"), "text"))), lambda x: x.text), "").alias("text"))
    return t.withColumn("text", F.trim(collapse_whitespace(F.col("text")))).where("text <> ''")


def _joined(blocks: DataFrame, line: Column, separator: str) -> DataFrame:
    t = blocks.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines"))
    return t.select("book_id", F.array_join(F.transform("lines", lambda x: x.line), separator).alias("content"))


def plain_text(nodes: DataFrame) -> DataFrame:
    """book_id, content: blocks with a blank line between."""
    return _joined(block_texts(nodes), F.col("text"), "\n\n")


def markdown(nodes: DataFrame) -> DataFrame:
    """book_id, content: titles as headings by depth, text authors and subtitles set off, the rest as paragraphs."""
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.expr("level DIV 2")))
    line = F.when(F.col("in_title"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("text"))).when(F.col("kind") == "subtitle", F.concat(F.lit("**"), escape_markdown(F.col("text")), F.lit("**"))).when(F.col("kind") == "text-author", F.concat(F.lit("— "), escape_markdown(F.col("text")))).otherwise(escape_markdown(F.col("text")))
    return _joined(block_texts(nodes), line, "\n\n")


def headings(nodes: DataFrame) -> DataFrame:
    """book_id, content: titles of bodies and sections as headings, by how many sections stand around them."""
    t = titles(nodes).where("title IS NOT NULL").join(nodes.select("book_id", "seq", "depth"), ["book_id", "seq"])
    line = F.concat(F.repeat(F.lit("#"), F.least(F.col("depth") + 1, F.lit(6))), F.lit(" "), F.col("title"))
    return _joined(t.select("book_id", "seq", "title", "depth"), line, "\n\n")


def output_paths(books: DataFrame, suffix: str) -> DataFrame:
    """book_id and a path of author and title; books of one path get -1, -2, ... in order of id."""
    author, title = path_segment(F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("unknown"))), path_segment(F.coalesce("title", F.lit("untitled")))
    t = books.select("book_id", F.concat_ws("/", author, title).alias("base"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("book_id")) - 1
    return t.withColumn("n", n).select("book_id", F.concat(F.col("base"), F.when(F.col("n") > 0, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""), F.lit(suffix)).alias("path"))


def write_texts(rendered: DataFrame, path: str, buckets: int = 64) -> None:
    """One table of rendered books, in a bounded number of folders by a hash of the id."""
    t = rendered.withColumn("bucket", F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int"))
    t.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


#: Markdown's marks of running text, and tags for what it has no marks for.
MARKS = {"strong": ("**", "**"), "emphasis": ("*", "*"), "strikethrough": ("~~", "~~"), "sub": ("<sub>", "</sub>"), "sup": ("<sup>", "</sup>")}
_SPACE_RUN = re.compile(WS + "+")
_MD = re.compile(r"([\\`*_\[\]<>])")


def _code(text: str) -> str:
    fence = "`" * (max((len(m) for m in re.findall("`+", text)), default=0) + 1)
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{fence}{pad}{text}{pad}{fence}"


def marked_blocks(nodes: DataFrame, labels: DataFrame | None = None, form: str = "md") -> DataFrame:
    """book_id, seq, kind, text of each block with its inline marks, links and pictures; form: md or txt.

    labels: book_id, xml_id, label of notes: links to them show the label in brackets, those with a picture what they hold.
    Nodes stream in order past a stack of open elements, so marks nest however they do in the book.
    """
    md = form == "md"
    t = nodes.where("error IS NULL").select("book_id", "seq", "last_seq", "kind", "text", "href", "alt")
    if labels is not None:
        t = t.join(labels.select("book_id", F.concat(F.lit("#"), "xml_id").alias("href"), "label"), ["book_id", "href"], "left").select(*t.columns, "label")
    else:
        t = t.withColumn("label", F.lit(None).cast("string"))
    end = t.select("book_id").distinct().select("book_id", F.lit((1 << 63) - 1).alias("seq"), *(F.lit(None).cast(t.schema[c].dataType).alias(c) for c in ("last_seq",)), F.lit("end").alias("kind"), *(F.lit(None).cast("string").alias(c) for c in ("text", "href", "alt", "label")))

    def plain(text: str) -> str:
        text = _SPACE_RUN.sub(" ", text)
        return _MD.sub(r"\\\1", text) if md else text

    def wrapped(text: str, marks: tuple[str, str]) -> str:
        core = text.strip()
        if not core or not md:
            return text
        at = text.index(core)
        return text[:at] + marks[0] + core + marks[1] + text[at + len(core) :]

    def url(href: str) -> str:
        return href.replace(" ", "%20").replace(")", "%29").replace("(", "%28")

    def closed(e: dict) -> str:
        """The text of an element once all that it holds is there."""
        kind, text = e["kind"], "".join(e["parts"])
        if kind in MARKS:
            return wrapped(text, MARKS[kind])
        if kind == "code":
            raw = _SPACE_RUN.sub(" ", "".join(e["raw"]))
            return _code(raw) if md else raw
        if kind == "image":
            label = e["alt"] or (e["href"] or "").removeprefix("#")
            return f"![{plain(label)}]({url(e['href'] or '')})" if md else f"[{label}]" if label else ""
        if kind == "a":
            href, shown = e["href"] or "", text if text.strip() else (e["href"] or "").strip()
            if e["label"] is not None:
                label = e["label"] if e["label"].startswith("[") and e["label"].endswith("]") else f"[{e['label']}]"
                if not md:
                    return label
                shown = text.strip() if e["picture"] and text.strip() else plain(label)
                return f"[{shown.replace('|', chr(92) + '|')}]({url(href)})"
            if md and href:
                return f"[{shown.replace('|', chr(92) + '|')}]({url(href)})"
            return f"{shown} ({href})" if href and not href.startswith("#") and shown != href else shown
        return text

    def make():
        stack: list[dict] = []

        def step(seq, last, kind, text, href, alt, label):
            out = []
            while stack and stack[-1]["last"] < seq:
                e = stack.pop()
                done = closed(e)
                if e["block"]:
                    if done.strip():
                        out.append((e["seq"], e["kind"], done.strip()))
                elif stack:
                    stack[-1]["parts"].append(done)
                    stack[-1]["raw"] += e["raw"]
                    stack[-1]["picture"] |= e["picture"] or e["kind"] == "image"
            if kind == "text":
                if stack:
                    stack[-1]["parts"].append(plain(text or ""))
                    stack[-1]["raw"].append(text or "")
            elif kind != "end":
                inside = any(e["block"] for e in stack)
                block = kind in BLOCKS or (kind == "image" and not inside)
                if block or inside:
                    stack.append({"seq": seq, "last": seq if last is None else last, "kind": kind, "href": href, "alt": alt, "label": label, "parts": [], "raw": [], "block": block, "picture": False})
            return out

        return step

    t = scan(t.unionByName(end), ["book_id"], ["seq"], ["seq", "last_seq", "kind", "text", "href", "alt", "label"], make, "block long, block_kind string, block_text string")
    return t.select("book_id", F.col("block").alias("seq"), F.col("block_kind").alias("kind"), F.col("block_text").alias("text"))


def front_matter(books: DataFrame, names: Column | None = None) -> DataFrame:
    """book_id, content: a book's metadata in front of its Markdown. names: names of authors, else as in the book."""
    scalar = lambda key, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.array(F.concat(F.lit(f"{key}: "), quoted(F.trim(c)))))

    def listed(key: str, items: Column) -> Column:
        lines = F.transform(F.filter(items, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), lambda x: F.concat(F.lit("  - "), quoted(F.trim(x))))
        return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(f"{key}:")), lines))

    number = lambda s: F.when(s["number"].rlike("^-?[0-9]+$"), F.concat(F.lit("\n    number: "), s["number"])).otherwise("")
    top = F.filter("series", lambda s: s["parent"].isNull())
    series = F.when(F.size(top) > 0, F.concat(F.array(F.lit("series:")), F.transform(top, lambda s: F.concat(F.lit("  - name: "), quoted(F.trim(s["name"])), number(s)))))
    date = book_date(F.col("date"), F.col("date_display"), F.col("year"))["value"]
    number_ = isbn(F.col("isbn"))["value"]
    parts = [
        F.array(F.lit("---")), scalar("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.regexp_replace(F.regexp_extract("book_id", "([^/!]*)$", 1), "[.]fb2$", ""))), listed("authors", names if names is not None else F.col("authors")), scalar("description", F.col("annotation")), scalar("publisher", F.col("publisher")),
        listed("translators", F.transform("translators", lambda p: p["name"])), series, scalar("language", F.col("lang")), scalar("date", date), listed("genres", F.col("genres")), listed("keywords", keywords(F.col("keywords"))), scalar("isbn", number_), scalar("identifier", F.col("id")), F.array(F.lit("---")),
    ]
    none = F.array().cast("array<string>")
    return books.where("error IS NULL").select("book_id", F.array_join(F.concat(*(F.coalesce(p, none) for p in parts)), "\n").alias("content"))


def document(nodes: DataFrame, labels: DataFrame | None = None, form: str = "md") -> DataFrame:
    """book_id, content: main and other bodies with headings, quotes, verses, tables, pictures and marks.

    Titles are headings by the sections around them; what stands in a cite is quoted, the lines of a stanza
    stand together, cells make tables.
    """
    md = form == "md"
    body = nodes.where("body_kind <> 'notes' AND error IS NULL")
    around = body
    for name, kinds in (("cite", ["cite"]), ("stanza", ["stanza"]), ("table", ["table"]), ("title", ["title"])):
        around = trees.enclosing(around, ["book_id"], F.col("kind").isin(kinds), name=f"in_{name}")
    t = marked_blocks(body, labels, form).join(around.select("book_id", "seq", "depth", "row", "col", *(f"in_{n}" for n in ("cite", "stanza", "table", "title"))), ["book_id", "seq"])
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.col("depth") - 1))
    # a title's paragraphs are one heading, a stanza's verses one block
    together = F.coalesce("in_title", "in_stanza", "in_table", "seq")
    cells = t.where("in_table IS NOT NULL").select("book_id", F.col("in_table").alias("table"), "row", "col", "text")
    tables_ = (tables.piped if md else tables.aligned)(cells, ["book_id", "table"], "text").select("book_id", F.col("table").alias("seq"), F.col("content").alias("line"))
    rest = t.where("in_table IS NULL").withColumn("at", together)
    rest = rest.groupBy("book_id", "at").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("x"), F.first("kind").alias("kind"), F.min(level).alias("level"), F.max(F.col("in_title").isNotNull()).alias("heading"), F.max(F.col("in_stanza").isNotNull()).alias("verse"), F.max(F.col("in_cite").isNotNull()).alias("quote"))
    texts = F.transform("x", lambda x: x.text)
    line = F.when(F.col("verse"), F.array_join(texts, "  \n" if md else "\n")).otherwise(F.array_join(texts, " "))
    if md:
        line = F.when(F.col("heading"), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), line)).when(F.col("kind") == "text-author", F.concat(F.lit("— "), line)).otherwise(line)
        line = F.when(F.col("quote"), prefix_lines(line, "> ")).otherwise(line)
    else:
        under = F.concat(line, F.lit("\n"), F.repeat(F.lit("-"), F.length(line)))
        line = F.when(F.col("heading"), F.when(F.col("level") <= 1, F.upper(line)).otherwise(under)).when(F.col("kind") == "text-author", F.concat(F.lit("-- "), line)).otherwise(line)
        line = F.when(F.col("quote"), prefix_lines(line, "  ")).otherwise(line)
    lines = rest.select("book_id", F.col("at").alias("seq"), line.alias("line")).unionByName(tables_)
    return _joined(lines, F.col("line"), "\n\n")


def write_files(rendered: DataFrame, folder: str) -> DataFrame:
    """A file for each row (path, content): written beside its place and renamed, so none is ever half there. Returns path, error; one that fails doesn't stop the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            errors = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = f"{root}/{path}"
                part = f"{target}.{TaskContext.get().taskAttemptId()}.part"
                try:
                    if path is None or content is None:
                        raise ValueError("nothing to write")
                    fs.create_dir(target.rpartition("/")[0], recursive=True)
                    with fs.open_output_stream(part) as f:
                        f.write(content.encode())
                    fs.move(part, target)
                    errors.append(None)
                except (OSError, ValueError) as e:
                    errors.append(str(e))
                    if fs.get_file_info(part).type != pafs.FileType.NotFound:
                        fs.delete_file(part)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(errors, pa.string())], ["path", "error"])

    return rendered.select("path", "content").mapInArrow(run, "path string, error string")

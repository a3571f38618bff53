"""The order of steps that turns parsed books into repaired, numbered and paged tables.

notes -> labels -> links -> ids -> text -> dropcaps -> pages, contents, positions. Each step takes
and returns DataFrames keyed by book_id, so one shuffle by book serves the windows of all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import links, sequences, trees


def notes(nodes: DataFrame) -> DataFrame:
    """Sections of note bodies with an id, first of equal ids, with body number and position in the body.

    The position counts every section of the body; a book with one note body has body number 0.
    """
    t = nodes.where("body_kind = 'notes' AND kind = 'section'")
    w = Window.partitionBy("book_id", "body_no").orderBy("seq")
    t = t.withColumn("note_no", F.row_number().over(w)).withColumn("rank", F.dense_rank().over(Window.partitionBy("book_id").orderBy("body_no")))
    t = t.withColumn("bodies", F.max("rank").over(Window.partitionBy("book_id"))).where(F.coalesce(F.trim("xml_id"), F.lit("")) != "")
    t = sequences.best_row(t, ["book_id", "xml_id"], ["seq"])
    body = F.when(F.col("bodies") == 1, 0).otherwise(F.col("rank"))
    label = F.when(body == 0, F.col("note_no").cast("string")).otherwise(F.concat_ws(".", body.cast("string"), F.col("note_no").cast("string")))
    return t.select("book_id", "xml_id", "seq", "last_seq", body.alias("body_number"), "note_no", label.alias("label"))


def link_rows(nodes: DataFrame) -> DataFrame:
    """Links with the text inside them: book_id, seq, href, text."""
    a = nodes.where("kind = 'a'").select("book_id", "seq", "last_seq", "href")
    t = trees.subtree_text(nodes.where("kind = 'text'").select("book_id", "seq", "text"), a, ["book_id"], "").withColumnRenamed("root", "seq")
    return a.drop("last_seq").join(t, ["book_id", "seq"], "left").select("book_id", "seq", F.coalesce("href", F.lit("")).alias("href"), F.coalesce("text", F.lit("")).alias("text"))


def repaired_links(nodes: DataFrame) -> DataFrame:
    """Links, those without a target replaced by text."""
    return links.repaired(link_rows(nodes), nodes.where("xml_id IS NOT NULL").select("book_id", "xml_id"), ["book_id"])


def section_ids(nodes: DataFrame) -> DataFrame:
    """Sections of main bodies with their id, or the next free sect_N in document order."""
    t = nodes.where("kind = 'section' AND body_kind = 'main'").select("book_id", "seq", "xml_id")
    have = nodes.select("book_id", F.regexp_extract(F.coalesce("xml_id", F.lit("")), "^sect_([1-9][0-9]{0,8})$", 1).alias("n")).where("n <> ''").select("book_id", F.col("n").cast("long").alias("number"))
    new = links.unused_ids(t.where("xml_id IS NULL"), have, ["seq"], ["book_id"])
    return t.where("xml_id IS NOT NULL").select("book_id", "seq", "xml_id").union(new.select("book_id", "seq", F.concat(F.lit("sect_"), F.col("number").cast("string"))))


def transformed(nodes: DataFrame, speech: tuple[str, str] = ("«", '"'), dashes: tuple[str, str] = ("-", "—"), dialogue: tuple[str, str] = ("—", " ")) -> DataFrame:
    """Text of paragraphs that stand in sections: speech marks, dashes, dialogue, in this order; blank texts stay."""
    parents = nodes.where("kind = 'p'").select("book_id", F.col("seq").alias("p"), F.col("last_seq").alias("p_last"), F.col("parent_seq").alias("up")).join(nodes.where("kind = 'section'").select("book_id", F.col("seq").alias("up")), ["book_id", "up"], "left_semi")
    w = Window.partitionBy("book_id").orderBy("seq", "side").rowsBetween(Window.unboundedPreceding, 0)
    rows = nodes.select("*", F.lit(1).alias("side"), F.lit(None).cast("long").alias("p_last")).unionByName(parents.select("book_id", F.col("p").alias("seq"), F.lit(0).alias("side"), "p_last"), allowMissingColumns=True)
    inside = F.col("seq") <= F.last("p_last", ignorenulls=True).over(w)
    new = text.dialogue(text.dashes(text.speech(F.col("text"), *speech), *dashes), *dialogue)
    t = rows.withColumn("__in", F.coalesce(inside, F.lit(False))).where("side = 1")
    return t.withColumn("text", F.when(F.col("__in") & (F.col("kind") == "text") & (F.trim("text") != ""), new).otherwise(F.col("text"))).select(*nodes.columns)


def dropcaps(nodes: DataFrame, ignore: str = "\"'«„—-") -> DataFrame:
    """The first letter of each main section's first paragraph with plain text, unless that begins with white space or a symbol to ignore.

    Plain text is the first that stands in the paragraph itself; paragraphs without any are passed over. A
    section's own paragraphs before its first nested section count.
    """
    kids = nodes.where("body_kind = 'main' AND kind IN ('p', 'section')").select("book_id", F.col("parent_seq").alias("section"), F.col("seq").alias("kid"), "kind")
    kids = kids.join(nodes.where("kind = 'section'").select("book_id", F.col("seq").alias("section")), ["book_id", "section"], "left_semi")
    nested = kids.where("kind = 'section'").groupBy("book_id", "section").agg(F.min("kid").alias("nested"))
    p = kids.where("kind = 'p'").join(nested, ["book_id", "section"], "left").where("nested IS NULL OR kid < nested").select("book_id", "section", F.col("kid").alias("p"))
    words = nodes.where("kind = 'text' AND text <> ''").select("book_id", F.col("parent_seq").alias("p"), "seq", "text")
    t = sequences.best_row(p.join(words, ["book_id", "p"]), ["book_id", "section"], ["p", "seq"])
    bad = F.col("text").rlike("^" + text.WS) | F.array_contains(F.array(*map(F.lit, ignore)), F.substring("text", 1, 1))
    return t.where(~bad).select("book_id", "section", F.col("p").alias("seq"), F.substring("text", 1, 1).alias("dropcap"))


def contents(nodes: DataFrame, levels: int = 6, shape: str = "normal") -> DataFrame:
    """Titled sections of main bodies with level, title and the parent entry."""
    s = nodes.where("kind = 'section' AND body_kind = 'main'").select("book_id", "seq", "last_seq", F.least(F.col("depth"), F.lit(levels)).alias("level"))
    titles = nodes.where("kind = 'title'").select("book_id", F.col("seq"), "last_seq", F.col("parent_seq"))
    words = trees.subtree_text(nodes.where("kind = 'text'").select("book_id", "seq", "text"), titles, ["book_id"]).withColumnRenamed("root", "seq")
    t = s.join(titles.join(words, ["book_id", "seq"]).select("book_id", F.col("parent_seq").alias("seq"), F.col("text").alias("title")), ["book_id", "seq"])
    return trees.toc_parents(t.select("book_id", "seq", "level", "title"), "level", ["book_id"], "seq", shape)


def positions(nodes: DataFrame) -> DataFrame:
    """Position of each text in reading order, with a sentinel for each book."""
    t = nodes.where("kind = 'text'").select("book_id", "seq", F.length("text").alias("n"))
    return sequences.position_map(t, "n", ["book_id"], ["seq"])


def innermost(nodes: DataFrame, opens: Column, name: str) -> DataFrame:
    """nodes with the seq of the nearest row around each for which `opens` holds."""
    return trees.enclosing(nodes, ["book_id"], opens, name=name)


def subtree_of(nodes: DataFrame, kinds: list[str], value: str = "text", separator: str = " ") -> DataFrame:
    """Text (or another column, such as alt) in each element of some kinds: book_id, seq, text."""
    t = nodes.where(F.col(value).isNotNull()).select("book_id", "seq", F.col(value).alias("text"))
    return trees.subtree_text(t, nodes.where(F.col("kind").isin(kinds)).select("book_id", "seq", "last_seq"), ["book_id"], separator).withColumnRenamed("root", "seq")


def titles(nodes: DataFrame) -> DataFrame:
    """Titles of bodies and sections: book_id, seq (of the body or section), title, toc_title; null where there's nothing but pictures.

    toc_title joins the title's paragraphs with ". ", else the alternative texts of its pictures.
    """
    t = nodes.where("kind = 'title'").select("book_id", F.col("seq").alias("title_seq"), F.col("parent_seq").alias("seq"))
    p = subtree_of(nodes, ["p"], separator="").join(nodes.where("kind = 'p'").select("book_id", "seq", F.col("parent_seq").alias("title_seq")), ["book_id", "seq"])
    p = p.join(t.select("book_id", "title_seq"), ["book_id", "title_seq"], "left_semi")
    pieces = p.groupBy("book_id", "title_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.trim(text.collapse_whitespace(F.col("text"))).alias("t")))), lambda x: x.t).alias("pieces"))
    alts = subtree_of(nodes, ["title"], "alt").select("book_id", F.col("seq").alias("title_seq"), F.col("text").alias("alt"))
    t = t.join(pieces, ["book_id", "title_seq"], "left").join(alts, ["book_id", "title_seq"], "left")
    blank = F.coalesce("pieces", F.array().cast("array<string>"))
    whole = F.nullif(F.array_join(F.filter(blank, lambda x: x != ""), " "), F.lit(""))
    return t.select("book_id", "seq", whole.alias("title"), text.toc_title(blank, F.array("alt"), F.lit(None).cast("string")).alias("toc_title"))


def section_content(nodes: DataFrame) -> DataFrame:
    """Sections with whether they hold more than pictures and empty lines: a title, epigraph, annotation or anything of text."""
    t = innermost(nodes, F.col("kind") == "section", "section").where("section IS NOT NULL AND kind IN ('title', 'epigraph', 'annotation', 'p', 'poem', 'cite', 'subtitle', 'table')")
    direct = t.select("book_id", F.col("section").alias("seq")).distinct().withColumn("has", F.lit("x"))
    s = nodes.where("kind = 'section'").select("book_id", "seq", "last_seq", "xml_id")
    found = trees.subtree_text(direct.select("book_id", "seq", F.col("has").alias("text")), s, ["book_id"]).select("book_id", F.col("root").alias("seq"))
    return s.join(found.withColumn("nontrivial", F.lit(True)), ["book_id", "seq"], "left").select("book_id", "seq", "xml_id", F.coalesce("nontrivial", F.lit(False)).alias("nontrivial"))


#: Kinds that count as seen in a note.
VISIBLE = ("p", "subtitle", "v", "text-author", "image", "table")


def note_contents(nodes: DataFrame) -> DataFrame:
    """Sections of note bodies with an id: how many paragraphs, pictures and tables they show, and whether the first of them is a picture or table.

    What stands in a title or in a table isn't counted by itself.
    """
    t = innermost(nodes, F.col("kind").isin("title", "table"), "within")
    t = innermost(t, (F.col("kind") == "section") & F.col("xml_id").isNotNull(), "note")
    shown = t.where(F.col("kind").isin(*VISIBLE) & F.col("within").isNull() & F.col("note").isNotNull() & (F.col("body_kind") == "notes"))
    counts = shown.groupBy("book_id", F.col("note").alias("seq")).agg(F.count("*").alias("n"), F.min_by(F.col("kind").isin("image", "table"), F.col("seq")).alias("block_first"))
    notes_ = nodes.where("kind = 'section' AND body_kind = 'notes' AND xml_id IS NOT NULL").select("book_id", "seq", "xml_id")
    return notes_.join(counts, ["book_id", "seq"], "left").select("book_id", "xml_id", F.coalesce("n", F.lit(0)).alias("n_visible"), F.coalesce("block_first", F.lit(False)).alias("block_first"))


def features(nodes: DataFrame) -> DataFrame:
    """What each book has: tables in sections, tables with links, pictures among text, notes, the ids of its pictures and of its elements, each once and in order."""
    t = innermost(nodes.where("error IS NULL"), F.col("kind") == "table", "table")
    t = innermost(t, F.col("kind").isin("p", "v", "subtitle", "text-author", "td", "th"), "block")
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    once = lambda c: F.sort_array(F.collect_set(c))
    return t.groupBy("book_id").agg(
        flag(F.col("kind") == "table").alias("tables"),
        flag((F.col("kind") == "a") & F.col("table").isNotNull()).alias("tables_with_links"),
        flag((F.col("kind") == "image") & F.col("block").isNotNull()).alias("inline_images"),
        flag(F.col("body_kind") == "notes").alias("notes"),
        once(F.when((F.col("kind") == "image") & F.startswith("href", F.lit("#")), F.substring("href", 2, 1 << 30))).alias("images"),
        once(F.nullif(F.trim("xml_id"), F.lit(""))).alias("ids"),
    )

"""Books made of the driver's tables, with sections, notes, links, tables and pictures, for queries whose results SQL can tell from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _xml(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def conversation_books(turns: DataFrame) -> DataFrame:
    """A book for each conversation: path (conv_id), content.

    Each turn is a section with its text as a paragraph: an id t<turn> unless turn % 3 = 0, a title unless
    turn % 4 = 3, a link to note n<turn> if it is even (shown as *), a link to nothing if turn % 5 = 0, a
    nested section with the title Inner <turn> if turn % 3 = 1, a picture if turn % 6 = 5. Notes stand in a
    second body, those of turns that 4 divides with a title and a nested section, those of turns that 6
    divides in a section without id.
    """
    n = F.col("turn").cast("string")
    when = lambda condition, *parts: F.when(F.expr(condition), _xml(*parts)).otherwise("")
    section = _xml(
        "<section", when("turn % 3 <> 0", ' id="t', n, '"'), ">",
        when("turn % 4 <> 3", "<title><p>", F.col("role"), " ", n, "</p></title>"),
        "<p>", _escaped(F.col("text")),
        when("turn % 2 = 0", '<a l:href="#n', n, '">*</a>'),
        when("turn % 5 = 0", '<a l:href="#gone', n, '">lost</a>'),
        "</p>",
        when("turn % 6 = 5", '<image l:href="#i', n, '" alt="A', n, '"/>'),
        when("turn % 3 = 1", "<section><title><p>Inner ", n, "</p></title><p>in ", n, "</p></section>"),
        "</section>",
    )
    note = _xml('<section id="n', n, '">', when("turn % 4 = 0", "<title><p>N", n, "</p></title>"), "<p>note ", n, "</p>", when("turn % 4 = 0", "<section><title><p>Deep</p></title><p>more</p></section>"), "</section>")
    note = F.when(F.col("turn") % 2 == 0, F.when(F.col("turn") % 6 == 0, _xml("<section>", note, "</section>")).otherwise(note)).otherwise("")
    t = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.struct("turn", section.alias("section"), note.alias("note")).alias("x"))
    t = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # a book
    id_ = F.col("conv_id").cast("string")
    head = _xml(
        '<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><genre>sf</genre><genre>talk</genre>',
        "<author><first-name>Ann</first-name><last-name>L", (F.col("conv_id") % 5).cast("string"), "</last-name></author><book-title>Talk ", id_, "</book-title><keywords>Talk; one, One;two</keywords><lang>en</lang>",
        '<sequence name="Talks" number="', id_, '"/></title-info></description><body><title><p>Talk</p><p>No. ', id_, "</p></title>",
    )
    joined = lambda c: F.array_join(F.transform("xs", lambda x: x[c]), "")
    xml = _xml(head, joined("section"), '</body><body name="notes"><title><p>Notes</p></title>', joined("note"), "</body></FictionBook>")
    return t.select(id_.alias("path"), F.encode(xml, "UTF-8").alias("content"))

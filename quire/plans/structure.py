"""The plan of a book: units that begin on a page of their own, contents, landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_or_none
from ..operators.sequences import scan
from .books import titles

#: Depths of sections from which the deepest rule counts.
DEEPEST = 6


def needs_break(breaks: dict[int, bool], depth: int) -> bool:
    """Whether sections of a depth begin on a page of their own; the first depth does so by itself."""
    return depth >= 2 and breaks.get(min(depth, DEEPEST), False)


def plan(nodes: DataFrame, breaks: dict[int, bool], body_break: bool = False, printed: bool = False, covers: DataFrame | None = None) -> DataFrame:
    """Rows of units and entries of contents: book_id, ord, role (unit, entry), kind, id, title, depth, title_depth, parent (ord of the entry above), start.

    Bodies with a title have an intro, and a picture of its own before it where body titles break; every
    section of the first depth is a unit, deeper ones if they have a title and their depth breaks. Untitled
    sections hand their entries to the last titled one before them at that depth, else upward. Bodies of
    notes come last, unless notes are printed. The first unit that isn't a picture of notes is the start.
    """
    t = nodes.where("kind IN ('body', 'section')").select("book_id", "seq", "last_seq", "kind", "body_no", "body_kind", "xml_id", F.col("style").alias("name"))
    t = t.join(titles(nodes).select("book_id", "seq", F.col("title"), F.col("toc_title"), F.lit(True).alias("titled")), ["book_id", "seq"], "left")
    image = nodes.where("kind = 'image'").select("book_id", F.col("parent_seq").alias("seq")).distinct().withColumn("image", F.lit(True))
    t = t.join(image, ["book_id", "seq"], "left").withColumn("late", F.when(F.col("body_kind") == "notes", 1).otherwise(0))

    def make():
        stack: list[dict] = []
        state = {"ord": 0, "start": False, "notes": 0, "entry": None}

        def row(role, kind, id_, title, depth, title_depth, parent, start=False):
            state["ord"] += 1
            return (state["ord"], role, kind, id_, title, depth, title_depth, parent, start)

        def start() -> bool:
            was, state["start"] = state["start"], True
            return not was

        def step(seq, last, kind, body_no, body_kind, id_, name, title, toc, titled, picture):
            while stack and stack[-1]["last"] < seq:
                stack.pop()
            out, has = [], bool(title)
            if kind == "body":
                stack.clear()
                me = {"last": last if last is not None else seq, "depth": 0, "title_depth": 1, "entry": None, "kind": body_kind, "last_titled": None, "titled": True}
                if body_kind == "notes":
                    if not printed:
                        head = title or name or ""
                        out.append(row("unit", "notes", f"a-notes-{state['notes']}", head, None, None, None))
                        if head:
                            out.append(row("entry", "notes", f"a-notes-{state['notes']}", head, None, None, None))
                            me["entry"] = state["ord"]
                    state["notes"] += 1
                elif titled:
                    head = title or name or ""
                    if picture and body_break:
                        out.append(row("unit", "body-image", f"a-body-image-{body_no}", head, None, None, None, start()))
                    out.append(row("unit", "body", f"a-body-{body_no}", head, None, None, None, start() if body_kind == "main" else False))
                    out.append(row("entry", "body", f"a-body-{body_no}", toc or "Untitled", None, None, None))
                stack.append(me)
                return out
            above = stack[-1]
            depth = above["depth"] + 1
            title_depth = above["title_depth"] + (1 if above["depth"] and above["titled"] else 0)
            me = {"last": last if last is not None else seq, "depth": depth, "title_depth": title_depth, "kind": above["kind"], "last_titled": None, "titled": has}
            if above["kind"] == "notes":
                if depth == 1 and has and above["entry"] is not None:
                    out.append(row("entry", "note", id_, title, None, None, above["entry"]))
                me["entry"] = None
                stack.append(me)
                return out
            if depth == 1 or (has and needs_break(breaks, depth)):
                out.append(row("unit", "section", id_, title or "", depth, title_depth, None, start()))
            # entries of a section without a title go to the last titled one beside it, else to what is above
            parent = above["entry"] if has or above["last_titled"] is None or depth == 1 else above["last_titled"]
            if has:
                out.append(row("entry", "section", id_, title, None, None, above["entry"]))
                me["entry"] = above["last_titled"] = state["ord"]
            else:
                me["entry"] = parent
            stack.append(me)
            return out

        return step

    added = "ord int, role string, kind_ string, id string, title_ string, depth int, title_depth int, parent int, start boolean"
    inputs = ["seq", "last_seq", "kind", "body_no", "body_kind", F.coalesce("xml_id", F.lit("")), "name", "title", "toc_title", F.coalesce("titled", F.lit(False)), F.coalesce("image", F.lit(False))]
    t = scan(t, ["book_id"], ["late", "seq"], inputs, make, added)
    t = t.select("book_id", "ord", "role", F.col("kind_").alias("kind"), "id", F.col("title_").alias("title"), "depth", "title_depth", "parent", "start")
    if covers is not None:  # book_id, id
        cover = covers.select("book_id", F.lit(0).alias("ord"), F.lit("unit").alias("role"), F.lit("cover").alias("kind"), "id", F.lit("Cover").alias("title"), *(F.lit(None).cast("int").alias(c) for c in ("depth", "title_depth", "parent")), F.lit(False).alias("start"))
        t = t.unionByName(cover)
    return t


def section_files(plan_rows: DataFrame) -> DataFrame:
    """Units with the file that each is written to: cover, body-N, section-N, notes; notes share one."""
    kind = F.when(F.col("kind").isin("notes"), "notes").when(F.col("kind") == "cover", "cover").otherwise("index")
    t = plan_rows.where("role = 'unit'").withColumn("file_kind", kind)
    number = scan(t, ["book_id"], ["ord"], ["file_kind"], _numbers, "number int")
    return number.select("book_id", "ord", "id", F.when(F.col("file_kind") == "index", F.concat(F.lit("index"), F.lpad(F.col("number").cast("string"), 5, "0"), F.lit(".xhtml"))).otherwise(F.concat("file_kind", F.lit(".xhtml"))).alias("file"))


def _numbers():
    n = 0

    def step(kind):
        nonlocal n
        n += kind == "index"
        return [(n,)]

    return step


def shown_titles(plan_rows: DataFrame, untitled: bool = False) -> DataFrame:
    """Entries with the titles that a table of contents shows: none stays without one if untitled entries are wanted."""
    t = plan_rows.where("role = 'entry'")
    return t.withColumn("title", title_or_none(F.col("title"))) if untitled else t.where(F.coalesce("title", F.lit("")) != "")

"""Notes: bodies of notes in a regular form, labels in links, the order in which notes are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_whitespace, id_title
from ..operators.sequences import scan

#: What a nested section's parts become in its note.
FLAT = {"title": None, "epigraph": "cite", "annotation": None, "section": None}


def normalized(nodes: DataFrame) -> DataFrame:
    """Rows of note bodies: book_id, body_no, note (id), seq, parent (seq of the new parent, null at the top of a note), kind, text, href.

    A section with an id is a note, the first of equal ids in its body. Sections without one are taken apart:
    what they hold of notes stands by itself, their title, picture and epigraphs go to the body if that has
    none (note is null there), the rest is left out. Sections inside a note are flattened: paragraphs of titles
    become subtitles, epigraphs become cites, annotations and sections give way to what they hold. A note's
    own title, epigraphs, picture and annotation stay.
    """

    def make():
        stack: list[dict] = []  # open rows
        seen: set[str] = set()
        have: set[str] = set()  # what the body has or got

        def step(seq, last, kind, id_, up, body):
            while stack and stack[-1]["last"] < seq:
                stack.pop()
            above = stack[-1] if stack else {"seq": None, "note": None, "drop": False, "at": None, "title": False, "promote": None, "depth": 0, "kind": ""}
            me = {"seq": seq, "last": last if last is not None else seq, "note": above["note"], "drop": above["drop"], "at": above["at"], "title": above["title"], "promote": above["promote"], "kind": kind}
            out = []
            if kind == "body":
                seen.clear()
                have.clear()
            elif me["drop"]:
                pass
            elif me["promote"] is not None:
                me["at"] = seq
                out = [(None, above["at"], kind)]
            elif me["note"] is None:
                if kind == "section" and id_:
                    if id_ in seen:
                        me["drop"] = True
                    else:
                        seen.add(id_)
                        me["note"], me["at"] = id_, None
                elif kind != "section":
                    direct = above["kind"] == "body"
                    if kind in ("title", "image", "epigraph") and (direct or above["kind"] == "section") and (kind not in have or direct or (kind == "epigraph" and ("from", above["seq"]) in have)):
                        have.add(kind)
                        have.add(("from", above["seq"]))
                        me["promote"], me["at"] = True, seq
                        out = [(None, None, kind)]
                    else:
                        me["drop"] = True
            else:
                nested = above["kind"] == "section" and any(x["kind"] == "section" and x["note"] == me["note"] for x in stack[:-1])
                if kind == "section" or (nested and kind in ("title", "annotation")):
                    me["title"] = kind == "title"
                else:
                    new = FLAT["epigraph"] if nested and kind == "epigraph" else "subtitle" if me["title"] and kind == "p" else kind
                    out = [(me["note"], me["at"], new)]
                    me["at"], me["title"] = seq, False
            stack.append(me)
            return out

        return step

    t = nodes.where("body_kind = 'notes'").select("book_id", "body_no", "seq", "last_seq", F.col("kind").alias("was"), "xml_id", "text", "href")
    t = scan(t, ["book_id"], ["seq"], ["seq", "last_seq", "was", F.trim(F.coalesce("xml_id", F.lit(""))), "text", "body_no"], make, "note string, parent long, kind string")
    return t.select("book_id", "body_no", "note", "seq", "parent", "kind", "text", "href")


def note_titles(notes: DataFrame) -> DataFrame:
    """book_id, body_no, note, title of normalized notes; "~ id ~" for notes without the text of one."""
    in_title = scan(notes.where("note IS NOT NULL"), ["book_id"], ["seq"], ["seq", "parent", "kind"], _title_rows, "in_title boolean")
    words = in_title.where("in_title AND kind = 'text'").groupBy("book_id", "body_no", "note")
    words = words.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x.text), "").alias("title"))
    all_ = notes.where("note IS NOT NULL").select("book_id", "body_no", "note").distinct()
    title = F.nullif(F.trim(collapse_whitespace(F.col("title"))), F.lit(""))
    return all_.join(words, ["book_id", "body_no", "note"], "left").select("book_id", "body_no", "note", F.coalesce(title, id_title(F.col("note"))).alias("title"))


def _title_rows():
    inside: set[int] = set()

    def step(seq, parent, kind):
        if (parent is None and kind == "title") or parent in inside:
            inside.add(seq)
            return [(True,)]
        return [(False,)]

    return step


def labelled_links(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (book_id, seq, href, text, has_image) with the label of the note that they refer to as their text; links that hold a picture keep what they have.

    labels: book_id, xml_id, label.
    """
    t = labels.select("book_id", F.concat(F.lit("#"), "xml_id").alias("href"), F.col("label").alias("__label"))
    new = F.when(F.coalesce(F.nullif("__label", F.lit("")), F.lit(None)).isNotNull() & ~F.coalesce("has_image", F.lit(False)), F.col("__label")).otherwise(F.col("text"))
    return links.join(t, ["book_id", "href"], "left").withColumn("text", new).select(*links.columns)

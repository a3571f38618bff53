"""Queries over books made of conversations, with SQL that tells the same from the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import templates, text
from ..operators import links, sequences, trees
from ..sinks import render
from ..sources import books as source
from . import books, notes, samples, structure
from .catalogue import QUERIES, SQL, W, query, table

__all__ = ["QUERIES", "SQL"]

#: Turns in order with their number k in the book.
C = "c AS (SELECT conv_id::VARCHAR AS book_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"
#: Sections of a book in order: each turn's own, then its nested one.
S = f"""{C}, s AS (SELECT book_id, turn, 0 AS nested, CASE WHEN turn % 3 <> 0 THEN 't' || turn END AS xml_id, CASE WHEN turn % 4 <> 3 THEN role || ' ' || turn END AS title FROM c
    UNION ALL SELECT book_id, turn, 1, NULL, 'Inner ' || turn FROM c WHERE turn % 3 = 1)"""


def nodes_of(spark, d) -> DataFrame:
    return source.nodes(samples.conversation_books(table(spark, d, "conversations")))


def _turns(spark, d) -> DataFrame:
    """book_id, nested, k, turn: which turn the k-th section of the first or second depth belongs to."""
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), "turn")
    k = F.row_number().over(Window.partitionBy("book_id").orderBy("turn"))
    return c.select("book_id", F.lit(0).alias("nested"), k.alias("k"), "turn").union(c.where("turn % 3 = 1").select("book_id", F.lit(1), k, "turn"))


def _sections(n: DataFrame) -> DataFrame:
    """Sections of main bodies with their number k at their depth."""
    k = F.row_number().over(Window.partitionBy("book_id", "depth").orderBy("seq"))
    return n.where("kind = 'section' AND body_kind = 'main'").select("book_id", "seq", F.when(F.col("depth") > 1, 1).otherwise(0).alias("nested"), k.alias("k"))


@query(
    f"""WITH {C} SELECT book_id, 'Talk ' || book_id AS title, ['Ann L' || (book_id::BIGINT % 5)] AS authors, ['sf', 'talk'] AS genres, 'Talks #' || book_id AS series,
    ['sf', 'talk', 'one', 'two'] AS subjects, ['Talk', 'one', 'two'] AS keywords, 'en' AS lang FROM c GROUP BY book_id"""
)
def book_metadata(spark, d):
    m = source.metadata(samples.conversation_books(table(spark, d, "conversations")))
    words = text.subjects(F.col("genres"), F.col("keywords"))
    return m.select("book_id", "title", "authors", "genres", text.series_text(F.col("series")).alias("series"), F.transform(words, lambda x: x.value).alias("subjects"), text.keywords(F.col("keywords")).alias("keywords"), "lang")


@query(f"WITH {S}, g AS (SELECT *, row_number() OVER (PARTITION BY book_id, xml_id IS NULL ORDER BY turn, nested) AS n FROM s) SELECT book_id, turn, nested, coalesce(xml_id, 'sect_' || n) AS xml_id FROM g")
def book_sections(spark, d):
    n = nodes_of(spark, d)
    t = _sections(n).join(books.section_ids(n), ["book_id", "seq"])
    return t.join(_turns(spark, d), ["book_id", "nested", "k"]).select("book_id", "turn", "nested", "xml_id")


@query(
    f"""WITH {S} SELECT book_id, 'Talk. No. ' || book_id AS title, NULL AS parent FROM c GROUP BY book_id
    UNION ALL SELECT s.book_id, title, CASE WHEN nested = 1 AND s.turn % 4 <> 3 THEN 'turn' END FROM s WHERE title IS NOT NULL
    UNION ALL SELECT book_id, 'Notes', NULL FROM c GROUP BY book_id UNION ALL SELECT book_id, 'N' || turn, 'Notes' FROM c WHERE turn % 4 = 0 AND turn % 6 <> 0"""
)
def book_toc(spark, d):
    p = structure.shown_titles(structure.plan(nodes_of(spark, d), {2: True})).select("book_id", "ord", "title", "parent")
    up = p.select("book_id", F.col("ord").alias("parent"), F.when(F.col("title").rlike("^(system|user|assistant) "), "turn").otherwise(F.col("title")).alias("up"))
    return p.join(up, ["book_id", "parent"], "left").select("book_id", "title", F.col("up").alias("parent"))


@query(
    f"""WITH {S} SELECT book_id, 'body' AS kind, 'a-body-0' AS id, NULL::INT AS depth, NULL::INT AS title_depth, true AS start FROM c GROUP BY book_id
    UNION ALL SELECT book_id, 'section', coalesce(xml_id, ''), 1 + nested, CASE WHEN nested = 1 AND turn % 4 <> 3 THEN 2 ELSE 1 END, false FROM s
    UNION ALL SELECT book_id, 'notes', 'a-notes-0', NULL, NULL, false FROM c GROUP BY book_id"""
)
def book_units(spark, d):
    return structure.plan(nodes_of(spark, d), {2: True}).where("role = 'unit'").select("book_id", "kind", "id", "depth", "title_depth", "start")


@query(f"WITH {C} SELECT book_id, 1 + count(*)::BIGINT AS files, 'index' || lpad((1 + count(*))::VARCHAR, 5, '0') || '.xhtml' AS last_file FROM c GROUP BY book_id")
def book_files(spark, d):
    t = structure.section_files(structure.plan(nodes_of(spark, d), {})).where("file LIKE 'index%'")
    return t.groupBy("book_id").agg(F.count("*").alias("files"), F.max("file").alias("last_file"))


@query(f"WITH {S} SELECT book_id, max(CASE WHEN nested = 1 AND turn % 4 <> 3 THEN 2 ELSE 1 END)::INT AS depth FROM s GROUP BY book_id")
def toc_depth(spark, d):
    p = structure.plan(nodes_of(spark, d), {2: True}, printed=True).where("role = 'entry'")
    return trees.nav_depth(p.select("book_id", "ord", "parent"), ["book_id"], "ord", "parent").select("book_id", "depth")


@query(f"WITH {C} SELECT book_id, 'n' || turn AS note, CASE WHEN turn % 4 = 0 THEN 'N' || turn ELSE '~ n' || turn || ' ~' END AS title FROM c WHERE turn % 2 = 0")
def note_titles(spark, d):
    return notes.note_titles(notes.normalized(nodes_of(spark, d))).select("book_id", "note", "title")


@query(
    f"""WITH {C} SELECT book_id, 'n' || turn AS note, CASE WHEN turn % 4 = 0 THEN 'title p text p text subtitle text p text' ELSE 'p text' END AS kinds,
    CASE WHEN turn % 4 = 0 THEN 'N' || turn || '|note ' || turn || '|Deep|more' ELSE 'note ' || turn END AS texts FROM c WHERE turn % 2 = 0"""
)
def note_flattening(spark, d):
    t = notes.normalized(nodes_of(spark, d)).where("note IS NOT NULL").groupBy("book_id", "note").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))).alias("x"))
    return t.select("book_id", "note", F.array_join(F.transform("x", lambda x: x.kind), " ").alias("kinds"), F.array_join(F.transform("x", lambda x: x.text), "|").alias("texts"))


@query(f"WITH {C} SELECT book_id, 'n' || turn AS xml_id, CASE WHEN turn % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS n_visible, false AS block_first FROM c WHERE turn % 2 = 0")
def note_sizes(spark, d):
    return books.note_contents(nodes_of(spark, d))


@query(
    f"""WITH {C} SELECT book_id, '#n' || turn AS href, '[' || turn || ']' AS text, 'internal' AS kind FROM c WHERE turn % 2 = 0
    UNION ALL SELECT book_id, NULL, 'lost [broken link: #gone' || turn || ']', 'internal' FROM c WHERE turn % 5 = 0"""
)
def note_link_labels(spark, d):
    n = nodes_of(spark, d)
    fixed = books.repaired_links(n).withColumn("has_image", F.lit(False))
    ids = n.where("body_kind = 'notes' AND xml_id IS NOT NULL").select("book_id", "xml_id", F.concat(F.lit("["), F.substring("xml_id", 2, 20), F.lit("]")).alias("label"))
    return notes.labelled_links(fixed, ids).select("book_id", "href", "text", "kind")


@query(f"WITH {S} SELECT book_id, count(*)::BIGINT AS sections, count(*)::BIGINT AS nontrivial FROM s GROUP BY book_id")
def section_contents(spark, d):
    t = books.section_content(nodes_of(spark, d).where("body_kind = 'main'"))
    return t.groupBy("book_id").agg(F.count("*").alias("sections"), F.count_if("nontrivial").alias("nontrivial"))


@query(
    f"""WITH {S}, f AS (SELECT s.book_id, s.turn, s.nested, CASE WHEN nested = 1 THEN 'in ' || s.turn ELSE text END AS t FROM s JOIN c USING (book_id, turn))
    SELECT book_id, turn, nested, substr(t, 1, 1) AS dropcap FROM f WHERE t <> '' AND NOT regexp_matches(t, '^{W}') AND NOT regexp_matches(t, '^["«„—-]') AND substr(t, 1, 1) <> chr(39)"""
)
def book_dropcaps(spark, d):
    n = nodes_of(spark, d)
    t = books.dropcaps(n).select("book_id", F.col("section").alias("seq"), "dropcap").join(_sections(n), ["book_id", "seq"])
    return t.join(_turns(spark, d), ["book_id", "nested", "k"]).select("book_id", "turn", "nested", "dropcap")


@query(f"WITH {C} SELECT book_id, 'not-found-0' AS id, 'image/svg+xml' AS mime, count(*)::BIGINT AS pointed FROM c WHERE turn % 6 = 5 GROUP BY book_id")
def missing_pictures(spark, d):
    n = nodes_of(spark, d)
    none = spark.createDataFrame([], "book_id string, id string")
    pointed, new = links.missing_images(none, n.where("xml_id IS NOT NULL").select("book_id", "xml_id"), n.where("kind = 'image'").select("book_id", "seq", "href"))
    counts = pointed.where("href = '#not-found-0'").groupBy("book_id").agg(F.count("*").alias("pointed"))
    return new.join(counts, "book_id").select("book_id", "id", "mime", "pointed")


@query(f"WITH {C} SELECT book_id, 'index' || lpad((1 + k)::VARCHAR, 5, '0') || '.xhtml' AS file, 'notes.xhtml#n' || turn AS href FROM c WHERE turn % 2 = 0")
def links_to_files(spark, d):
    n = nodes_of(spark, d)
    inside = books.innermost(n, (F.col("kind") == "section") & (F.col("depth") == 1), "unit").where("kind = 'a' AND href LIKE '#n%'").select("book_id", F.col("unit").alias("seq"), "href")
    files = _sections(n).where("nested = 0").select("book_id", "seq", F.concat(F.lit("index"), F.lpad((F.col("k") + 1).cast("string"), 5, "0"), F.lit(".xhtml")).alias("file"))
    a = inside.join(files, ["book_id", "seq"]).select("book_id", "file", "href")
    ids = n.where("xml_id IS NOT NULL AND body_kind = 'notes'").select("book_id", "xml_id", F.lit("notes.xhtml").alias("file"), "seq")
    return links.filed_links(a, links.first_file(ids, ["book_id"], "xml_id", "file", ["seq"]), ["book_id"], "file")


@query(f"WITH {C} SELECT book_id, 'n' || turn AS xml_id FROM c WHERE turn % 2 = 0 UNION ALL SELECT book_id, 'gone' || turn FROM c WHERE turn % 5 = 0")
def book_link_targets(spark, d):
    return links.link_targets(nodes_of(spark, d).where("kind = 'a'"), ["book_id"])


@query(f"WITH {C} SELECT book_id, 'n' || turn AS xml_id, turn AS eid FROM c WHERE turn % 2 = 0 AND turn > 0")
def book_anchors(spark, d):
    n = nodes_of(spark, d)
    ids = n.where("xml_id IS NOT NULL").select("book_id", "xml_id", F.substring("xml_id", 2, 20).try_cast("long").alias("eid"))
    return links.anchors(ids, links.link_targets(n.where("kind = 'a'"), ["book_id"]), ["book_id"], "eid").select("book_id", "xml_id", "eid")


@query(f"WITH {C} SELECT book_id, turn, 'A' || turn AS alt FROM c WHERE turn % 6 = 5")
def picture_alts(spark, d):
    n = nodes_of(spark, d)
    t = books.subtree_of(n.where("body_kind = 'main'"), ["section"], "alt").join(_sections(n), ["book_id", "seq"])
    return t.join(_turns(spark, d), ["book_id", "nested", "k"]).select("book_id", "turn", F.col("text").alias("alt"))


@query(f"WITH {C} SELECT book_id, 'n' || turn AS target, 0 AS round, row_number() OVER (PARTITION BY book_id ORDER BY turn) AS n FROM c WHERE turn % 2 = 0")
def note_queue(spark, d):
    n = nodes_of(spark, d)
    refs = n.where("kind = 'a' AND href LIKE '#n%' AND body_kind = 'main'").select("book_id", "seq", F.substring("href", 2, 20).alias("target"))
    nested = n.where("kind = 'a' AND body_kind = 'notes'").select("book_id", F.lit("").alias("source"), F.substring("href", 2, 20).alias("target"), "seq")
    return sequences.reading_queue(refs, nested, ["book_id"], "source", "target", ["seq"])


@query(
    f"""WITH {C}, h AS (SELECT book_id, 0 AS pos, 0 AS part, '# Talk No. ' || book_id AS line FROM c WHERE k = 1
    UNION ALL SELECT book_id, k, 0, '## ' || role || ' ' || turn FROM c WHERE turn % 4 <> 3 UNION ALL SELECT book_id, k, 1, '### Inner ' || turn FROM c WHERE turn % 3 = 1
    UNION ALL SELECT book_id, 1000000, 0, '# Notes' FROM c WHERE k = 1
    UNION ALL SELECT book_id, 1000000 + k, 1, repeat('#', 2 + (turn % 6 = 0)::INT) || ' N' || turn FROM c WHERE turn % 4 = 0
    UNION ALL SELECT book_id, 1000000 + k, 2, repeat('#', 3 + (turn % 6 = 0)::INT) || ' Deep' FROM c WHERE turn % 4 = 0)
    SELECT book_id, md5(string_agg(line, chr(10) || chr(10) ORDER BY pos, part)) AS digest FROM h GROUP BY book_id"""
)
def book_headings(spark, d):
    return render.headings(nodes_of(spark, d)).select("book_id", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"WITH {C} SELECT book_id, 'out/' || CASE WHEN book_id::BIGINT % 2 = 0 THEN 'L' || (book_id::BIGINT % 5) || '/' ELSE '' END || 'Talk ' || book_id || '.epub' AS path FROM c GROUP BY book_id")
def output_names(spark, d):
    m = source.metadata(samples.conversation_books(table(spark, d, "conversations")))
    last = F.element_at("people", 1)["last"]
    name = F.when(F.col("book_id").cast("long") % 2 == 0, F.concat(last, F.lit("/"), F.col("title"))).otherwise(F.concat(F.lit("..:"), F.col("title")))
    return m.select("book_id", text.output_path(F.lit("out"), name, ".epub").alias("path"))


@query(
    f"""WITH {C} SELECT book_id, false AS tables, false AS tables_with_links, false AS inline_images, true AS notes, coalesce(list_sort(list(DISTINCT 'i' || turn) FILTER (WHERE turn % 6 = 5)), []) AS images,
    len(list(DISTINCT turn) FILTER (WHERE turn % 3 <> 0)) + len(list(DISTINCT turn) FILTER (WHERE turn % 2 = 0)) AS n_ids FROM c GROUP BY book_id"""
)
def book_features(spark, d):
    t = books.features(nodes_of(spark, d))
    return t.select("book_id", "tables", "tables_with_links", "inline_images", "notes", "images", F.size("ids").cast("long").alias("n_ids"))


@query(
    f"""WITH {C} SELECT book_id, '---' || chr(10) || 'title: "Talk ' || book_id || '"' || chr(10) || 'authors:' || chr(10) || '  - "Ann L' || (book_id::BIGINT % 5) || '"' || chr(10) || 'series:' || chr(10) || '  - name: "Talks"' || chr(10) || '    number: ' || book_id || chr(10)
    || array_to_string(['language: "en"', 'genres:', '  - "sf"', '  - "talk"', 'keywords:', '  - "Talk"', '  - "one"', '  - "two"', '---'], chr(10)) AS content FROM c GROUP BY book_id"""
)
def book_front_matter(spark, d):
    return render.front_matter(source.metadata(samples.conversation_books(table(spark, d, "conversations"))))


@query(
    f"""WITH {C}, p AS (SELECT book_id, k, turn, role, regexp_replace(trim(regexp_replace(regexp_replace(text, '{W}+', ' ', 'g'), '([\\\\`*_\\[\\]<>])', '\\\\\\1', 'g') || CASE WHEN turn % 2 = 0 THEN '[\\*](#n' || turn || ')' ELSE '' END
      || CASE WHEN turn % 5 = 0 THEN '[lost](#gone' || turn || ')' ELSE '' END), '{W}+', ' ', 'g') AS t FROM c),
    b AS (SELECT book_id, 0 AS pos, 0 AS part, '# Talk No. ' || book_id AS line FROM c WHERE k = 1 UNION ALL SELECT book_id, k, 0, '## ' || role || ' ' || turn FROM c WHERE turn % 4 <> 3
      UNION ALL SELECT book_id, k, 1, t FROM p WHERE t <> '' UNION ALL SELECT book_id, k, 2, '![A' || turn || '](#i' || turn || ')' FROM c WHERE turn % 6 = 5
      UNION ALL SELECT book_id, k, 3, '### Inner ' || turn FROM c WHERE turn % 3 = 1 UNION ALL SELECT book_id, k, 4, 'in ' || turn FROM c WHERE turn % 3 = 1)
    SELECT book_id, count(*)::BIGINT AS n, md5(string_agg(line, chr(10) || chr(10) ORDER BY pos, part)) AS digest FROM b GROUP BY book_id"""
)
def book_markdown(spark, d):
    t = render.document(nodes_of(spark, d))
    return t.select("book_id", F.size(F.split("content", "\n\n")).cast("long").alias("n"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"WITH {C} SELECT book_id, 'L' || (book_id::BIGINT % 5) || ' - ' || CASE WHEN book_id::BIGINT % 7 > 0 THEN 'TALK ' || book_id ELSE 'Talks/' || lpad(book_id, greatest(3, length(book_id))::INT, '0') END AS name FROM c GROUP BY book_id")
def template_names(spark, d):
    m = source.metadata(samples.conversation_books(table(spark, d, "conversations"))).withColumn("id", F.when(F.col("book_id").cast("long") % 7 == 0, "seven"))
    template = '{{- with first .Authors }}{{ .LastName }}{{ end }} - {{ if .BookID }}{{ with first .Series }}{{ .Name }}/{{ printf "%03d" .Number }}{{ end }}{{ else }}{{ .Title | upper }}{{ end -}}'
    return templates.output_names(m, template, "epub3").select("book_id", "name")

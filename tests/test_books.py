"""Reading, repairing, numbering and rendering of small books; archives, styles and streams."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import links, sequences, trees
from quire.plans import books
from quire.sinks import render
from quire.sources import books as source
from quire.sources import styles
from quire.streaming import ingest

BOOK = """<?xml version="1.0" encoding="utf-8"?>
<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink">
<description><title-info><genre>sf</genre><author><first-name>Ann</first-name><last-name>Lee</last-name></author><book-title>A  Book</book-title>
<date value="2001-02-03">2001</date><lang>en</lang><sequence name="S" number="1"><sequence name="T"/></sequence></title-info><document-info><id>i1</id></document-info></description>
<body><title><p>A Book</p></title>
<section id="sect_1"><title><p>One</p></title><p>Hello <strong>big</strong> world<a l:href="#n1">1</a> tail&nbsp;x</p><p><a l:href="#gone">lost</a> <a l:href="">none</a><a l:href="mailto:a@b">m</a></p></section>
<section><title><p>Two</p></title><section><title><p>Inner</p></title><p>- yes - no</p></section></section></body>
<body name="Notes"><section id="n1"><p>First</p></section><section><p>no id</p></section><section id="n3"><p>Third</p></section><section id="n1"><p>again</p></section></body>
<binary id="c" content-type="image/png">aGVs
bG8</binary><binary id="bad" content-type="image/png">!!</binary></FictionBook>"""


@pytest.fixture(scope="module")
def files(spark):
    rows = [("b", bytearray(BOOK, "utf-8")), ("cut", bytearray(BOOK[:400], "utf-8")), ("utf16", bytearray(b"\xff\xfe" + BOOK.encode("utf-16-le")))]
    return spark.createDataFrame(rows, "path string, content binary")


def test_nodes_and_metadata(spark, files):
    n = source.nodes(files).cache()
    assert {r.book_id for r in n.where("error IS NOT NULL").collect()} == {"cut"}
    b = n.where("book_id = 'b'").orderBy("seq").collect()
    assert [r.seq for r in b] == list(range(len(b))) and all(r.last_seq >= r.seq for r in b)
    assert [r.text for r in b if r.kind == "text"][2:8] == ["Hello ", "big", " world", "1", " tail\xa0x", "lost"]
    assert n.where("book_id = 'utf16'").count() == len(b)
    assert {(r.body_no, r.body_kind) for r in b} == {(0, "main"), (1, "notes")}
    m = source.metadata(files).where("book_id = 'b'").first()
    assert (m.title, m.authors, m.genres, m.date_value, m.id) == ("A Book", ["Ann Lee"], ["sf"], "2001-02-03", "i1")
    assert [tuple(s) for s in m.series] == [("S", "1", None), ("T", None, 0)]
    assert [(r.id, r.data and bytes(r.data), r.error) for r in source.binaries(files).where("book_id = 'b'").collect()] == [("c", b"hello", None), ("bad", None, "nothing decoded")]


def test_steps(spark, files):
    n = source.nodes(files).where("book_id = 'b'").cache()
    assert {(r.xml_id, r.body_number, r.note_no, r.label) for r in books.notes(n).collect()} == {("n1", 0, 1, "1"), ("n3", 0, 3, "3")}
    fixed = books.repaired_links(n).orderBy("seq")
    assert [(r.href, r.text) for r in fixed.collect()] == [("#n1", "1"), (None, "lost [broken link: #gone]"), (None, "none [empty link]"), ("mailto:a@b", "m")]
    again = links.repaired(fixed.where("href IS NOT NULL").select("book_id", "seq", "href", "text"), n.select("book_id", "xml_id"), ["book_id"])
    assert again.where("was_broken").count() == 0
    assert [r.xml_id for r in books.section_ids(n).orderBy("seq").collect()] == ["sect_1", "sect_2", "sect_3"]
    assert [(r.title, r.level, r.parent) for r in books.contents(n).orderBy("seq").collect()][0][0] == "One"
    toc = {r.title: (r.seq, r.parent) for r in books.contents(n).collect()}
    assert toc["Inner"][1] == toc["Two"][0] and toc["One"][1] is None
    assert [r.dropcap for r in books.dropcaps(n).collect()] == ["H"]
    t = [r.text for r in books.transformed(n).orderBy("seq").where("kind = 'text'").collect()]
    assert "- yes — no" in t
    p = books.positions(n).collect()
    assert max(r.pid for r in p) == sum(r.length for r in p)
    md = render.markdown(n).first().content
    assert "# A Book" in md and "Hello big world1 tail x" in md
    assert "world tail x" in " ".join(r.text for r in render.block_texts(n, links=False).collect())
    assert [r.path for r in render.output_paths(source.metadata(files).where("error IS NULL"), ".md").orderBy("book_id").collect()] == ["Ann_Lee/A__Book.md".replace("__", "_"), "Ann_Lee/A_Book-1.md"]


def test_archives_and_streams(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("x/one.fb2", BOOK)
        z.writestr("x/bad.fb2", BOOK[:300])
        z.writestr("readme.txt", "no")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.zip").write_bytes(raw.getvalue())
    (tmp_path / "in/b.fb2").write_text(BOOK)
    n = source.nodes(source.files(spark, str(tmp_path / "in")))
    assert {(r.book_id.split("/")[-1], r.error is None) for r in n.select("book_id", "error").distinct().collect()} == {("one.fb2", True), ("bad.fb2", False), ("b.fb2", True)}
    assert [source.safe_name(x) for x in ("a/b.fb2", "../x", "a/../../x", "/x", "\\x", "C:\\x", "a..b")] == [True, False, False, False, False, False, True]
    q = ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/nodes")).select("book_id").distinct().count() == 2
    assert spark.read.parquet(str(tmp_path / "out/failed")).count() == 1
    render.write_texts(render.plain_text(n), str(tmp_path / "texts"), 4)
    assert spark.read.parquet(str(tmp_path / "texts")).count() == 2


def test_styles(spark):
    css = "/* x } */ } p, h1.big::before { margin: -1.5EM 2px; color : red !important; } a > b { x: y } @media not print and screen { p { color: blue } } @import url('q.css'); @font-face { src: url(a;b) }"
    r = styles.rules(spark.createDataFrame([("s", css)], "sheet_id string, css string")).collect()
    assert [(x.selector, x.property, x.value) for x in r if x.ord == 0] == [("p", "margin", "-1.5EM 2px"), ("p", "color", "red")]
    assert [(x.element, getattr(x, "class"), x.pseudo) for x in r if x.ord == 1][0] == ("h1", "big", "before")
    assert {(x.element, x.ancestor, x.error) for x in r if x.selector == "a > b"} == {("b", "a >", None)}
    assert {x.media for x in r} == {"", "not print and screen"} and [x.value for x in r if x.selector == "@import"] == ["q.css"]
    assert [x.value for x in r if x.selector == "@font-face"] == ["url(a;b)"]
    m = spark.createDataFrame([("",), ("screen",), ("not print and screen",), ("print",), ("screen and wide",)], "media string")
    assert [x.ok for x in m.select(styles.media_applies("media", "screen").alias("ok")).collect()] == [True, True, True, False, False]


def test_toc_shapes(spark):
    def parents(rows, shape):
        df = spark.createDataFrame([(1, i, n, x) for i, (n, x) in enumerate(rows)], "b int, at int, name string, level int")
        return [None if r.parent is None else rows[r.parent][0] for r in trees.toc_parents(df, "level", ["b"], "at", shape).orderBy("at").collect()]

    rows = [("p", 2), ("q", 4), ("r", 4), ("s", 3), ("t", 2), ("u", 5), ("v", 1), ("w", 2), ("x", 2)]
    assert parents(rows, "normal") == [None, "p", "p", "p", None, "t", None, "v", "v"]
    assert parents(rows, "old_kindle") == [None, "p", "p", "p", None, "t", None, "v", "v"] and parents(rows, "flat") == [None] * 9
    # a title of level 0 encloses no chapters that follow it at once
    assert parents([("title", 0), ("one", 1), ("part", 2), ("two", 1)], "normal") == [None, None, "one", None]
    assert parents([("one", 1), ("part", 2), ("deep", 3)], "old_kindle") == [None, "one", "one"]


def test_page_split_invariants():
    r = random.Random(12)
    for _ in range(300):
        text, size = "".join(r.choice("ab ,—\n") for _ in range(r.randrange(60))), r.randrange(1, 12)
        ends = sequences.page_ends(text, size)
        parts = [text[a:b] for a, b in zip([0, *ends], ends)]
        assert "".join(parts) == text and all(0 < len(p) <= size for p in parts)
        assert all(len(p) == size or p[-1] in " ,—\n" for p in parts[:-1])


def test_as_of_and_ids(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (1, 7)], "k int, t int")
    right = spark.createDataFrame([(1, 3, 30), (1, 5, 50), (1, 5, 51), (1, 8, 80)], "k int, t int, v int")
    assert sorted(map(tuple, sequences.as_of(left, right, ["k"], "t", "v").collect()), key=str) == [(1, 1, None), (1, 5, 51), (1, 7, 51), (2, 9, None)]
    seen = links.first_seen(left, F.col("k"), ["t"])
    assert sorted(map(tuple, seen.collect())) == [(1, 1), (2, 9)]


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40

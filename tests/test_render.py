"""Books as Markdown and text; containers; sources."""

import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sinks import render
from quire.sources import books as source
from quire.sources import containers

BOOK = """<?xml version="1.0" encoding="windows-1251"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><stylesheet type="text/css"> p { color: red } </stylesheet><description><title-info><genre>sf</genre>
<author><first-name>Ann</first-name><last-name>Lee</last-name><home-page>h</home-page><email>e@f</email></author><book-title>A "Book"</book-title><annotation><p>About <b>it</b></p></annotation><keywords>one; two</keywords><date value="2001-02-03Z">3 Feb</date><coverpage><image l:href="#c"/></coverpage><lang>en</lang><src-lang>ru</src-lang>
<translator><nickname>tr</nickname></translator><sequence name="S" number="2"/></title-info><document-info><author><nickname>d</nickname></author><program-used>p</program-used><src-url>u1</src-url><src-url>u2</src-url><id>i1</id><version>1.0</version><history><p>h</p></history></document-info>
<publish-info><book-name>B</book-name><publisher>P</publisher><city>C</city><year>1999</year><isbn>0-306-40615-2</isbn></publish-info><custom-info info-type="t">v</custom-info><output mode="free" include-all="allow" price="1.5" currency="USD"/></description>
<body><title><p>Top</p><p>Two</p></title><section><title><p>One*</p></title><p>Плохо <strong> big <emphasis>deep</emphasis> <foo>kept <bar>too</bar></foo> </strong>x<a l:href="#n1">1</a> <a l:href="http://a b">site</a> <code>a`b</code><sup>2</sup></p>
<p id="m">before <p>inner</p> after <poem><stanza><v>v1</v><v>v2</v></stanza></poem></p><date>odd</date><nonsense>gone</nonsense>
<cite><p>quoted</p><text-author>me</text-author></cite><table><tr><th>h</th><th>k</th></tr><tr><td>a|b</td></tr></table><image l:href="#i" alt="pic"/></section></body>
<body name="notes"><section id="n1"><p>Note</p></section></body></FictionBook>"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("x/b.fb2", bytearray(BOOK, "utf-8"))], "path string, content binary")


def test_repairs(spark, files):
    n = source.nodes(files).orderBy("seq").collect()
    assert not [r.error for r in n if r.error]
    texts = [r.text for r in n if r.kind == "text"]
    assert "Плохо " in texts and "kept " in texts and "too" in texts and "gone" not in texts
    p = [(r.xml_id, r.style, "".join(x.text for x in n if x.kind == "text" and r.seq < x.seq <= r.last_seq).strip()) for r in n if r.kind == "p"]
    assert ("m", None, "before") in p and (None, None, "inner") in p and (None, None, "after") in p and (None, "unexpected date", "odd") in p
    assert all(r.last_seq >= r.seq for r in n) and [r.seq for r in n] == list(range(len(n)))
    assert len([r for r in n if r.kind == "v"]) == 2


def test_metadata(spark, files):
    m = source.metadata(files).first()
    assert (m.annotation, m.cover, m.src_lang, str(m.date), m.book_name, m.city, m.program, m.source_urls, m.version, m.history) == ("About it", ["c"], "ru", "2001-02-03", "B", "C", "p", ["u1", "u2"], "1.0", "h")
    assert m.people[0].home_pages == ["h"] and m.people[0].emails == ["e@f"] and m.translators[0].name == "tr" and m.document_authors == ["d"]
    assert [tuple(x) for x in m.custom] == [("t", "v")] and [tuple(x) for x in m.stylesheets] == [("text/css", "p { color: red }")]
    assert [tuple(x) for x in m.output] == [("free", "allow", 1.5, "USD")]
    bad = spark.createDataFrame([("b", bytearray(BOOK.replace('mode="free"', 'mode="x"'), "utf-8"))], "path string, content binary")
    assert "output" in source.metadata(bad).first().error


def test_document(spark, files):
    n = source.nodes(files)
    labels = spark.createDataFrame([("x/b.fb2", "n1", "1")], "book_id string, xml_id string, label string")
    md = render.document(n, labels).first().content
    assert "# Top Two" in md and "## One\\*" in md
    assert "Плохо  **big *deep* kept too** x[\\[1\\]](#n1) [site](http://a%20b) ``a`b``<sup>2</sup>" in md
    assert "v1  \nv2" in md and "> quoted" in md and "> — me" in md and "| h | k |\n| --- | --- |\n| a\\|b |  |" in md and "![pic](#i)" in md and "Note" not in md
    txt = render.document(n, labels, "txt").first().content
    assert "TOP TWO" in txt and "One*\n----" in txt and "x[1] site (http://a b) a`b2" in txt and "  quoted" in txt
    front = render.front_matter(source.metadata(files)).first().content.split("\n")
    assert front == ["---", 'title: "A \\"Book\\""', "authors:", '  - "Ann Lee"', 'description: "About it"', 'publisher: "P"', "translators:", '  - "tr"', "series:", '  - name: "S"', "    number: 2", 'language: "en"', 'date: "2001-02-03"', "genres:", '  - "sf"', "keywords:", '  - "one"', '  - "two"', 'isbn: "0306406152"', 'identifier: "i1"', "---"]


def test_files(spark, tmp_path):
    t = spark.createDataFrame([("a/x.md", "one"), ("b.md", "é"), ("a", None)], "path string, content string")
    got = {r.path: r.error for r in render.write_files(t, f"file://{tmp_path}/out").collect()}
    assert got["a/x.md"] is None and got["b.md"] is None and got["a"]
    assert (tmp_path / "out/a/x.md").read_text() == "one" and (tmp_path / "out/b.md").read_text() == "é"
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["b.md", "x.md"]


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    with zipfile.ZipFile(tmp_path / "d/a.zip", "w") as z:
        z.writestr("in/one.fb2", BOOK)
        z.writestr("in/two.dat", BOOK)
        z.writestr("out/three.fb2", BOOK)
        z.writestr("in/no.txt", "nothing")
    path, prefix = source.resolved(spark, f"{tmp_path}/d/a.zip/in/one.fb2")
    assert (path, prefix) == (f"{tmp_path}/d/a.zip", "in/one.fb2")
    f = source.files(spark, path)
    ids = lambda **k: sorted(r.book_id.split("!")[1] for r in source.nodes(f, **k).select("book_id").distinct().collect())
    assert ids() == ["in/one.fb2", "in/two.dat", "out/three.fb2"] and ids(prefix="in/") == ["in/one.fb2", "in/two.dat"] and ids(prefix=prefix) == ["in/one.fb2"]
    source.single(source.metadata(f, prefix=prefix))
    for bad in ({"prefix": "in/"}, {"prefix": "none/"}):
        with pytest.raises(ValueError):
            source.single(source.metadata(f, **bad))
    for bad in (f"{tmp_path}/d/none", f"{tmp_path}/e/none"):
        with pytest.raises(FileNotFoundError):
            source.resolved(spark, bad)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        info = zipfile.ZipInfo("x.fb2")
        z.writestr(info, BOOK)
    info.filename, info.flag_bits = "Книга.fb2".encode("cp866").decode("cp437"), 0
    assert source.entry_name(info, "cp866") == "Книга.fb2" and source.entry_name(info, None) != "Книга.fb2"
    assert source.complete("aб".encode()[:2]) == b"a" and source.complete("aб".encode()) == "aб".encode() and source.complete(b"") == b""
    assert "Плохо" in source.decoded(BOOK.encode("cp1251")) and "Плохо" in source.decoded(BOOK.encode())


def test_containers(spark):
    db = sqlite3.connect(":memory:")
    db.executescript("CREATE TABLE fragments (id TEXT, payload_type TEXT, payload_value BLOB); CREATE TABLE fragment_properties (id TEXT, key TEXT, value TEXT); CREATE TABLE capabilities (key TEXT, version INT)")
    db.executemany("INSERT INTO fragments VALUES (?, ?, ?)", [("max_id", "blob", b"\xe0\x01\x00\xea\x21\x05"), ("s1", "blob", b"\xe0\x01\x00\xea\x21\x01"), ("empty", "blob", b"\xe0\x01\x00\xea"), ("pic", "blob", b"JFIF"), ("ext", "path", b"res/r7 "), ("none", "blob", b"")])
    db.executemany("INSERT INTO fragment_properties VALUES (?, ?, ?)", [("s1", "element_type", "section"), ("s1", "child", "x")])
    db.execute("INSERT INTO capabilities VALUES ('one', 2)")
    db.commit()
    image, z = db.serialize(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("resources/book.kdf", image)
        f.writestr("resources/res/r7", b"data")
    t = spark.createDataFrame([("a.kdf", bytearray(image)), ("b.kpf", bytearray(z.getvalue())), ("bad", bytearray(b"x"))], "path string, content binary")
    got = {(r.container, r.id): (r.kind, r.element, r.location, r.data and bytes(r.data), r.error) for r in containers.fragments(t).collect()}
    assert set(got) == {(c, i) for c in ("a.kdf", "b.kpf") for i in ("s1", "pic", "ext")} | {("bad", None)}
    assert got["a.kdf", "s1"][:2] == ("value", "section") and got["a.kdf", "pic"][0] == "media"
    assert got["a.kdf", "ext"][2:4] == ("res/r7", None) and got["b.kpf", "ext"][2:4] == ("res/r7", b"data") and got["bad", None][4]
    assert [tuple(r) for r in containers.capabilities(t).orderBy("container").collect()] == [("a.kdf", "one", 2), ("b.kpf", "one", 2)]
    assert [tuple(r) for r in containers.statistics(containers.fragments(t), ["section"], ["section"]).where("container = 'a.kdf'").collect()] == [("a.kdf", 3, 2, 1, 1, 0)]
    assert containers.fragment_types(containers.fragments(t)).count() == 2 and F is not None

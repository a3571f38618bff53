"""Column and language functions on the cases of the design notes."""

import pytest
from pyspark.sql import functions as F

from quire.functions import language, text, values


def one(spark, column, *value, schema="string"):
    kinds = ", ".join(f"c{i} {schema}" for i in range(len(value)))
    return spark.createDataFrame([value], kinds).select(column(*(F.col(f"c{i}") for i in range(len(value)))).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.isbn, "0-306-40615-2", ("0306406152", "ISBN-10")),
        (text.isbn, "0 8044 2957 X", ("080442957X", "ISBN-10")),
        (text.isbn, "978-0-306-40615-7", ("9780306406157", "ISBN-13")),
        (text.isbn, "9780306406158", None),
        (text.isbn, "978030640615X", None),
        (text.isbn, "", None),
        (text.isbn, None, None),
        (text.asin, " b00 abcde12", "B00ABCDE12"),
        (text.asin, "short", None),
        (values.metadata_date, "26.10.2015", "2015-10-26"),
        (values.metadata_date, "spring 2001", None),
        (values.metadata_date, "2001-02", "2001-02"),
        (values.metadata_date, "2001-13", None),
        (values.metadata_date, "2001-02-30", None),
        (text.split_words, "Hello  world", ["Hello", "", "world"]),
        (text.split_words, "", [""]),
        (text.split_words, "Hello\xa0world", ["Hello", "world"]),
        (lambda c: text.split_words(c, True), "Hello\xa0world", ["Hello\xa0world"]),
        (lambda c: text.speech(c, "«»", '"'), "«Hello, world!»", '"Hello, world!»'),
        (lambda c: text.speech(c, "«", '"'), "«  ", "«  "),
        (lambda c: text.dashes(c, "-", "—"), "Text with - dashes - here", "Text with — dashes — here"),
        (lambda c: text.dialogue(c, "-", "~"), "a - b", "a~- b"),
        (lambda c: text.dialogue(c, "-", "~"), "a-b", "a~-b"),
        (lambda c: text.dialogue(c, "-", "~"), "a  b", "a b"),
        (lambda c: text.dialogue(c, "-", "~"), " ", ""),
        (lambda c: text.dialogue(c, "-", "~"), "-a", "-a"),
        (text.collapse_whitespace, " a\t\n b ", " a b "),
        (text.surrounding_whitespace, " a b\n", (" ", "a b", "\n")),
        (text.escape_markdown, "# a*b [c]", r"\# a\*b \[c\]"),
        (text.code_span, "a`b", "``a`b``"),
        (text.code_span, "`", "`` ` ``"),
        (text.code_block, "x ```` y", "`````\nx ```` y\n`````"),
        (lambda c: text.prefix_lines(c, "> "), "a\nb", "> a\n> b"),
        (text.escape_url, "a (b)", "a%20%28b%29"),
        (text.escape_cell, "a|b\nc", r"a\|b<br>c"),
        (text.escape_attribute, "<a\"&'>", "&lt;a&#34;&amp;&#39;&gt;"),
        (text.anchor, " #x ", "x"),
        (text.path_segment, "..a b/c.", "a_b_c"),
        (text.link_class, "#n", "internal"),
        (text.link_class, "", "empty"),
        (text.link_class, "HTTPS://x", "external"),
        (text.link_class, "mailto:", "broken"),
        (text.html_text, "<p>a<script>x</p></script> &lt;b&gt; <a href='x'>gone</a></p>", "a <b>"),
        (values.color, "#fa0", (255, 170, 0)),
        (values.color, "rgb(1, 2,3)", (1, 2, 3)),
        (values.color, "Red", (255, 0, 0)),
        (values.color, "nope", None),
    ],
)
def test_scalars(spark, f, given, want):
    got = one(spark, f, given)
    assert (tuple(got) if isinstance(want, tuple) else got) == want


def test_numbers(spark):
    d = lambda f, *v: one(spark, f, *v, schema="double")
    assert d(values.round_significant, 1.666666667) == 1.66667 and d(values.round_significant, 0.0) == 0
    assert [d(values.percent_to_rem, v) for v in (140.0, 120.0, 100.0, 80.0)] == [1.25, 1.125, 1.0, 0.8]
    assert [d(lambda v: values.font_multiplier(v, F.lit(u)), x) for x, u in ((1.25, "rem"), (0.75, "rem"), (2.0, "em"), (3.0, "px"))] == [1.4, 0.75, 2.0, 1.0]
    assert [d(values.collapsed_margin, a, b) for a, b in ((1.0, 2.0), (-1.0, -2.0), (3.0, -1.0))] == [2.0, -2.0, 2.0]
    assert [one(spark, values.section_size_version, n, schema="long") for n in (1, 65536, 65537, 65536 + 16384, 10**9)] == [1, 1, 2, 3, 256]
    assert [d(lambda v: values.length_points(v, F.lit(u), F.lit(10.0)), 2.0) for u in ("px", "em", "in", "%", "??")] == [1.5, 20.0, 144.0, 0.2, None]


def test_book_date(spark):
    df = spark.sql("SELECT date'2015-10-26' AS m, 'x' AS s, '2001' AS y UNION ALL SELECT NULL, 'spring 2001', '1999' UNION ALL SELECT NULL, ' ', '1999'")
    assert [tuple(r.x) for r in df.select(values.book_date(F.col("m"), F.col("s"), F.col("y")).alias("x")).collect()] == [("2015-10-26", None), (None, "invalid date: spring 2001"), ("1999", None)]


def test_language(spark):
    assert one(spark, language.transliterate, "Война  и мир") == "Voina i mir" and one(spark, language.transliterate, "ВОЙНА") == "VOINA" and one(spark, language.transliterate, None) is None
    assert one(spark, language.sentences, 'One. "Two!" Three? and four.') == ["One. ", '"Two!" ', "Three? and four."] and one(spark, language.sentences, "") == [""]
    h = language.Hyphenator("hy3ph he2n hena4 hen5at 1na n2at 1tio 2io o2n".split(), ["ta-ble"])
    assert h.word("hyphenation") == ["hy", "phen", "ation"] and h.word("table") == ["ta", "ble"] and h.word("Table") == ["Ta", "ble"]
    assert one(spark, lambda c: language.hyphenate(c, ["1b"], hyphen="-"), "aabaa, b") == "aa-baa, b"


def test_maps_and_lists(spark):
    r = spark.sql("SELECT map('a', 1, 'b', 2) AS m, map('b', 3, 'c', 4) AS n, array(2, 1, 2) AS x, array(3, 1) AS y, map('b', 2, 'a', 1) AS o")
    r = r.select(values.overlay(F.col("m"), F.col("n")).alias("m"), values.ordered_union(F.col("x"), F.col("y")).alias("u"), (values.signature(F.col("m")) == values.signature(F.col("o"))).alias("s")).first()
    assert r.m == {"a": 1, "b": 3, "c": 4} and r.u == [2, 1, 3] and r.s


def test_first_match(spark):
    from quire.operators import links

    rules = spark.createDataFrame([*((i, f"a{i}", "*", f"r{i}") for i in range(2000)), (-1, "A7", "x", "first"), (5000, "", "y", "y"), (6000, "*", "*", "all")], "ord int, a string, b string, rule string")
    rows = spark.createDataFrame([("a1500", "q"), ("a1500", "q"), ("a7", "X"), ("a7", "z"), (None, "y"), ("none", None)], "a string, b string")
    got = sorted(map(tuple, links.first_match(rows, rules, ["a", "b"], "ord").select("a", "b", "rule").collect()), key=str)
    assert got == sorted([("a1500", "q", "r1500")] * 2 + [("a7", "X", "first"), ("a7", "z", "r7"), (None, "y", "y"), ("none", None, "all")], key=str)
    assert [r.rule for r in links.first_match(rows, rules.limit(0), ["a", "b"], "ord").collect()] == [None] * 6
    one = links.first_match(rows, rules.where("rule = 'r7'"), ["a", "b"], "ord")
    assert sorted(str(r.rule) for r in one.collect()) == ["None"] * 4 + ["r7"] * 2


def test_reverse_index_in_parts(spark):
    from quire.operators import links

    t = spark.createDataFrame([(1, i, "hot") for i in range(1000)] + [(1, 5, "cold")], "b int, at int, target string")
    got = links.reverse_index(t, "target", ["at"], ["b"], most=100).collect()
    assert {r.n_refs for r in got if r.target == "hot"} == {1000} and len([r for r in got if r.target == "hot"]) == 10
    assert sorted(x.at for r in got if r.target == "hot" for x in r.refs) == list(range(1000))
    assert all([x.at for x in r.refs] == sorted(x.at for x in r.refs) for r in got)


def test_places_in_one_row(spark):
    from quire.operators import links

    n = 3 * links.PART
    t = spark.range(n).selectExpr("id * 5 AS page", "0 AS pos", "'hot' AS target").union(spark.sql("VALUES (-7L, 2, 'cold'), (-7L, 1, 'cold'), (20000L, 0, 'cold'), (NULL, 3, 'cold'), (NULL, 4, 'none'), (1L, 5, NULL)")).repartition(7)
    got = {r.target: (r.n_refs, r.places) for r in links.places(t, "target", ["page", "pos"]).collect()}
    assert got == {"hot": (n, " ".join(f"{5 * i}/0" for i in range(n))), "cold": (4, "-7/1 -7/2 20000/0"), "none": (1, None), None: (1, "1/5")}
    named = spark.createDataFrame([(1, "b", "x"), (1, "a", "x"), (2, "c", "x")], "book int, at string, target string")
    assert sorted(map(tuple, links.places(named, "target", ["at"], ["book"]).collect())) == [(1, "x", 2, "a b"), (2, "x", 1, "c")]


def test_page_text_index_of_a_frequent_link(spark, tmp_path):
    import __spark_entry__

    n = 12_000
    spark.range(n).selectExpr("id AS page_id", """'<a href="/hot">x</a>' AS html""").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = __spark_entry__.queries()["page_text_index"](spark, str(tmp_path)).collect()
    assert [(r.href, r.n_refs, r.places) for r in got] == [("/hot", n, " ".join(f"{i}/0" for i in range(n)))]


def test_anchored_patterns_of_any_length(spark):
    long = "".join(chr(97 + i % 26) for i in range(90))
    words = spark.createDataFrame([(1, "abcab"), (2, "abcab"), (2, "abcab"), (3, f"-{long}"), (4, ""), (5, None), (6, "ж\U0001f600ж")], "id int, word string")
    patterns = spark.createDataFrame([("ab", 1), ("ab", 2), (long, 3), ("", 4), (None, 5), ("\U0001f600ж", 6), ("c", 7)], "pattern string, value int")
    got = sorted((r.id, r.place, r.value) for r in language.anchored(words, "word", patterns, "pattern", "value").collect())
    abc = [(0, 1), (0, 2), (2, 7), (3, 1), (3, 2)]
    assert got == sorted([(i, *x) for i in (1, 2, 2) for x in abc] + [(3, 1, 3), (3, 1, 1), (3, 1, 2), (3, 3, 7), *((3, 1 + 26 * k, v) for k in (1, 2, 3) for v in (1, 2)), *((3, 3 + 26 * k, 7) for k in (1, 2, 3)), (6, 1, 6)])
    assert language.anchored(words, "word", patterns.limit(0), "pattern", "value").count() == 0


def test_languages(spark):
    t = spark.createDataFrame([(x,) for x in ("en", "EN_us", "zh-hant-tw", "Русский", " Deutsch ", "klingon tongue", "", None, "be-Tarask")], "t string")
    assert [r[0] for r in t.select(language.book_language(F.col("t"))).collect()] == ["en", "en-US", "zh-Hant-TW", "ru", "de", "und", "und", "und", "be-tarask"]
    t = spark.createDataFrame([(x,) for x in ("en-US", "en-GB", "de-AT", "uk", "xx")], "t string")
    assert [r[0] for r in t.select(language.model_for(F.col("t"), ["en-US", "en", "de-1996", "ru"], {"de": "de-1996", "uk": "ru"})).collect()] == ["en-US", "en", "de-1996", "ru", None]
    assert [r[0] for r in t.select(language.model_for(F.col("t"), [])).collect()] == [None] * 5


def test_settings():
    from quire import config

    assert config.load() == config.DEFAULTS and config.load("[pages]\nsize = 100")["pages"] == {"size": 100, "locations": 40}
    assert config.load('{"document": {"toc": {"shape": "flat"}}}', "json")["document"]["toc"] == {"shape": "flat", "levels": 6, "untitled": False}
    for bad in ("[pages]\nsiz = 1", "[pages]\nsize = 0", "[pages]\nsize = 'x'", "pages = 1", "[document.toc]\nshape = 'round'"):
        with pytest.raises(ValueError):
            config.load(bad)
    assert config.takes("kindle", "kfx") and not config.takes("kindle", "md") and not config.takes("none", "md")


def test_jpeg_quality(spark):
    from quire.functions import images

    def saved(quality):
        scale = 5000 / quality if quality < 50 else 200 - 2 * quality
        return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xdb\x00\x43\x00" + bytes(min(255, max(1, int((v * scale + 50) / 100))) for v in images.ZIGZAG) + b"\xff\xd9"

    assert images.ZIGZAG[:10] == [16, 11, 12, 14, 12, 10, 16, 14, 13, 14] and sorted(images.ZIGZAG) == sorted(x for row in images.BRIGHTNESS for x in row)
    for q in (30, 50, 75, 90, 100):
        assert abs(images.jpeg_quality_of(saved(q)) - q) <= 1
    df = spark.createDataFrame([(bytearray(saved(50)),), (bytearray(b"GIF89a"),), (None,), (bytearray(b"\xff\xd8\xff\xda\x00\x02"),)], "data binary")
    assert [r[0] for r in df.select(images.jpeg_quality(F.col("data"))).collect()] == [50, None, None, None]


def test_paths_of_more_nodes_than_the_row_limit(spark):
    from quire.operators import trees

    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        t = spark.range(1, 501).selectExpr("id", "CASE WHEN id > 1 THEN id DIV 2 END AS up", "'n' || id AS name")
        got = {r.id: (r.depth, r.path) for r in trees.paths(t, "id", "up", "name").collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert len(got) == 500 and got[1] == (0, "[n1]") and got[500] == (8, "[n1 -> n3 -> n7 -> n15 -> n31 -> n62 -> n125 -> n250 -> n500]")

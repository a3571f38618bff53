"""Style sheets: shorthands, inheritance, resolution of nested elements."""

from pyspark.sql import functions as F

from quire.sources import styles


def sheet(spark, css):
    return styles.rules(spark.createDataFrame([("s", css)], "sheet_id string, css string"))


def test_longhands(spark):
    t = styles.longhands(sheet(spark, "p { margin: 1em auto; border: 1px solid red; background: url(x) #fff no-repeat; color: blue } q { padding: 1px 2px 3px 4px; margin: auto }"))
    got = {(r.selector, r.property): r.value for r in t.collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "p"} == {"margin-top": "1em", "margin-right": "auto", "margin-bottom": "1em", "margin-left": "auto", "border-style": "solid", "border-color": "red", "border-width": "1px", "background-color": "#fff", "color": "blue"}
    assert got["q", "padding-left"] == "4px" and got["q", "margin-top"] == "0em" and got["q", "margin-left"] == "auto"
    boxes = {(r.selector, r.property): r.value for r in styles.aligned_boxes(t.select("selector", "property", "value"), ["selector"]).collect()}
    assert boxes["p", "box-align"] == boxes["q", "box-align"] == "center" and ("p", "margin-left") not in boxes


def test_breaks_and_selection(spark):
    css = sheet(spark, ".section-title-h2 { page-break-before: always } .section-title-h3 { page-break-before: always } .section-title-h3 { color: red } .section-title-h9 { page-break-before: always } .body-title { page-break-before: ALWAYS } .body-title { color: red } @media print { p { x: y } }")
    assert {(r.depth, r.breaks) for r in styles.page_breaks(css).collect()} == {(2, True), (3, False), (0, True)}
    assert styles.selected(css, "p").count() == 0 and styles.selected(css, ".body-title").count() == 2


def test_registry(spark):
    defs = spark.createDataFrame([(1, "a", "x", "1"), (2, "a", "x", "2"), (3, "a-first", "y", "3"), (4, "b", "x", "2"), (5, "my-subtitle", "z", "1"), (6, "subtitle", "w", "9"), (7, "poem-first", "p", "1"), (8, "poem", "q", "1"), (9, "b", "height", "auto")], "ord int, name string, property string, value string").withColumn("s", F.lit(1))
    one = styles.registered(defs, ["s"], "name", ["ord"])
    assert {(r.name, r.property): r.value for r in one.collect()}["a", "x"] == "2"
    parents = styles.inferred_parents(one.select("s", "name").distinct(), ["s"])
    assert {r.name: r.parent for r in parents.collect()} == {"a": None, "a-first": "a", "b": None, "my-subtitle": "subtitle", "subtitle": None, "poem-first": None, "poem": None}
    all_ = {(r.name, r.property): r.value for r in styles.inherited(one, parents, ["s"]).collect()}
    assert all_["a-first", "x"] == "2" and all_["my-subtitle", "w"] == "9" and ("poem-first", "q") not in all_
    circle = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "s int, name string, parent string")
    assert {(r.name, r.property): r.value for r in styles.inherited(one, circle, ["s"]).collect()}["a", "x"] == "2"
    keys = {r.name: r.style for r in styles.interned(one, ["s"], "name").collect()}
    assert keys["a"] == keys["b"] != keys["a-first"]
    assert styles.used(one, spark.createDataFrame([("a",), ("a",)], "name string"), ["name"]).count() == 1


def test_nested_elements(spark):
    css = sheet(spark, "p { color: black; margin: 1em } .big { font-size: 2em } div { font-size: 10px; margin: 0 } .note p { color: gray } div > p { text-indent: 1em } em { font-style: italic } p.big { color: red }")
    rows = [(1, 0, 9, "div", ["note"]), (1, 1, 4, "p", []), (1, 2, 3, "em", ["big"]), (1, 5, 9, "section", []), (1, 6, 6, "p", ["big"]), (2, 0, 0, "p", None)]
    t = styles.resolved(spark.createDataFrame(rows, "b int, seq long, last_seq long, element string, classes array<string>"), css, ["b"])
    got = {(r.b, r.seq): {x.property: x.value for x in r.properties} for r in t.collect()}
    assert got[1, 0] == {"font-size": "10px", "margin": "0"}
    assert got[1, 1] == {"font-size": "10px", "color": "gray", "margin": "1em", "text-indent": "1em"}
    assert got[1, 2] == {"font-size": "20px", "color": "gray", "text-indent": "1em", "font-style": "italic"}
    assert got[1, 6] == {"font-size": "20px", "color": "gray", "margin": "1em"} and got[2, 0] == {"color": "black", "margin": "1em"}
    delta = {(r.b, r.seq): {x.property for x in r.delta} for r in t.collect()}
    assert delta[1, 2] == {"font-size", "font-style"}


def test_spaces(spark):
    t = spark.createDataFrame([(1, 0, 5.0, 2.0), (1, 1, 3.0, -1.0), (1, 2, -4.0, 0.0)], "b int, at int, above double, below double")
    assert [r.space for r in styles.collapsed_blocks(t, ["b"], "at", "above", "below").orderBy("at").collect()] == [5.0, 3.0, -4.0]

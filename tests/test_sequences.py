"""Ordered operators on hot groups, nulls and empty tables."""

import random

from pyspark.sql import functions as F

from quire.operators import links, sequences, tables, trees


def test_prefix_sums_of_a_hot_group(spark):
    r = random.Random(4)
    rows = [(1, i, r.randrange(9)) for i in range(30_000)] + [(2, -5, 3), (2, None, 4), (2, 7, None), (None, 1, 5), (None, 2, 6)]
    df = spark.createDataFrame(rows, "g int, at long, n int")
    plan = sequences.prefix_sum(df, "n", ["g"], ["at"])
    got = {(x.g, x.at): x.start for x in plan.collect()}
    want, total = {}, {}
    for g, at, n in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0)):
        want[g, at] = total.get(g, 0)
        total[g] = total.get(g, 0) + (n or 0)
    assert got == want
    # windows over rows are those of blocks, not of whole groups
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.split("\n") if "Window [" in line]
    assert len(windows) == 2 and sum("__block" in line.split("], [")[1] for line in windows) == 1
    assert sequences.prefix_sum(df.limit(0), "n", ["g"], ["at"]).collect() == []


def test_ranks_in_two_levels(spark):
    r = random.Random(5)
    for values, kind in (([r.randrange(10**7) for _ in range(3000)], "long"), (["".join(r.choice("abc") for _ in range(r.randrange(1, 7))) for _ in range(3000)], "string")):
        got = {x[0]: x[1] for x in sequences.numbered(spark.createDataFrame([(v,) for v in values], f"v {kind}"), "v", "k").collect()}
        assert got == {v: i + 1 for i, v in enumerate(sorted(set(values)))}


def test_scan_keeps_rows_and_null_groups(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 1, "c"), (None, 2, None), (2, 1, "d")], "g int, at int, t string")

    def make():
        seen = []
        return lambda t: [("".join(seen), seen.append(t or "-"))[:1]]

    got = sorted(map(tuple, sequences.scan(df, ["g"], ["at"], ["t"], make, "before string").collect()), key=str)
    assert got == sorted([(1, 1, "a", ""), (1, 2, "b", "a"), (None, 1, "c", ""), (None, 2, None, "c"), (2, 1, "d", "")], key=str)
    assert sequences.scan(df.limit(0), ["g"], ["at"], ["t"], make, "before string").collect() == []


def test_pages_run_on_through_texts(spark):
    r = random.Random(6)
    rows = [(1, i, "".join(r.choice("ab ,x") for _ in range(r.randrange(0, 60))), r.random() < 0.2) for i in range(60)]
    got = sequences.page_flow(spark.createDataFrame(rows, "b int, at int, t string, new boolean").withColumnRenamed("at", "k"), "t", 25, ["b"], ["k"], "new").orderBy("k", "at").collect()
    by = {}
    for x in got:
        by.setdefault(x.k, []).append(x)
    used, page = 0, 0
    for _, k, t, new in rows:
        if new:
            used, page = 0, page + 1
        assert "".join(t[x["at"] : x["at"] + x.n_chars] for x in by.get(k, [])) == t
        for x in by.get(k, []):
            assert x.page == page and 0 < x.n_chars <= 25
            page += x.marked
    assert sum(x.marked for x in got) > 20 and used == 0


def test_spans_and_gaps(spark):
    spans = spark.createDataFrame([(1, 3, 5), (1, 7, 9), (2, 0, 4), (2, 2, 8), (3, 1, 2)], "g int, a int, b int")
    totals = spark.createDataFrame([(1, 12), (2, 8), (3, 0), (4, 5)], "g int, n int")
    got = sequences.gaps(spans, totals, "a", "b", ["g"], "n").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 3), (1, 5, 7), (1, 9, 12), (4, 0, 5)]


def test_trees(spark):
    nodes = spark.createDataFrame([(1, 0, 9, "r"), (1, 1, 4, "a"), (1, 2, 2, "t"), (1, 3, 3, "u"), (1, 5, 9, "a"), (1, 6, 6, "v"), (2, 0, 0, "a")], "b int, seq long, last_seq long, kind string")
    inside = {(x.b, x.seq): x.inside for x in trees.enclosing(nodes, ["b"], F.col("kind") == "a").collect()}
    assert inside == {(1, 0): None, (1, 1): None, (1, 2): 1, (1, 3): 1, (1, 5): None, (1, 6): 5, (2, 0): None}
    text = trees.subtree_text(nodes.where("kind IN ('t', 'u', 'v')").select("b", "seq", F.col("kind").alias("text")), nodes.where("kind IN ('r', 'a')"), ["b"], "+")
    assert sorted(map(tuple, text.collect())) == [(1, 0, "t+u+v"), (1, 1, "t+u"), (1, 5, "v")]
    ids = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "a", "a-1", "a", "b"])], "g int, at int, id string")
    assert [x.unique_id for x in trees.unique_ids(ids, "id", ["g"], ["at"]).orderBy("at").collect()] == ["a", "a-1", "a-1-1", "a-2", "b"]


def test_cells_with_spans(spark):
    rows = [(1, 0, 0, 2, 1), (1, 0, 1, 1, 3), (1, 1, 0, 1, 1), (1, 1, 1, 1, 1), (1, 2, 0, 1, 1), (1, 2, 1, 1, 1), (1, 2, 2, 1, 1)]
    t = tables.placed_cells(spark.createDataFrame(rows, "t int, row int, col int, colspan int, rowspan int"), ["t"])
    assert [x.grid_col for x in t.orderBy("row", "col").collect()] == [0, 2, 0, 1, 0, 1, 3]
    assert tables.column_count(t, ["t"]).first().columns == 4
    w = tables.fitted_widths(t.withColumn("need", F.when(F.col("colspan") == 2, 10.0).otherwise(2.0)), ["t"], "need", 40.0).first()
    assert w.scale == 1 and w.widths == [5 + 6.5, 5 + 6.5, 2 + 6.5, 2 + 6.5]


def test_note_queue_and_pictures(spark):
    refs = spark.createDataFrame([(1, "b", 3), (1, "a", 5), (1, "b", 9), (2, "z", 1)], "g int, target string, seq int")
    nested = spark.createDataFrame([(1, "a", "c", 2), (1, "c", "d", 1), (1, "d", "a", 1), (1, "b", "e", 7), (2, "y", "x", 1)], "g int, source string, target string, seq int")
    q = sequences.reading_queue(refs, nested, ["g"], "source", "target", ["seq"])
    assert sorted((x.g, x.n, x.target, x.round) for x in q.collect()) == [(1, 1, "b", 0), (1, 2, "a", 0), (1, 3, "e", 1), (1, 4, "c", 1), (1, 5, "d", 2), (2, 1, "z", 0)]
    ids = spark.createDataFrame([("b", "not-found-0"), ("b", "not-found-1"), ("b", "x"), ("c", "y")], "book_id string, xml_id string")
    none = spark.createDataFrame([("c", "not-found-0")], "book_id string, id string")
    broken = spark.createDataFrame([("b", 1, "#gone"), ("c", 2, "#gone"), ("b", 3, "#too")], "book_id string, seq int, href string")
    pointed, new = links.missing_images(none, ids, broken)
    assert sorted((x.book_id, x.seq, x.href) for x in pointed.collect()) == [("b", 1, "#not-found-2"), ("b", 3, "#not-found-2"), ("c", 2, "#not-found-1")]
    assert sorted((x.book_id, x.id) for x in new.collect()) == [("b", "not-found-2"), ("c", "not-found-1")]

"""Queries of functions and small operators over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language, text, values
from ..operators import links, sequences, tables, trees
from ..sources import styles
from .catalogue import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]


def _parts(spark, d):
    return table(spark, d, "part")


UNITS = "(['em', 'percent', 'px', 'em', NULL])[p_partkey % 5 + 1]"
#: Two style values for each part: measures of several units, plain numbers.
PAIR = f"SELECT p_partkey, p_size::DOUBLE AS a, {UNITS} AS au, (p_partkey % 50)::DOUBLE AS b, {UNITS.replace('p_partkey', '(p_partkey // 5)')} AS bu FROM part"


def _pair(spark, d):
    unit = lambda c: F.element_at(F.array(*map(F.lit, ("em", "percent", "px", "em", None))), (c % 5 + 1).cast("int"))
    k = F.col("p_partkey")
    return _parts(spark, d).select("p_partkey", values.measure(F.col("p_size"), unit(k)).alias("x"), values.measure(k % 50, unit(F.floor(k / 5))).alias("y"))


def _merged(spark, d, rule):
    t = _pair(spark, d).select("p_partkey", values.merged_value(F.lit(rule), F.col("x"), F.col("y")).alias("m"))
    return t.select("p_partkey", "m.value", "m.unit")


@query(f"SELECT p_partkey, CASE WHEN au IS NOT DISTINCT FROM bu THEN a + b ELSE b END AS value, bu AS unit FROM ({PAIR})")
def merge_cumulative(spark, d):
    return _merged(spark, d, "cumulative")


@query(
    f"""SELECT p_partkey, CASE WHEN au IS NULL OR bu IS NULL THEN b WHEN bu = 'percent' THEN a * b / 100 WHEN bu = 'em' THEN a * b ELSE b END AS value,
    CASE WHEN au IS NOT NULL AND bu IN ('percent', 'em') THEN au ELSE bu END AS unit FROM ({PAIR})"""
)
def merge_relative(spark, d):
    return _merged(spark, d, "relative")


@query(f"SELECT p_partkey, CASE WHEN au IS NOT DISTINCT FROM bu AND a > b THEN a ELSE b END AS value, bu AS unit FROM ({PAIR})")
def merge_maximum(spark, d):
    return _merged(spark, d, "override-maximum")


@query(f"SELECT p_partkey, b AS value, bu AS unit FROM ({PAIR})")
def merge_override(spark, d):
    return _merged(spark, d, "no such rule")


WORDS = ("repeat", "repeat_x", "no_repeat", "normal", "left", "right")


def _words(spark, d, rule):
    pick = lambda c: values.word(F.element_at(F.array(*map(F.lit, WORDS)), (c % 6 + 1).cast("int")))
    k = F.col("p_partkey")
    return _parts(spark, d).select("p_partkey", values.merged_value(F.lit(rule), pick(k), pick(F.floor(k / 6))).word.alias("word"))


WORD_PAIR = f"SELECT p_partkey, ({list(WORDS)})[p_partkey % 6 + 1] AS a, ({list(WORDS)})[(p_partkey // 6) % 6 + 1] AS b FROM part"


@query(f"SELECT p_partkey, CASE WHEN b = 'normal' AND a <> 'normal' THEN a ELSE b END AS word FROM ({WORD_PAIR})")
def merge_baseline(spark, d):
    return _words(spark, d, "baseline-style")


@query(f"SELECT p_partkey, CASE WHEN a <> b THEN 'both' ELSE b END AS word FROM ({WORD_PAIR})")
def merge_horizontal(spark, d):
    return _words(spark, d, "horizontal-position")


RANK = "CASE {} WHEN 'repeat' THEN 3 WHEN 'repeat_x' THEN 2 WHEN 'no_repeat' THEN 1 ELSE 0 END"


@query(f"SELECT p_partkey, CASE WHEN {RANK.format('a')} >= {RANK.format('b')} THEN a ELSE b END AS word FROM ({WORD_PAIR})")
def merge_repeat(spark, d):
    return _words(spark, d, "background-repeat")


@query("SELECT p_partkey, list_distinct_in_order AS items FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ['a', p_brand, 'z'] ELSE ['a', p_brand, 'b', 'z'] END AS list_distinct_in_order FROM part)")
def merge_lists(spark, d):
    listed = lambda *c: F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("word"), F.array(*c).alias("list"))
    new = F.when(F.col("p_partkey") % 2 == 0, listed(F.lit("a"), F.lit("z"))).otherwise(listed(F.lit("b"), F.lit("a"), F.lit("z")))
    t = _parts(spark, d).select("p_partkey", values.merged_value(F.lit("cumulative"), listed(F.lit("a"), F.col("p_brand")), new).alias("m"))
    return t.select("p_partkey", F.col("m.list").alias("items"))


@query("SELECT p_partkey, (['em', 'em', 'percent', 'px', NULL])[p_partkey % 5 + 1] AS unit FROM part")
def model_units(spark, d):
    css = F.element_at(F.array(*map(F.lit, ("em", "ex", "%", "px", "furlong"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return _parts(spark, d).select("p_partkey", values.model_unit(css).alias("unit"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 5 > 0 THEN p_size * 72.0::DOUBLE / (p_partkey % 7 * 50) END AS width,
    CASE WHEN p_partkey % 5 = 0 THEN 'invalid height: 0' WHEN p_partkey % 7 = 0 THEN 'invalid dpi: 0' END AS error FROM part"""
)
def page_points(spark, d):
    k = F.col("p_partkey")
    t = _parts(spark, d).select("p_partkey", values.page_points(F.col("p_size"), k % 5, k % 7 * 50).alias("p"))
    return t.select("p_partkey", "p.width", "p.error")


@query("SELECT p_partkey, CASE WHEN n <= 0 THEN 300 WHEN n > 32767 THEN 32767 ELSE n END::INT AS density FROM (SELECT p_partkey, ((p_partkey - 10) * 100)::INT AS n FROM part)")
def jpeg_densities(spark, d):
    return _parts(spark, d).select("p_partkey", values.jpeg_density(((F.col("p_partkey") - 10) * 100).cast("int")).alias("density"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'solid' END AS line, CASE WHEN p_size % 4 = 0 THEN '#ff0000' END AS color,
    (p_size % 5) || 'px' AS width FROM part"""
)
def border_shorthand(spark, d):
    n = F.col("p_size")
    raw = F.concat_ws(" ", F.concat((n % 5).cast("string"), F.lit("px")), F.when(n % 3 != 0, "Dotted SOLID"), F.when(n % 4 == 0, "#FF0000"), F.lit("what"))
    t = _parts(spark, d).select("p_partkey", values.border_parts(raw).alias("b"))
    return t.select("p_partkey", "b.line", "b.color", "b.width")


@query(
    """WITH s AS (SELECT p_partkey, string_split(replace((['@px', '@px auto', '1em auto @px', 'auto 2px 3px auto'])[p_partkey % 4 + 1], '@', p_size::VARCHAR), ' ') AS p FROM part),
    b AS (SELECT p_partkey, p[1] AS t, coalesce(p[2], p[1]) AS r, coalesce(p[3], p[1]) AS b, coalesce(p[4], p[2], p[1]) AS l FROM s)
    SELECT p_partkey, CASE WHEN t = 'auto' THEN '0em' ELSE t END AS top, nullif(r, 'auto') AS right, CASE WHEN b = 'auto' THEN '0em' ELSE b END AS bottom, nullif(l, 'auto') AS left,
      CASE WHEN l = 'auto' AND r = 'auto' THEN 'center' WHEN l = 'auto' THEN 'right' WHEN r = 'auto' THEN 'left' END AS align FROM b"""
)
def margin_sides(spark, d):
    raw = F.replace(F.element_at(F.array(*map(F.lit, ("@px", "@px auto", "1em auto @px", "auto 2px 3px auto"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit("@"), F.col("p_size").cast("string"))
    t = _parts(spark, d).select("p_partkey", values.auto_margins(values.box_sides(raw), F.lit(None).cast("string")).alias("m"))
    return t.select("p_partkey", "m.*")


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '&', 'and'), '[^a-z0-9_-]+', '-', 'g') AS slug FROM part")
def slugs(spark, d):
    return _parts(spark, d).select("p_partkey", text.slug(F.concat(F.lit(" \""), F.col("p_name"), F.lit(" & "), F.col("p_brand"), F.lit("!-"))).alias("slug"))


@query("SELECT p_partkey, chr(34) || replace(replace(p_name || chr(9) || chr(92) || p_brand, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't') || chr(34) AS quoted FROM part")
def quoted_scalars(spark, d):
    return _parts(spark, d).select("p_partkey", text.quoted(F.concat("p_name", F.lit("\t\\"), "p_brand")).alias("quoted"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || '. ' || p_type WHEN 1 THEN p_name || '. ' || p_type WHEN 2 THEN 'pic' ELSE p_brand END AS title FROM part")
def toc_titles(spark, d):
    n = F.col("p_size") % 4
    pieces = F.when(n == 0, F.array("p_name", F.lit(" "), "p_type")).when(n == 1, F.array(F.concat("p_name", F.lit(".")), "p_type")).otherwise(F.array(F.lit("")))
    alts = F.when(n == 2, F.array(F.lit("pic"), F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    return _parts(spark, d).select("p_partkey", text.toc_title(pieces, alts, F.col("p_brand")).alias("title"))


@query("SELECT p_partkey, (['c.png', 'b.otf', '', 'style'])[p_partkey % 4 + 1] AS file FROM part")
def resource_files(spark, d):
    url = F.element_at(F.array(*map(F.lit, ("../../a/c.png", "#/x/b.otf", "..", "/style"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _parts(spark, d).select("p_partkey", text.resource_filename(url).alias("file"))


TYPES = ("font/ttf", "application/x-font-otf", "image/svg+xml", "image/JPEG", "text/css")


@query(
    f"""SELECT p_partkey, (['.ttf', '.otf', '.svg', '', ''])[k] AS ending, (['img', 'img', 'svg', 'jpg', 'img'])[k] AS image_ending, k IN (1, 2) AS font, k IN (3, 4) AS image
    FROM (SELECT p_partkey, (p_partkey % 5 + 1)::INT AS k FROM part)"""
)
def mime_types(spark, d):
    mime = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return _parts(spark, d).select("p_partkey", text.resource_ending(mime).alias("ending"), text.image_ending(mime).alias("image_ending"), text.is_font_type(mime).alias("font"), text.is_image_type(mime).alias("image"))


@query(
    """WITH h AS (SELECT p_partkey, sha256(p_name) AS h FROM part)
    SELECT p_partkey, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', (('0x' || substr(h, 2 * (i % 32) + 1, 2))::BIGINT % 36 + 1)::INT, 1) for i in range(35)], '') AS name FROM h"""
)
def hashed_names(spark, d):
    return _parts(spark, d).select("p_partkey", text.hashed_name(F.col("p_name"), 35).alias("name"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['a' || p_size || '.png', 'b.ttf'] ELSE ['a' || p_size || '.png'] END AS urls,
    'x url("/r/a' || p_size || '.png") y' || CASE WHEN p_size % 2 = 0 THEN ', url("/r/b.ttf")' ELSE '' END AS value FROM part"""
)
def style_urls(spark, d):
    raw = F.concat(F.lit("x url( 'a"), F.col("p_size").cast("string"), F.lit(".png' ) y"), F.when(F.col("p_size") % 2 == 0, ", url(b.ttf )").otherwise(""))
    return _parts(spark, d).select("p_partkey", text.css_urls(raw).alias("urls"), text.rewritten_urls(raw, lambda u: F.concat(F.lit("/r/"), u)).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '_bad_file_name_' ELSE replace(p_brand, '#', '') END || '.txt' AS file FROM part")
def file_names(spark, d):
    source = F.when(F.col("p_partkey") % 3 == 0, "/a.b/...x").otherwise(F.concat(F.lit("in/.:"), F.replace("p_brand", F.lit("#")), F.lit(".fb2")))
    return _parts(spark, d).select("p_partkey", text.default_file_name(source, ".txt").alias("file"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'f.png' ELSE p_brand END AS label, upper(p_brand) = p_brand AS upper FROM part")
def picture_labels(spark, d):
    return _parts(spark, d).select("p_partkey", text.image_label(F.concat(F.lit(" #"), "p_brand"), F.when(F.col("p_size") % 2 == 0, "f.png").otherwise(" ")).alias("label"), text.is_upper(F.col("p_brand")).alias("upper"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'spring' END AS date FROM orders")
def date_texts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", values.date_text(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")), F.lit(" spring ")).alias("date"))


CELLS = "SELECT l_orderkey, (l_linenumber - 1) // 3 AS r, (l_linenumber - 1) % 3 AS c, l_returnflag || l_quantity::INT AS t FROM (SELECT l_orderkey, l_quantity, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS l_linenumber FROM lineitem)"


def _cells(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    t = table(spark, d, "lineitem").select("l_orderkey", k.alias("k"), F.concat("l_returnflag", F.col("l_quantity").cast("int").cast("string")).alias("t"))
    return t.select("l_orderkey", F.floor(F.col("k") / 3).alias("row"), (F.col("k") % 3).alias("col"), "t")


@query(
    f"""WITH c AS ({CELLS}), w AS (SELECT l_orderkey, max(c) + 1 AS n FROM c GROUP BY l_orderkey),
    l AS (SELECT l_orderkey, r, n, '| ' || string_agg(t, ' | ' ORDER BY c) || repeat(' | ', (n - count(*))::INT) || ' |' AS line FROM c JOIN w USING (l_orderkey) GROUP BY l_orderkey, r, n)
    SELECT l_orderkey, string_agg(CASE WHEN r = 0 THEN line || chr(10) || '|' || repeat(' --- |', n::INT) ELSE line END, chr(10) ORDER BY r) AS content FROM l GROUP BY l_orderkey"""
)
def pipe_tables(spark, d):
    return tables.piped(_cells(spark, d), ["l_orderkey"], "t")


@query(
    f"""WITH c AS ({CELLS}), w AS (SELECT l_orderkey, c, max(length(t))::INT AS n FROM c GROUP BY l_orderkey, c),
    l AS (SELECT l_orderkey, r, rtrim(string_agg(rpad(t, n, ' '), '  ' ORDER BY c)) AS line FROM c JOIN w USING (l_orderkey, c) GROUP BY l_orderkey, r)
    SELECT l_orderkey, string_agg(line, chr(10) ORDER BY r) AS content FROM l GROUP BY l_orderkey"""
)
def aligned_tables(spark, d):
    return tables.aligned(_cells(spark, d), ["l_orderkey"], "t")


@query(f"WITH c AS ({CELLS}), n AS (SELECT l_orderkey, r, count(*) AS n FROM c GROUP BY ALL) SELECT l_orderkey, max(n)::BIGINT AS columns FROM n GROUP BY l_orderkey")
def most_cells(spark, d):
    return tables.most_cells(_cells(spark, d), ["l_orderkey"])


@query(
    f"""WITH c AS ({CELLS}), a AS (SELECT l_orderkey, r, c, CASE WHEN r = 0 AND c = 0 THEN 2 ELSE 1 END AS wide, CASE WHEN r = 0 AND c = 0 THEN 2 ELSE 1 END AS high FROM c)
    SELECT l_orderkey, r AS row, c AS col, (CASE WHEN r = 0 AND c = 0 THEN 0 WHEN r = 0 THEN c + 1 WHEN r = 1 THEN c + 2 ELSE c END)::INT AS grid_col FROM a"""
)
def placed_cells(spark, d):
    corner = F.when((F.col("row") == 0) & (F.col("col") == 0), 2).otherwise(1)
    t = _cells(spark, d).withColumn("colspan", corner).withColumn("rowspan", corner)
    return tables.placed_cells(t, ["l_orderkey"]).select("l_orderkey", "row", "col", "grid_col")


@query(
    """WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS k FROM events)
    SELECT event_id, CASE WHEN k = 0 THEN event_type ELSE event_type || '-' || k END AS unique_id FROM r"""
)
def unique_ids(spark, d):
    return trees.unique_ids(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_type", ["user_id"], ["event_id"]).select("event_id", "unique_id")


@query("SELECT p_partkey, CASE WHEN p_partkey >= 4 THEN (p_partkey // 4)::BIGINT END AS parent, (length(bin(p_partkey)) + 1) // 2 AS level FROM part WHERE length(bin(p_partkey)) % 2 = 1")
def promoted_entries(spark, d):
    keep = F.length(F.bin("p_partkey")) % 2 == 1
    t = _parts(spark, d).select(F.lit(1).alias("b"), "p_partkey", F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"), keep.alias("keep"))
    return trees.promoted(t, ["b"], "p_partkey", "parent", "keep").select("p_partkey", "parent", F.col("level").cast("long").alias("level"))


@query(
    """WITH e AS (SELECT conv_id, turn, role, (turn // 8) AS up FROM conversations)
    SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN coalesce((SELECT max(b.turn) FROM e b WHERE b.conv_id = e.conv_id AND b.up = e.up AND b.turn < e.turn AND b.role <> 'assistant'), up) ELSE up END AS up FROM e"""
)
def attached_entries(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 8).alias("up"), (F.col("role") != "assistant").alias("titled"))
    return trees.attached(t, ["conv_id"], "turn", "up", "titled").select("conv_id", "turn", "up")


@query(
    """WITH i AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents WHERE lang <> 'en'), f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM i WHERE k = 1)
    SELECT lang, source, 'images/img' || lpad(n::VARCHAR, 5, '0') || '.png' AS file FROM f"""
)
def picture_files(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang", "source", F.when(F.col("lang") != "en", "image/png").otherwise("text/plain").alias("mime"))
    return links.file_numbers(t, ["lang"], "source", "mime", ["doc_id"]).select("lang", "source", "file")


@query(
    """WITH f AS (SELECT user_id, (event_id // 500) AS page, event_type, min(event_id) AS begins FROM events GROUP BY ALL)
    SELECT event_id, rk::BIGINT AS label FROM events e JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, page ORDER BY begins) AS rk FROM f) f ON e.user_id = f.user_id AND e.event_id // 500 = f.page AND e.event_type = f.event_type"""
)
def labels_by_page(spark, d):
    t = table(spark, d, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 500).alias("page"), "event_type")
    return sequences.page_labels(t, ["user_id"], "page", "event_type", ["event_id"]).select("event_id", F.col("label").cast("long").alias("label"))


@query(
    """WITH p AS (SELECT conv_id, turn, greatest(length(text) - 300, 0) AS n, sum(greatest(length(text) - 300, 1)) OVER (PARTITION BY conv_id ORDER BY turn) - greatest(length(text) - 300, 1) AS pid FROM conversations),
    r AS (SELECT conv_id, turn, (pid + greatest(0, least(turn * 50 - 20, greatest(n, 1) - 1)))::BIGINT AS pid FROM p)
    SELECT conv_id, turn, pid, (SELECT max(p.turn) FROM p WHERE p.conv_id = r.conv_id AND p.pid <= r.pid) AS page, (pid // 40 + 1)::BIGINT AS location FROM r"""
)
def backlink_locations(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.greatest(F.length("text") - 300, F.lit(0)).alias("n"))
    index = links.position_index(t, ["conv_id"], "turn", "n", ["turn"])
    refs = links.positions_of(t.select("conv_id", "turn", (F.col("turn") * 50 - 20).alias("at")), index, ["conv_id"], "turn", "at")
    pages = index.select("conv_id", "pid", F.col("turn").alias("page"))
    return links.located(refs, pages, ["conv_id"]).select("conv_id", "turn", "pid", "page", "location")


@query("SELECT event_id FROM events WHERE NOT (event_id % 7 = event_id % 5 AND event_id % 7 > 0)")
def visible_backlinks(spark, d):
    t = table(spark, d, "events").select("user_id", "event_id")
    page = lambda n: t.select("user_id", "event_id", (F.col("event_id") % n).alias("page")).union(t.select("user_id", "event_id", F.lit(99)))
    return links.shown_backlinks(t, page(7), page(5), ["user_id"], "event_id").select("event_id")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'even' WHEN p_size % 3 = 0 THEN 'third' END AS content FROM part")
def pseudo_contents(spark, d):
    known = spark.createDataFrame([("c3", "third"), ("c2", "even"), ("no", "x")], "class string, content string")
    n = F.col("p_size")
    classes = F.array_compact(F.array(F.lit("c0"), F.when(n % 2 == 0, "c2"), F.when(n % 3 == 0, "c3")))
    return links.first_with(_parts(spark, d).select("p_partkey", classes.alias("classes")), known, "classes", "class", "content").select("p_partkey", "content")


@query(
    """WITH u AS (SELECT p_brand, l_returnflag = 'R' AS event, l_linenumber, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    SELECT p_brand, coalesce(sum(n) FILTER (WHERE NOT event), 0)::BIGINT AS n_direct, coalesce(sum(n) FILTER (WHERE event), 0)::BIGINT AS n_event,
      coalesce(list(l_linenumber ORDER BY l_linenumber) FILTER (WHERE NOT event), []) AS direct, coalesce(list(l_linenumber ORDER BY l_linenumber) FILTER (WHERE event), []) AS events FROM u GROUP BY p_brand"""
)
def style_uses(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber", F.when(F.col("l_returnflag") == "R", "event").otherwise("direct").alias("kind"))
    return links.usage(items.join(_parts(spark, d).select("p_partkey", "p_brand"), "p_partkey"), "p_brand", "l_linenumber", "kind")


@query("SELECT DISTINCT p_type AS name FROM part WHERE p_type NOT LIKE '%BRASS'")
def local_names(spark, d):
    known = _parts(spark, d).where("p_type LIKE '%BRASS'").select(F.col("p_type").alias("name"))
    return links.unlisted(_parts(spark, d).select(F.col("p_type").alias("name")), "name", known)


@query("SELECT s_suppkey, s_name FROM supplier")
def used_or_all(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return links.kept_or_all(t, t.where("s_suppkey < 0").select("s_suppkey"), ["s_suppkey"])


@query(
    """WITH s AS (SELECT user_id, event_id // 4 AS a, event_id % 3 AS n, event_type AS style, CASE WHEN event_id % 5 = 0 THEN '#x' || event_id END AS link FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, a, n ORDER BY link IS NULL, length(style) DESC, style, link) AS k FROM s)
    SELECT user_id, a, n, style, link, row_number() OVER (PARTITION BY user_id ORDER BY a, n DESC)::INT AS ord FROM r WHERE k = 1"""
)
def outer_spans(spark, d):
    e = F.col("event_id")
    t = table(spark, d, "events").select("user_id", F.floor(e / 4).alias("a"), (e % 3).alias("len"), F.col("event_type").alias("style"), F.when(e % 5 == 0, F.concat(F.lit("#x"), e.cast("string"))).alias("link"))
    return sequences.outer_spans(t, "a", "len", "style", "link", ["user_id"]).select("user_id", "a", F.col("n").alias("ord"), F.col("len").alias("n"), "style", "link")


@query(
    """WITH w AS (SELECT conv_id, turn, unnest(range(len(string_split(text, '. ')))) + 1 AS s FROM conversations)
    SELECT conv_id, turn, s AS sentence_no, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS paragraph_no FROM w"""
)
def span_ordinals(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "[.] ")).alias("at", "sentence"))
    t = sequences.ordinals(t, ["conv_id"], "turn", ["at"])
    return t.select("conv_id", "turn", F.col("sentence_no").cast("long").alias("sentence_no"), "paragraph_no")


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, regexp_replace(text, '[^a-z]', 'x', 'g') AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    n AS (SELECT conv_id, turn, k, length(s) AS n, (sum(length(s)) OVER (PARTITION BY conv_id ORDER BY k) - length(s))::BIGINT AS before FROM t),
    c AS (SELECT conv_id, turn, before, n, unnest(range(before // 500, (before + n + 499) // 500)) AS page FROM n WHERE n > 0)
    SELECT conv_id, turn, page::BIGINT AS page, (greatest(page * 500, before) - before)::BIGINT AS "at", (least((page + 1) * 500, before + n) - greatest(page * 500, before))::BIGINT AS n_chars, (page + 1) * 500 <= before + n AS marked FROM c"""
)
def page_flow(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^a-z]", "x").alias("s"))
    return sequences.page_flow(t, "s", 500, ["conv_id"], ["turn"]).select("conv_id", "turn", "page", "at", "n_chars", "marked")


@query(
    """WITH t AS (SELECT conv_id, turn, length(text) AS n, sum((turn % 4 = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM conversations),
    s AS (SELECT conv_id, turn, part, n, (sum(n) OVER (PARTITION BY conv_id, part ORDER BY turn) - n)::BIGINT AS before FROM t),
    p AS (SELECT conv_id, part, ((sum(n) + 499) // 500)::BIGINT AS pages FROM s GROUP BY ALL), b AS (SELECT conv_id, part, (sum(pages) OVER (PARTITION BY conv_id ORDER BY part) - pages)::BIGINT AS earlier FROM p),
    e AS (SELECT conv_id, turn, part, before, unnest(range(((before + 499) // 500) * 500, before + n, 500)) AS begins FROM s)
    SELECT conv_id, turn, (begins - before)::BIGINT AS "offset", (earlier + begins // 500 + 1)::BIGINT AS page FROM e JOIN b USING (conv_id, part)"""
)
def page_starts(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", "(?s).", "x").alias("s"), (F.col("turn") % 4 == 0).alias("new"), F.lit(None).cast("long").alias("n"))
    return sequences.approximate_pages(t, "s", "n", "new", 500, ["conv_id"], ["turn"])


@query(
    f"""WITH c AS ({CELLS}), n AS (SELECT l_orderkey, max(c) + 1 AS k FROM c GROUP BY l_orderkey), w AS (SELECT l_orderkey, c, max(length(t))::DOUBLE AS w FROM c GROUP BY ALL),
    s AS (SELECT l_orderkey, sum(w) AS total FROM w GROUP BY l_orderkey)
    SELECT l_orderkey, round(least(5 / total, 1), 9) AS scale, list(round(CASE WHEN total > 5 THEN w * 5 / total ELSE w + (5 - total) / k END, 9) ORDER BY c) AS widths FROM w JOIN n USING (l_orderkey) JOIN s USING (l_orderkey) GROUP BY ALL"""
)
def fitted_widths(spark, d):
    t = tables.placed_cells(_cells(spark, d).withColumn("colspan", F.lit(1)).withColumn("rowspan", F.lit(1)), ["l_orderkey"])
    t = tables.fitted_widths(t.withColumn("need", F.length("t")), ["l_orderkey"], "need", 5.0)
    return t.select("l_orderkey", F.round("scale", 9).alias("scale"), F.transform("widths", lambda x: F.round(x, 9)).alias("widths"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'embedded' WHEN 1 THEN 'file' END AS kind, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 8 = 0 THEN 'fonts/' ELSE 'other/' END || 'r' || p_partkey WHEN 1 THEN 'a.css' END AS file FROM part"""
)
def style_resources(spark, d):
    k = F.col("p_partkey")
    own = F.concat(F.lit("#r"), k.cast("string"))
    url = F.when(k % 4 == 0, own).when(k % 4 == 1, "x/a.css").when(k % 4 == 2, "../a.css").otherwise(own)
    urls = _parts(spark, d).select("p_partkey", url.alias("url"))
    binaries = _parts(spark, d).where("p_partkey % 4 = 0").select("p_partkey", F.concat(F.lit("r"), k.cast("string")).alias("id"), F.when(k % 8 == 0, "font/ttf").otherwise("image/png").alias("mime"))
    return links.resources(urls, binaries, ["p_partkey"]).select("p_partkey", "kind", "file")


@query(
    """SELECT p_partkey, 'a' || CASE WHEN p_size % 2 = 0 THEN 'p' ELSE '' END AS to_property, CASE WHEN p_size % 3 = 0 THEN 'three' ELSE p_size || 'px' END AS value
    FROM part WHERE p_size % 2 = 0 OR p_size % 3 = 0 OR p_brand <> 'Brand#11'"""
)
def style_conversions(spark, d):
    css = _parts(spark, d).select("p_partkey", F.when(F.col("p_size") % 2 == 0, "p").alias("element"), F.lit("width").alias("property"), F.concat(F.col("p_size").cast("string"), F.lit("px")).alias("value"), F.when((F.col("p_size") % 2 == 0) | (F.col("p_size") % 3 == 0) | (F.col("p_brand") != "Brand#11"), "px").otherwise("q").alias("unit"))
    three = _parts(spark, d).select("p_size").distinct().where("p_size % 3 = 0").select(F.concat(F.col("p_size").cast("string"), F.lit("px")).alias("v"))
    entry = lambda t, tag, value, to, made: t.select(F.lit(tag).alias("tag"), F.lit("width").alias("attr"), value.alias("value"), F.lit("px").alias("unit"), F.lit(to).alias("to_property"), F.lit(made).cast("string").alias("to_value"))
    one = spark.range(1)
    conversions = entry(one, "", F.lit(""), "a", None).union(entry(one, "p", F.lit(""), "ap", None)).union(entry(three, "", F.col("v"), "a", "three")).union(entry(three, "p", F.col("v"), "ap", "three"))
    return styles.mapped(css, conversions, ["p_partkey"]).select("p_partkey", "to_property", "value")


@query(
    """WITH w AS (SELECT p_partkey, p_brand, unnest(range(length(p_brand))) AS place FROM part), s AS (SELECT *, unnest(range(1, length(p_brand) - place + 1)) AS n FROM w), p AS (SELECT DISTINCT substr(p_brand, 6) AS pattern FROM part UNION SELECT 'Br' UNION SELECT 'ran')
    SELECT p_partkey, place::INT AS place, pattern, length(pattern)::INT AS value FROM s JOIN p ON substr(p_brand, place + 1, n) = pattern"""
)
def anchored_patterns(spark, d):
    p = _parts(spark, d)
    patterns = p.select(F.substring("p_brand", 6, 20).alias("pattern")).union(spark.createDataFrame([("Br",), ("ran",)], "pattern string")).distinct().withColumn("value", F.length("pattern"))
    return language.anchored(p.select("p_partkey", "p_brand"), "p_brand", patterns, "pattern", "value").select("p_partkey", "place", "pattern", "value")


@query("SELECT p_partkey, p_type AS property FROM part WHERE NOT (p_size % 2 = 0 AND p_type LIKE '%BRASS')")
def ignored_styles(spark, d):
    p = _parts(spark, d)
    css = p.select("p_partkey", F.lit(None).cast("string").alias("element"), F.col("p_type").alias("property"), (F.col("p_size") % 2).cast("string").alias("value"), F.lit(None).cast("string").alias("unit"))
    known = [r[0] for r in p.where("p_type NOT LIKE '%BRASS'").select("p_type").distinct().collect()]
    patterns = spark.createDataFrame([("*", "*", "0", "*")], "tag string, style string, value string, unit string")
    return styles.ignorable(css, known, patterns).select("p_partkey", "property")

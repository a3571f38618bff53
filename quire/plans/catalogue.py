"""One query for each operator family over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import language, text, values
from ..operators import links, sequences, trees
from ..sinks import render
from ..sources import books as book_source
from ..sources import styles
from ..streaming import ingest
from . import books

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: White space for DuckDB's regular expressions.
W = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
N = "[^" + W[1:]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


HREF_SQL = "SELECT page_id, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1) AS hrefs FROM pages)"


@query(f"WITH l AS ({HREF_SQL}) SELECT href, count(*)::BIGINT AS n_refs, string_agg(page_id || '/' || pos, ' ' ORDER BY page_id, pos) AS places FROM l GROUP BY href")
def page_text_index(spark, d):
    found = links.hrefs(table(spark, d, "pages"), "html", ["page_id"])
    return links.places(found, "href", ["page_id", "pos"])


@query(f"SELECT lang, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars, sum(len(string_split_regex(text, '{W}')))::BIGINT AS words, max(length(text))::BIGINT AS longest FROM documents GROUP BY lang")
def doc_text_stats(spark, d):
    t = table(spark, d, "documents").select("lang", F.length("text").alias("n"), F.size(text.split_words(F.col("text"))).alias("w"))
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n").alias("chars"), F.sum("w").alias("words"), F.max("n").cast("long").alias("longest"))


@query(f"SELECT page_id, pos::INT AS pos, href FROM ({HREF_SQL})")
def page_href_explode(spark, d):
    return links.hrefs(table(spark, d, "pages"), "html", ["page_id"])


SAMPLES = ["#note1", "", "http://a.b/c", "HTTPS://A.B", "mailto:x@y.z", "ftp://", "/rel", "x.html#y", "javascript:void(0)"]


@query(
    f"""SELECT kind, count(*)::BIGINT AS n FROM (SELECT CASE WHEN href = '' THEN 'empty' WHEN href LIKE '#%' THEN 'internal'
    WHEN regexp_matches(lower(href), '^(https?://|ftps?://|mailto:).') THEN 'external' ELSE 'broken' END AS kind
    FROM (SELECT href FROM ({HREF_SQL}) UNION ALL SELECT unnest({SAMPLES!r}))) GROUP BY kind"""
)
def href_classify(spark, d):
    found = links.hrefs(table(spark, d, "pages"), "html", []).select("href")
    t = found.union(spark.createDataFrame([(s,) for s in SAMPLES], "href string"))
    return t.groupBy(text.link_class(F.col("href")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def broken_refs_anti(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return links.broken(table(spark, d, "customer").select("c_custkey", "c_name"), done, "c_custkey", "o_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_size = 1 OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def used_parts_semi(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return links.referenced(table(spark, d, "part"), used, ["p_partkey"], F.col("p_size") == 1).select("p_partkey", "p_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))")
def two_hop_prune(spark, d):
    r = table(spark, d, "region").where("r_name LIKE 'A%'").select(F.col("r_regionkey").alias("n_regionkey"))
    n = links.referenced(table(spark, d, "nation"), r, ["n_regionkey"]).select(F.col("n_nationkey").alias("s_nationkey"))
    return links.referenced(table(spark, d, "supplier"), n, ["s_nationkey"]).select("s_suppkey", "s_name")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def resource_deps(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_name")


@query("SELECT coalesce(quality, -1) AS kind, count(*)::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def element_type_fallback(spark, d):
    t = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return t.groupBy(F.coalesce("quality", F.lit(-1)).alias("kind")).agg(F.count("*").alias("n"))


@query(
    """WITH w AS (SELECT conv_id, turn, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations)),
    r AS (SELECT lower(word) AS value, conv_id, turn, pos, row_number() OVER (PARTITION BY lower(word) ORDER BY conv_id, turn, pos) AS k FROM w)
    SELECT value, conv_id, turn, pos::INT AS pos FROM r WHERE k = 1"""
)
def first_seen_distinct(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return links.first_seen(t, F.lower("word"), ["conv_id", "turn", "pos"])


@query("SELECT conv_id, turn, dense_rank() OVER (ORDER BY conv_id)::BIGINT || '.' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS label FROM conversations WHERE role = 'assistant'")
def footnote_labels(spark, d):
    t = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn")
    return sequences.labels(t, "conv_id", ["turn"]).select("conv_id", "turn", "label")


@query("SELECT event_id, row_number() OVER w AS n, 'ref-' || user_id || '-' || row_number() OVER w AS ref_id FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def backlink_refs(spark, d):
    t = links.backlinks(table(spark, d, "events").where("event_type = 'click'"), "user_id", ["ts", "event_id"])
    return t.select("event_id", F.col("n").cast("long").alias("n"), "ref_id")


@query(
    """WITH r AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
    e AS (SELECT s_nationkey AS nation, s_suppkey AS number FROM supplier),
    c AS (SELECT nation, unnest(range(1, max(n) + 1 + (SELECT count(*) FROM supplier))) AS number FROM r GROUP BY nation),
    f AS (SELECT nation, number, row_number() OVER (PARTITION BY nation ORDER BY number) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.nation = c.nation AND e.number = c.number))
    SELECT nation, c_custkey, 'sect_' || number AS id FROM r JOIN f USING (nation, k)"""
)
def generated_ids(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    taken = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("number"))
    return links.unused_ids(rows, taken, ["c_custkey"], ["nation"]).select("nation", "c_custkey", F.concat(F.lit("sect_"), F.col("number").cast("string")).alias("id"))


@query(
    r"""WITH RECURSIVE p(doc_id, page, start, stop, text) AS (
      SELECT doc_id, 0, 0, 0, text FROM documents
      UNION ALL
      SELECT doc_id, page + 1, stop, CASE WHEN length(text) - stop < 2300 THEN length(text) ELSE stop + CASE
          WHEN regexp_matches(substr(text, stop + 2, 2299), '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\-–—,.;:!?)\]}»"''/]')
          THEN 1 + length(regexp_extract(substr(text, stop + 2, 2299), '(?s)^.*[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\-–—,.;:!?)\]}»"''/]')) ELSE 2300 END END, text
      FROM p WHERE stop < length(text))
    SELECT doc_id, page, start::BIGINT AS start, (stop - start)::BIGINT AS n_chars, length(text) - start >= 2300 AS marked FROM p WHERE page > 0"""
)
def page_split(spark, d):
    return sequences.page_split(table(spark, d, "documents"), "text", 2300, ["doc_id"])


@query("SELECT conv_id, turn, (coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 500 + 1)::BIGINT AS page FROM conversations")
def running_pages(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return sequences.running_pages(t, "n", 500, ["conv_id"], ["turn"]).select("conv_id", "turn", "page")


@query(
    """SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pid, length(text)::BIGINT AS length FROM conversations
    UNION ALL SELECT conv_id, NULL, sum(length(text))::BIGINT, 0 FROM conversations GROUP BY conv_id"""
)
def position_map(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return sequences.position_map(t, "n", ["conv_id"], ["turn"])


@query(
    """WITH p AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pid FROM conversations),
    e AS (SELECT conv_id, turn, pid, unnest(range(((pid + 39) // 40) * 40, pid + n, 40)) AS pos FROM p)
    SELECT conv_id, turn, (pos // 40 + 1)::BIGINT AS location, (pos - pid)::BIGINT AS "offset" FROM e"""
)
def location_map(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return sequences.location_map(t, "n", ["conv_id"], ["turn"])


@query(
    """SELECT event_id, as_of FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'view' THEN ts END) OVER w AS at,
      last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS as_of FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE event_type = 'purchase'"""
)
def page_lookup_asof(spark, d):
    e = table(spark, d, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("page"))
    return sequences.as_of(buys, views, ["user_id"], "ts", "page").select("event_id", "as_of")


LEVELS = "CAST(CASE role WHEN 'system' THEN 0 WHEN 'user' THEN turn % 3 ELSE 1 + turn % 4 END AS INT)"


def shape_sql(pops: str) -> str:
    """Entries one by one past a stack; pops: when an entry of a higher level replaces the last one."""
    return f"""WITH RECURSIVE e AS (SELECT conv_id, turn, {LEVELS} AS level, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    t AS (SELECT conv_id, turn, level, k, NULL::BIGINT AS parent, [{{'l': level, 't': turn}}] AS stack FROM e WHERE k = 1
    UNION ALL SELECT conv_id, turn, level, k, rest[-1].t, list_append(rest, {{'l': level, 't': turn}}) FROM (
      SELECT e.*, CASE WHEN e.level > t.level AND NOT ({pops}) THEN t.stack WHEN e.level >= t.level THEN t.stack[:len(t.stack) - 1] ELSE list_filter(t.stack, lambda x: x.l < e.level) END AS rest
      FROM t JOIN e ON e.conv_id = t.conv_id AND e.k = t.k + 1))
    SELECT conv_id, turn, level, parent FROM t"""


def _shaped(spark, d, shape: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", F.expr(LEVELS).alias("level"))
    return trees.toc_parents(t, "level", ["conv_id"], "turn", shape)


@query(shape_sql("e.level < 2"))
def toc_shape(spark, d):
    return _shaped(spark, d, "normal")


@query(shape_sql("e.level < 2 OR len(t.stack) > 1"))
def toc_old_kindle(spark, d):
    return _shaped(spark, d, "old_kindle")


@query(f"SELECT conv_id, turn, {LEVELS} AS level, NULL::BIGINT AS parent FROM conversations")
def toc_flat(spark, d):
    return _shaped(spark, d, "flat")


@query(
    """WITH RECURSIVE t(id, depth, path) AS (SELECT p_partkey, 0, p_brand FROM part WHERE p_partkey = 1
    UNION ALL SELECT p.p_partkey, t.depth + 1, t.path || ' -> ' || p.p_brand FROM part p JOIN t ON p.p_partkey > 1 AND p.p_partkey // 2 = t.id)
    SELECT id AS p_partkey, depth, '[' || path || ']' AS path FROM t"""
)
def tree_path(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_partkey > 1 THEN p_partkey DIV 2 WHEN p_partkey < 1 THEN -1 END").alias("parent"), "p_brand")
    return trees.paths(t, "p_partkey", "parent", "p_brand")


#: Over a thousand rules, of which the last ones matter; "*" and "" match anything.
RULES = [(1, "Brand#11", "*", "a"), (2, "", "PROMO", "b"), *((100 + i, f"none{i}", "promo", f"n{i}") for i in range(1200)), (2003, "brand#23", "STANDARD", "c"), (2004, "Brand#23", "", "d"), (3000, "*", "*", "z")]


@query(
    f"""WITH r(ord, p_brand, kind, rule) AS (VALUES {", ".join(map(str, RULES))}),
    p AS (SELECT p_partkey, p_brand, split_part(p_type, ' ', 1) AS kind FROM part),
    m AS (SELECT p.*, r.ord, r.rule, row_number() OVER (PARTITION BY p_partkey ORDER BY r.ord) AS k FROM p JOIN r ON (r.p_brand IN ('*', '') OR lower(r.p_brand) = lower(p.p_brand)) AND (r.kind IN ('*', '') OR lower(r.kind) = lower(p.kind)))
    SELECT p_partkey, rule FROM m WHERE k = 1"""
)
def rule_first_match(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"))
    rules = spark.createDataFrame(RULES, "ord int, p_brand string, kind string, rule string")
    return links.first_match(p, rules, ["p_brand", "kind"], "ord").select("p_partkey", "rule")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def dedupe_spans(spark, d):
    t = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return sequences.best_row(t, ["user_id", "event_type"], [F.desc("value"), "event_id"])


@query(
    """WITH o AS (SELECT o_orderkey AS l_orderkey, (o_orderkey % 7 * 30)::BIGINT AS total FROM orders),
    s AS (SELECT l_orderkey, l_linenumber * 20 AS a, l_linenumber * 20 + l_quantity::BIGINT AS b FROM lineitem),
    e AS (SELECT l_orderkey, a, b, 0 AS last FROM s WHERE l_orderkey IN (SELECT l_orderkey FROM o WHERE total > 0) UNION ALL SELECT l_orderkey, total, total, 1 FROM o WHERE total > 0),
    m AS (SELECT *, coalesce(max(b) OVER (PARTITION BY l_orderkey ORDER BY last, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM e)
    SELECT l_orderkey, upto::BIGINT AS gap_start, a::BIGINT AS gap_end FROM m WHERE a > upto"""
)
def fill_gaps(spark, d):
    totals = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7 * 30).alias("total"))
    t = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 20).alias("a"), (F.col("l_linenumber") * 20 + F.col("l_quantity").cast("long")).alias("b"))
    return sequences.gaps(t, totals, "a", "b", ["l_orderkey"], "total")


@query(
    """WITH s AS (SELECT user_id, event_id AS a, event_id + floor(value)::BIGINT AS b FROM events),
    m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s),
    g AS (SELECT *, sum(CASE WHEN upto IS NULL OR a > upto THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a) AS grp FROM m)
    SELECT user_id, min(a) AS start, max(b) AS "end", count(*)::BIGINT AS n FROM g GROUP BY user_id, grp"""
)
def row_groups(spark, d):
    t = table(spark, d, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + F.floor("value")).alias("b"))
    return sequences.merged_spans(t, "a", "b", ["user_id"], []).drop("group")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN a >= 0 AND b >= 0 THEN greatest(a, b) WHEN a <= 0 AND b <= 0 THEN least(a, b) ELSE a + b END AS margin
    FROM (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS a, lag(l_quantity - 25, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS b FROM lineitem)"""
)
def margin_collapse(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    t = table(spark, d, "lineitem").withColumn("a", F.col("l_quantity") - 25).withColumn("b", F.lag("a", 1, 0.0).over(w))
    return t.select("l_orderkey", "l_linenumber", values.collapsed_margin(F.col("a"), F.col("b")).alias("margin"))


@query(f"WITH l AS ({HREF_SQL}), f AS (SELECT page_id, href, min(pos) AS pos FROM l GROUP BY page_id, href) SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS number FROM f")
def note_first_ref_order(spark, d):
    found = links.hrefs(table(spark, d, "pages"), "html", ["page_id"])
    t = links.first_seen(found, F.col("href"), ["pos"], ["page_id"])
    return t.select("page_id", F.col("value").alias("href"), F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("long").alias("number"))


TEXTS = "SELECT doc_id, length(t)::INT AS n, md5(t) AS digest FROM (SELECT doc_id, {} AS t FROM documents)"


def digested(spark, d, f) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", f(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(TEXTS.format(f"regexp_replace(regexp_replace(text, '({W})[|](' || '{W})', '\\1~\\2', 'g'), '({W})[|]({W})', '\\1~\\2', 'g')"))
def text_dashes(spark, d):
    return digested(spark, d, lambda t: text.dashes(t, "|", "~"))


@query(TEXTS.format(f"regexp_replace(text, '^[TIA]{W}*({N})', '~\\1')"))
def text_speech(spark, d):
    return digested(spark, d, lambda t: text.speech(t, "TIA", "~"))


#: Texts of which some end in white space, or are nothing else.
ENDED = "CASE doc_id % 4 WHEN 0 THEN text || '  ' WHEN 1 THEN text || ' ' WHEN 2 THEN CASE WHEN doc_id % 8 = 2 THEN ' ' ELSE '  ' END ELSE text END"


@query(
    f"""WITH d AS (SELECT doc_id, {ENDED} AS text FROM documents), s AS (SELECT doc_id, text, regexp_replace(text, '{W}*({W})', '\\1', 'g') AS one FROM d),
    m AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '^{N}') THEN substr(one, 1, 1) || regexp_replace(substr(one, 2), '{W}?([|,])', '~\\1', 'g') ELSE regexp_replace(one, '{W}?([|,])', '~\\1', 'g') END AS t FROM s),
    r AS (SELECT doc_id, CASE WHEN length(text) = 1 AND regexp_matches(text, '{W}') THEN '' ELSE t END AS t FROM m)
    SELECT doc_id, length(t)::INT AS n, md5(t) AS digest FROM r"""
)
def text_dialogue(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.dialogue(F.expr(ENDED), "|,", "~").alias("t"))
    return t.select("doc_id", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(TEXTS.format(f"regexp_replace(text, '{W}+', ' ', 'g')"))
def collapse_ws(spark, d):
    return digested(spark, d, text.collapse_whitespace)


@query(TEXTS.format(r"regexp_replace(regexp_replace(text, '([\\`*_\[\]<>])', '\\\1', 'g'), '^([#\-+=])', '\\\1')"))
def md_escape(spark, d):
    return digested(spark, d, text.escape_markdown)


@query("SELECT n_regionkey, string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' |', chr(10) ORDER BY n_nationkey) AS rows_md FROM nation GROUP BY n_regionkey")
def md_table(spark, d):
    row = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), text.escape_cell(F.col("n_name")), F.lit(" |"))
    t = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("rows"))
    return t.select("n_regionkey", F.array_join(F.transform("rows", lambda r: r.row), "\n").alias("rows_md"))


@query(
    """WITH p AS (SELECT p_partkey, '978' || lpad(p_partkey::VARCHAR, 10, '0') AS s FROM part)
    SELECT p_partkey, CASE WHEN list_sum([substr(s, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END for i in range(1, 14)]) % 10 = 0 THEN 'ISBN-13' END AS kind FROM p"""
)
def isbn_check(spark, d):
    s = F.concat(F.lit("978-"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    return table(spark, d, "part").select("p_partkey", text.isbn(s).kind.alias("kind"))


DATES = "CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN {y} WHEN 1 THEN {y} || '-' || {m} WHEN 2 THEN {y} || '-' || {m} || '-' || {d} WHEN 3 THEN {d} || '.' || {m} || '.' || {y} WHEN 4 THEN {y} || '-' || {m} || '-31' ELSE 'spring ' || {y} END"


@query(
    "WITH s AS (SELECT o_orderkey, "
    + DATES.format(y="strftime(o_orderdate, '%Y')", m="strftime(o_orderdate, '%m')", d="strftime(o_orderdate, '%d')")
    + """ AS s FROM orders) SELECT o_orderkey, CASE WHEN regexp_full_match(s, '[0-9]{4}') THEN s WHEN regexp_full_match(s, '[0-9]{4}-(0[1-9]|1[0-2])') THEN s
    WHEN try_strptime(s, '%Y-%m-%d') IS NOT NULL AND length(s) = 10 THEN s WHEN length(s) = 10 THEN strftime(try_strptime(s, '%d.%m.%Y'), '%Y-%m-%d') END AS date FROM s"""
)
def date_normalize(spark, d):
    o = F.expr(DATES.format(y="date_format(o_orderdate, 'yyyy')", m="date_format(o_orderdate, 'MM')", d="date_format(o_orderdate, 'dd')"))
    return table(spark, d, "orders").select("o_orderkey", values.metadata_date(o).alias("date"))


@query(
    """WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    r AS (SELECT doc_id, pos::INT AS pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l WHERE trim(line) <> '' AND NOT regexp_matches(line, '^["(0-9]'))
    SELECT doc_id, pos, substr(line, 1, 1) AS dropcap FROM r WHERE k = 1"""
)
def first_paragraph(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    good = F.filter(lines, lambda x: (F.trim(x.line) != "") & ~x.line.rlike('^["(0-9]'))
    t = table(spark, d, "documents").select("doc_id", F.try_element_at(good, F.lit(1)).alias("p"))
    return t.where("p IS NOT NULL").select("doc_id", "p.pos", F.substring("p.line", 1, 1).alias("dropcap"))


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, octet_length(encode(text))::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    c(conv_id, turn, k, chunk, "offset", used) AS (SELECT conv_id, turn, k, 0::BIGINT, 0::BIGINT, n FROM t WHERE k = 1
    UNION ALL SELECT t.conv_id, t.turn, t.k, CASE WHEN c.used > 0 AND c.used + t.n > 2048 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.used > 0 AND c.used + t.n > 2048 THEN 0 ELSE c.used END,
      CASE WHEN c.used > 0 AND c.used + t.n > 2048 THEN t.n ELSE c.used + t.n END FROM c JOIN t ON t.conv_id = c.conv_id AND t.k = c.k + 1)
    SELECT conv_id, turn, chunk, "offset" FROM c"""
)
def chunk_bytes(spark, d):
    return sequences.byte_chunks(table(spark, d, "conversations"), "text", 2048, ["conv_id"], ["turn"])


@query("SELECT p_size, max(length(p_name))::INT AS name_width, max(length(p_brand))::INT AS brand_width, max(length(p_type))::INT AS type_width, rpad(min(p_brand), max(length(p_type))::INT, '.') AS cell FROM part GROUP BY p_size")
def column_widths(spark, d):
    widths = [F.max(F.length(f"p_{c}")).alias(f"{c}_width") for c in ("name", "brand", "type")]
    t = table(spark, d, "part").groupBy("p_size").agg(*widths, F.min("p_brand").alias("b"))
    return t.select("p_size", "name_width", "brand_width", "type_width", F.rpad("b", F.col("type_width"), F.lit(".")).alias("cell"))


@query("SELECT p_brand, l_returnflag, count(*)::BIGINT AS n, count(DISTINCT l_orderkey)::BIGINT AS n_orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def style_usage(spark, d):
    items, p = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_returnflag"), table(spark, d, "part").select("p_partkey", "p_brand")
    return items.join(p, items.l_partkey == p.p_partkey).groupBy("p_brand", "l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_orders"))


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS has_f, bool_or(o_orderpriority LIKE '1%') AS has_urgent, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey")
def feature_flags(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("has_f"), F.bool_or(F.col("o_orderpriority").startswith("1")).alias("has_urgent"), F.max("o_totalprice").alias("largest"))


@query(
    """SELECT page_id, length(t)::INT AS n, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?s)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<a\\b[^>]*>.*?</a>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM pages)"""
)
def html_text(spark, d):
    t = table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(
    """SELECT l_orderkey, n, (CASE WHEN n <= 65536 THEN 1 ELSE least((n - 65536) // 16384 + 2, 256) END)::BIGINT AS version FROM
    (SELECT l_orderkey, sum(l_quantity::BIGINT * 1000)::BIGINT AS n FROM lineitem GROUP BY l_orderkey)"""
)
def section_sizes(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long") * 1000).alias("n"))
    return t.select("l_orderkey", "n", values.section_size_version(F.col("n")).alias("version"))


@query("SELECT conv_id, count(*)::BIGINT AS n, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS outline FROM conversations GROUP BY conv_id")
def subtree_text(spark, d):
    c = table(spark, d, "conversations")
    nodes = c.select("conv_id", F.col("turn").alias("seq"), F.concat_ws(":", "role", F.length("text").cast("string")).alias("text"))
    roots = c.groupBy("conv_id").agg(F.min("turn").alias("seq"), F.max("turn").alias("last_seq"), F.count("*").alias("n"))
    return trees.subtree_text(nodes, roots, ["conv_id"]).join(roots.select("conv_id", "n"), "conv_id").select("conv_id", "n", F.col("text").alias("outline"))


@query("SELECT p_partkey, CASE WHEN p_size > 100 THEN 1 + (p_size - 100) / 160 ELSE p_size / 100 END AS rem, round(p_size * 0.75::DOUBLE, 9) AS points FROM (SELECT p_partkey, (p_size * 8)::DOUBLE AS p_size FROM part)")
def measures(spark, d):
    t = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 8).cast("double").alias("s"))
    return t.select("p_partkey", values.percent_to_rem(F.col("s")).alias("rem"), F.round(values.length_points(F.col("s"), F.lit("px"), F.lit(12.0)), 9).alias("points"))


@query("SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY o_custkey")
def ordered_lists(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"))


LINES = "SELECT doc_id::VARCHAR AS book_id, ls AS lines FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"


@query("SELECT doc_id::VARCHAR AS book_id, (len(string_split(text, chr(10))))::BIGINT AS paragraphs, length(replace(text, chr(10), ''))::BIGINT AS chars FROM documents")
def book_paragraphs(spark, d):
    n = book_source.nodes(book_source.from_texts(table(spark, d, "documents"), "doc_id", "text"))
    return n.groupBy("book_id").agg(F.count_if(F.col("kind") == "p").alias("paragraphs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


@query(f"SELECT book_id, md5(array_to_string(list_filter(list_transform(lines, lambda x: trim(regexp_replace(x, '{W}+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10))) AS digest FROM ({LINES})")
def book_text(spark, d):
    n = book_source.nodes(book_source.from_texts(table(spark, d, "documents"), "doc_id", "text"))
    return render.plain_text(n).select("book_id", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("SELECT doc_id::VARCHAR AS book_id, 'unknown/' || doc_id || '.txt' AS path FROM documents")
def book_paths(spark, d):
    return render.output_paths(book_source.metadata(book_source.from_texts(table(spark, d, "documents"), "doc_id", "text")), ".txt")


@query("SELECT doc_id::VARCHAR AS book_id, 1::BIGINT AS seq, 'sect_1' AS xml_id FROM documents")
def book_section_ids(spark, d):
    n = book_source.nodes(book_source.from_texts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text"))
    return books.section_ids(n)


CSS = "p { margin: 0; color: red } .Brand-11, .x { color: blue } p.Brand-23 { margin: 2em } a > b { color: black } @media print { p { color: white } }"


@query(
    """SELECT p_partkey, property, value FROM (SELECT p_partkey, 'margin' AS property, CASE WHEN p_brand = 'Brand#23' THEN '2em' ELSE '0' END AS value FROM part
    UNION ALL SELECT p_partkey, 'color', CASE WHEN p_brand = 'Brand#11' THEN 'blue' ELSE 'red' END FROM part)"""
)
def style_cascade(spark, d):
    rules = styles.rules(spark.createDataFrame([("s", CSS)], "sheet_id string, css string")).where(styles.media_applies("media", "screen"))
    e = table(spark, d, "part").select("p_partkey", F.lit("p").alias("element"), F.array(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("classes"))
    return styles.cascade(e, rules, ["p_partkey"])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    t = ingest.windowed_events(table(spark, d, "events"))
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def transliterate(spark, d):
    return table(spark, d, "documents").select("doc_id", language.transliterate(F.col("text")).alias("text"))


@query()
def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(language.sentences(F.col("text"))).alias("pos", "sentence"))


@query()
def hyphenate(spark, d):
    return table(spark, d, "documents").select("doc_id", language.hyphenate(F.col("text"), ["1ti", "n1t", "e1r", "o1n", "hen5at", "2ion"]).alias("text"))

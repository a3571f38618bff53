"""Operator 8, mixing sources to target weights by systematic sampling [native].

Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the words of all
documents. A target stops at 3 times its source's words; the excess goes to the others by weight,
until none is above. That fixpoint has a closed form: with sources ordered by cap / weight, the
first ones take their caps and the rest share what is left.

A document's expected copies are its source's target / words. Documents of a source stand in order
of size class, hash bucket, size, doc_id and a hash of the row; the prefix sum of expected copies plus one offset for
the source (from a hash of its name and the seed) crosses whole numbers, and a document is
emitted once for each one that its own step crosses. The order by size keeps the words taken close
to the target.

The prefix sum has two levels: documents are counted by (source, class, bucket), those counts are
summed along the source, and within each small group documents are numbered. So a source with a
third of the rows is spread over some thousand groups.

Null text or size counts as 0 words; such documents may be taken, at 0 words. A null source is a
source of its own. Null and repeated doc_ids are ordered like others, rows equal in all columns are alike. If no document has a word,
targets are 0 and nothing is taken. An empty table gives no rows. Other columns travel in one
struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACES

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 7


def text_size(text: str) -> F.Column:
    """Words of a text; null: 0."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """totals: one row for each source, with `key` and `source_size`; adds `target`."""
    order = Window.orderBy("key")  # one row for each source
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int")).cast("long")
    t = totals.withColumn("w", weight).withColumn("cap", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "key")
    upto, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.select(
        "key",
        "source_size",
        "w",
        "cap",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0))).alias("left"),
        F.sum("w").over(after).alias("rest"),
        F.row_number().over(by_ratio).alias("at"),
    )
    # the first source whose share of what is left stays within its cap; it and all after it share
    level = F.min(F.when(F.col("left") * F.col("w") <= F.col("cap") * F.col("rest"), F.struct("at", "left", "rest"))).over(everything)
    t = t.withColumn("level", level)
    shared = (F.col("level.left") * F.col("w")).cast("double") / F.col("level.rest")
    return t.select("key", "source_size", F.when(F.col("at") < F.col("level.at"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def mix(docs: DataFrame, size: str, id: str = "doc_id", source: str = "source", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Struct `row` with all columns of docs, size, source_size, target and copies."""
    t = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"),
        F.col(id).alias("id"),
        F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))).alias("key"),
        F.substring(F.md5(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")), 1, 2).alias("bucket"),
    )
    # a class for each power of two, cut in four
    t = t.withColumn("class", F.expr("length(bin(size)) * 8 + shiftright(size, greatest(length(bin(size)) - 3, 0))").cast("int"))
    groups = t.groupBy("key", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    along = Window.partitionBy("key").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.select("key", "class", "bucket", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    known = targets(groups.groupBy("key").agg(F.sum("words").alias("source_size")), weights, cap)
    before = before.join(known, "key")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key")).cast("binary")), 1, 5), 16, 10).cast("double") / 1048576
    within = Window.partitionBy("key", "class", "bucket").orderBy("size", F.col("id").asc_nulls_first(), F.xxhash64("row"))
    t = t.withColumn("n", F.row_number().over(within)).join(before, ["key", "class", "bucket"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("before") + F.col("n")
    copies = F.floor(offset + rate * rank) - F.floor(offset + rate * (rank - 1))
    return t.select("row", "size", "source_size", "target", F.least(copies, F.lit(cap)).cast("long").alias("copies"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", text_size("text").alias("size"))
    return mix(docs, "size").select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS bucket
  FROM documents),
c AS (SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS class FROM d),
s AS (SELECT key, sum(size)::BIGINT AS source_size, list_extract([1, 2, 3], ((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT)::BIGINT AS w FROM d GROUP BY key),
o AS (SELECT *, {CAP} * source_size AS cap, row_number() OVER r AS pos,
        (sum(source_size) OVER () - coalesce(sum({CAP} * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest_size,
        (sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest_w
      FROM s WINDOW r AS (ORDER BY ({CAP} * source_size)::DOUBLE / w, key)),
l AS (SELECT pos, rest_size, rest_w FROM o WHERE rest_size * w <= cap * rest_w ORDER BY pos LIMIT 1),
t AS (SELECT o.key, o.source_size, CASE WHEN o.pos < l.pos THEN o.cap::DOUBLE ELSE (l.rest_size * o.w)::DOUBLE / l.rest_w END AS target,
        ('0x' || substr(md5('{SEED}:' || o.key), 1, 5))::BIGINT::DOUBLE / 1048576 AS u FROM o, l),
n AS (SELECT c.*, row_number() OVER (PARTITION BY key ORDER BY class, bucket, size, doc_id NULLS FIRST) AS k FROM c)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE least(floor(u + target / source_size * k)::BIGINT - floor(u + target / source_size * (k - 1))::BIGINT, {CAP}) * size END::BIGINT AS taken
FROM n JOIN t USING (key)
"""

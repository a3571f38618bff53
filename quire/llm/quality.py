"""Operator 2, quality rules [native]: DataFrame functions only.

Base rules count words, characters in words, symbols, repeated lines and words in repeated 3-word
windows of each whole text. The verdict then comes from hashed n-grams: words and word pairs fall
into a fixed number of buckets by a 64-bit hash. Two multinomials are estimated over them, one from
all documents (raw), one from trusted documents (target, shrunk towards raw), and a text's score is
the mean over its n-grams of log(target / raw). Every document is held against the same threshold.

The raw counts cover all documents. The trusted documents may be a sample, of TRUSTED ids at most,
those with the lowest hashes; only their ids are broadcast. The counts, BUCKETS rows, are the only
thing that goes to the driver.

Null text counts as empty: no words, base_failed, not kept. A null doc_id keeps its row. Repeated
rows are counted as often as they stand there and judged alike. A score at the threshold is kept. A very
long text is judged whole: its words' hashes are one array in a task. Without trusted documents every
score is 0. An empty table gives no rows. Other columns pass through `score_documents` untouched,
whatever their names: they travel in one struct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, words_of

SYMBOLS = "#*$%&|<>"
BUCKETS = 10_000
TRUSTED = 20_000
#: Documents with a lower mean log-likelihood ratio are rejected.
THRESHOLD = -0.05
#: Weight of the raw distribution in the target's, against 1 for the trusted counts.
SHRINK = 0.01
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent
#: Repeated windows of a text up to which each is looked up.
FEW = 16


def repeated_words(hashes: str, n: int = 3) -> Column:
    """Words that lie in n-word windows found twice or more, from an array of word hashes.

    Windows are compared by a 64-bit hash over their words' hashes. Sorting brings equal ones
    together. With few different repeated windows their places are looked up; with many, pairs of
    hash and place are sorted and those with an equal neighbour kept. The places, in order, each
    add the words up to the next one, n at most.
    """
    window = ", ".join(f"{hashes}[i + {k}]" for k in range(n))
    windows = f"transform(sequence(0, size({hashes}) - {n}), i -> xxhash64({window}))"
    repeated = "array_distinct(filter(s, (x, k) -> k > 0 AND s[k - 1] = x))"
    few = "filter(sequence(0, size(t) - 1), i -> array_contains(r, t[i]))"
    many = """transform(array(sort_array(transform(t, (x, i) -> struct(x AS h, i AS i)))), s -> sort_array(transform(
        filter(s, (x, k) -> (k > 0 AND s[k - 1].h = x.h) OR (k + 1 < size(s) AND s[k + 1].h = x.h)), x -> x.i)))[0]"""
    covered = f"aggregate(p, struct(0L AS n, -{n} AS till), (a, x) -> struct(a.n + x + {n} - greatest(x, a.till) AS n, x + {n} AS till)).n"
    counted = f"transform(array(CASE WHEN size(r) <= {FEW} THEN {few} ELSE {many} END), p -> {covered})[0]"
    found = f"transform(array(transform(array(sort_array(t)), s -> {repeated})[0]), r -> CASE WHEN size(r) = 0 THEN 0L ELSE {counted} END)[0]"
    return F.expr(f"CASE WHEN size({hashes}) < {n} THEN 0L ELSE transform(array({windows}), t -> {found})[0] END")


def measured(docs: DataFrame, row: list[str], text: str) -> DataFrame:
    """The named columns, base counts, and the buckets of the text's n-grams."""
    t = docs.select(*row, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    t = t.select(*row, "__text", F.transform(words_of(F.col("__text")), lambda w: F.xxhash64(w)).alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    t = t.select(
        *row,
        "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate("__text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    return t.select(
        *row,
        "__words",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("__words").alias("n_repeat_words"),
    )


def log_ratios(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", n: int = BUCKETS, most: int = TRUSTED, shrink: float = SHRINK) -> list[float]:
    """log(target / raw) of each bucket. trusted: a column `id` of trusted documents."""
    ids = trusted.select(F.col(id).alias("__trusted")).where(F.col("__trusted").isNotNull()).distinct().orderBy(F.xxhash64("__trusted"), "__trusted").limit(most)
    hashed = F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w))
    one, two = F.pmod("z.w", F.lit(n)), F.pmod(F.xxhash64("z.w", "z.v"), F.lit(n))
    counts = (
        docs.join(F.broadcast(ids), F.col(id) == F.col("__trusted"), "left")
        .select(F.col("__trusted").isNotNull().cast("long").alias("trusted"), hashed.alias("w"))
        .select("trusted", F.explode(F.arrays_zip("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("v"))).alias("z"))
        .select("trusted", F.explode(F.when(F.col("z.v").isNull(), F.array(one)).otherwise(F.array(one, two))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
        .collect()  # n rows at most
    )
    out = [0.0] * n
    all_raw, all_target = sum(r.raw for r in counts), sum(r.target for r in counts)
    for r in counts if all_target else []:
        p = r.raw / all_raw
        out[r.bucket] = math.log((r.target / all_target + shrink * p) / (1 + shrink) / p)
    return out


def score_documents(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Struct `row` with all columns of docs, the base counts, base_failed, score and kept."""
    ratios = log_ratios(docs, trusted, id, text)
    table = f"CAST(split('{','.join(repr(round(x, 12)) for x in ratios)}', ',') AS ARRAY<DOUBLE>)"
    t = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("__t"))
    t = measured(t, ["row"], "__t")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    n = len(ratios)
    one, two = f"{table}[CAST(pmod(__words[%s], {n}) AS INT)]", f"{table}[CAST(pmod(xxhash64(__words[i], __words[i + 1]), {n}) AS INT)]"
    total = f"IF(n_words < 2, 0D, aggregate(sequence(0, size(__words) - 2), 0D, (a, i) -> a + {one % 'i'} + {two}))"
    score = F.expr(f"CASE WHEN n_words = 0 THEN 0D ELSE ({total} + {one % 'size(__words) - 1'}) / (2 * n_words - 1) END")
    t = t.select("row", *counts, failed.alias("base_failed"), score.alias("score"), F.monotonically_increasing_id().alias("place"))
    return t.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep_documents(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept.

    The filter also names `place`, which isn't deterministic, so the optimizer leaves it above the
    scores. Pushed below, it would be written out in terms of the text, with the words split anew
    for each place of a window.
    """
    return score_documents(docs, trusted, id, text, threshold).where("kept AND place >= 0").select("row.*")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    t = score_documents(docs, trusted_ids(spark, sf_dir))
    return t.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 9).alias("score"))

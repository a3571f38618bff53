"""A training-data pipeline over `documents`: each stage takes and returns a table with its columns.

Stages read their input once written, so each works on all that the one before kept. Near-duplicate
removal goes by rows, so of repeated rows and of copies with a null doc_id one stays too; texts
without words are no one's duplicates. In each other stage repeated rows, nulls and empty tables
behave as in the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import round_trip, tokenizer_path
from quire.llm.common import plan_size, shared_folder, small_batches, written
from quire.llm.minhash import FEW, near_duplicates
from quire.llm.mixing import mix, text_size
from quire.llm.quality import keep_documents, trusted_ids
from quire.llm.repeats import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_documents(docs, trusted_ids(spark, sf_dir))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id (null ids last), whatever ids its rows have."""
    # a row's place is its id below: written, since it must not change between jobs
    placed = docs.select(F.struct(*_all(docs)).alias("row"), F.monotonically_increasing_id().alias("place"))
    folder = shared_folder(spark, "near-duplicates")
    placed = written(placed, folder, "placed", plan_size(docs))
    groups = near_duplicates(placed.select("place", "row.text"), "place").select(F.col("doc_id").alias("place"), "component_id")
    groups = written(groups, folder, "groups", plan_size(docs) // 10)
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place")
    stay = groups.join(placed.select("place", "row.doc_id"), "place").groupBy("component_id").agg(F.min(first).alias("first")).select("first.place")
    gone = written(groups.select("place").join(stay, "place", "left_anti"), folder, "gone", plan_size(docs) // 10)
    # what goes is named to every task if it is few, so that no text is shuffled
    gone = F.broadcast(gone) if gone.count() <= FEW else gone
    return placed.join(gone, "place", "left_anti").select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that repeat; n_chars counts what is left."""
    left = remove_repeats(docs)
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("text"), "n_chars": changed}
    return left.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes."""
    mixed = mix(docs.select(F.struct(*_all(docs)).alias("all"), "doc_id", "source", text_size("text").alias("words")), "words")
    return mixed.where("copies > 0").select(F.col("row.all").alias("all"), F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("all.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text that they decode to."""
    t = round_trip(docs.select("doc_id", "source", "text"), tokenizer_path()).select("row.doc_id", "row.source", "n_tokens", "ids_sha256", F.col("decoded").alias("text"))
    # written here: batches have the size that is set when the job runs, and each large one stands in the JVM and in its worker
    with small_batches(spark):
        return written(t, shared_folder(spark, "bpe"), "encoded")


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("repeats", repeats), ("mixing", mixing), ("bpe", bpe)]

#: Hashed n-grams, MinHash components and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next reads it."""
    folder, docs = shared_folder(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)

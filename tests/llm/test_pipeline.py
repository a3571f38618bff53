"""The pipeline's stages against brute-force versions of what they take out and keep."""

from collections import Counter

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_quality import brute as quality_brute
from tests.llm.test_repeats import brute as repeats_brute

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    from quire.llm.bpe import tokenizer_path

    def kept_as(name, df):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    docs = spark.read.parquet(f"{D}/documents.parquet")
    trusted = {r[0] for r in spark.read.parquet(f"{D}/labels.parquet").where("quality = 1").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeats", "mixing", "bpe"]

    kept = {x[0] for x in quality_brute([(i, r.text) for i, r in rows.items()], trusted) if x[7]}
    one = kept_as("one", stages["quality"](spark, docs, D))
    assert {r.doc_id: r for r in one.collect()} == {i: rows[i] for i in kept} and one.columns == docs.columns

    alone = {x[0] for x in near_brute([(i, rows[i].text) for i in sorted(kept)], 5) if x[3]}
    two = kept_as("two", stages["near_duplicates"](spark, one, D))
    assert {r.doc_id: r for r in two.collect()} == {i: rows[i] for i in alone} and two.columns == docs.columns

    three = kept_as("three", stages["repeats"](spark, two, D))
    left = {r.doc_id: r for r in three.collect()}
    for i, (n, gone, _, _) in zip(sorted(alone), repeats_brute([rows[i].text for i in sorted(alone)])):
        assert len(left[i].text.encode()) <= n - gone and (gone or left[i] == rows[i]) and left[i].n_chars == len(left[i].text)
    assert set(left) == alone and three.columns == docs.columns

    four = kept_as("four", stages["mixing"](spark, three, D))
    copies = Counter(r.doc_id for r in four.collect())
    assert max(copies.values()) <= 3 and all(left[r.doc_id] == r for r in four.collect()) and four.columns == docs.columns

    tok = Tokenizer.from_file(tokenizer_path())
    five = stages["bpe"](spark, four, D).collect()
    assert Counter(r.doc_id for r in five) == copies
    assert all(r.text == left[r.doc_id].text and r.n_tokens == len(tok.encode(r.text, add_special_tokens=False).ids) for r in five)


def test_repeated_rows_and_null_ids(spark, tmp_path):
    from pyspark.sql import functions as F

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    # without trusted documents only the base rules take out, which copies don't change
    spark.read.parquet(f"{D}/labels.parquet").where("quality = 1").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    alone = stages["near_duplicates"](spark, stages["quality"](spark, docs, str(tmp_path)), D)
    good = alone.where("length(text) BETWEEN 600 AND 3000").orderBy("doc_id").limit(6).collect()
    assert len({r.text for r in good}) == 6
    a, b, c, d, e, f = (r.doc_id for r in good)
    copies = lambda i, n, id: docs.where(f"doc_id = {i}").withColumn("doc_id", F.lit(id).cast(docs.schema["doc_id"].dataType)).withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("__n")
    # repeated rows, repeated rows of two ids, null ids beside an id, null ids alone, an id of two texts
    rows = copies(a, 2, a).union(copies(b, 2, b)).union(copies(b, 2, 10**6)).union(copies(c, 1, c)).union(copies(c, 2, None)).union(copies(d, 3, None)).union(copies(e, 2, e)).union(copies(f, 2, e))
    changed = copies(d, 1, None).withColumn("text", F.concat("text", F.lit(" more")))
    df = docs.where(~F.col("doc_id").isin(a, b, c, d, e, f)).union(rows).union(changed)

    def kept_as(name, df):
        df.repartition(3).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    one = kept_as("one", stages["quality"](spark, df, str(tmp_path)))
    mine = [r.text for r in good]
    assert Counter(r.text for r in one.where(F.col("text").isin(mine)).collect()) == dict(zip(mine, [2, 4, 3, 3, 2, 2]))
    two = kept_as("two", stages["near_duplicates"](spark, one, D))
    texts = {r.text: i for i, r in enumerate(good)}
    got = [(texts[r.text], r.doc_id) for r in two.collect() if r.text in texts]
    more = two.where(F.col("doc_id").isNull()).collect()
    assert Counter(x for x in got if x[0] != 3) == Counter([(0, a), (1, b), (2, c), (4, e), (5, e)])
    assert len(more) == 1 and more[0].text in (good[3].text, good[3].text + " more") and two.columns == docs.columns
    assert two.groupBy("text").count().where("count > 1").isEmpty()
    want = repeats_brute([r.text for r in two.collect()])
    three = stages["repeats"](spark, two, D).collect()
    assert len(three) == len(want) and sum(not r.text for r in three) == sum(n == gone for n, gone, _, _ in want)
    assert all(r.text for r in three if r.doc_id in (a, b, c, e) or r.doc_id is None)
    assert stages["near_duplicates"](spark, two.limit(0), D).collect() == []


def test_bpe_gets_small_batches(spark, monkeypatch):
    """The executor's memory holds a batch twice, so whole Arrow batches of texts are too much."""

    def counted(docs, tokenizer):
        def run(batches):
            for b in batches:
                n = pa.array([b.num_rows] * b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("row"), n, b.column("text").cast("string"), b.column("text").cast("string")], ["row", "n_tokens", "ids_sha256", "decoded"])

        t = docs.select(F.struct("doc_id", "source").alias("row"), "text")
        return t.mapInArrow(run, "row struct<doc_id: long, source: string>, n_tokens long, ids_sha256 string, decoded string")

    monkeypatch.setattr(corpus_pipeline, "round_trip", counted)
    docs = spark.range(4000).selectExpr("id AS doc_id", "'web' AS source", "'some words' AS text").coalesce(1)
    got = corpus_pipeline.bpe(spark, docs, "").collect()
    assert len(got) == 4000 and max(r.n_tokens for r in got) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"

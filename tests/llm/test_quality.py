"""Quality rules against a brute-force version."""

import math
import re
import struct
from collections import Counter

import pytest

import xxhash

from quire.llm.quality import BUCKETS, SHRINK, THRESHOLD, score_documents

WORD = re.compile("[^\x20\x09-\x0d]+")


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def word_hash(w):
    return signed(xxhash.xxh64(w.encode(), seed=42).intdigest())


def pair_hash(a, b):
    return signed(xxhash.xxh64(struct.pack("<q", b), seed=xxhash.xxh64(struct.pack("<q", a), seed=42).intdigest()).intdigest())


def base(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def grams(text):
    h = [word_hash(w) for w in WORD.findall(text)]
    return [x % BUCKETS for x in h] + [pair_hash(a, b) % BUCKETS for a, b in zip(h, h[1:])]


def brute(docs, trusted):
    raw, target = Counter(), Counter()
    for i, t in docs:
        g = grams(t or "")
        raw.update(g)
        if i in trusted:
            target.update(g)
    n, m = sum(raw.values()), sum(target.values())
    out = []
    for i, t in docs:
        t = t or ""
        b, g = base(t), grams(t)
        score = sum(math.log((target[x] / m + SHRINK * raw[x] / n) / (1 + SHRINK) / (raw[x] / n)) for x in g) / len(g) if g else 0.0
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        out.append((i, *b, failed, not failed and score >= THRESHOLD, score))
    return sorted(out, key=repr)


def same(got, want):
    got = sorted(map(tuple, got), key=repr)
    assert [x[:8] for x in got] == [x[:8] for x in want]
    assert [x[8] for x in got] == pytest.approx([x[8] for x in want], abs=1e-6)


def test_against_brute_force(spark):
    docs = [
        (1, "one two three one two three one two three"),
        (2, " ".join(f"w{i}" for i in range(80)) + "\nsame line\n same line\nsame line\n \n\n"),
        (3, "!! | # " * 40),
        (4, None),
        (5, ""),
        (6, "a"),
        (7, "a b"),
        (8, "x y z q\x0bw\tr\n" * 3),
        (8, "x y z"),
        (None, " ".join(f"v{i % 70}" for i in range(200))),
        (9, "é中\U0001f600 " * 60),
        (10, " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"w{i}" for i in range(40))),
        (11, "tick tick tick tick tick"),
        (12, " ".join(f"m{i % 90}" for i in range(300))),
    ]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, kept string, score int")
    trusted = spark.createDataFrame([(2,), (10,), (10,), (None,)], "doc_id long")
    got = score_documents(df, trusted).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score").collect()
    same(got, brute(docs, {2, 10}))


def test_driver_table(spark):
    import __spark_entry__

    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    trusted = {r[0] for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").collect()}
    got = __spark_entry__.queries()["op2_quality"](spark, d).collect()
    same(got, brute(docs, trusted))


def test_no_trusted_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    assert [(r.kept, r.score) for r in score_documents(df, none).collect()] == [(True, 0.0)]
    assert score_documents(df.limit(0), none).collect() == []

"""Removal of repeated strings against brute force."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from quire.llm.repeats import remove_repeats


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, docs, length=200, parts=3):
    df = spark.createDataFrame([(i, t, "e") for i, t in docs], "doc_id long, text string, home string").repartition(parts)
    got = remove_repeats(df, length=length, digest_only=True).select("row.doc_id", "row.home", "n_bytes", "n_removed", "n_spans", "text").collect()
    assert all(r.home == "e" for r in got)
    return sorted([(r[0], *r[2:]) for r in got], key=repr)


def test_cases(spark):
    r = random.Random(4)
    noise = lambda n: "".join(r.choice("abcdefgh \né") for _ in range(n))
    shared, other = noise(320), noise(250)
    docs = [(i, noise(r.randrange(400)) + shared[r.randrange(60) : 200 + r.randrange(120)] + noise(r.randrange(300))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "x" * 199), (53, "x" * 199), (54, "y" * 200), (55, "y" * 200), (56, "z" * 201), (57, "ab" * 300), (58, "q" * 200)]
    docs += [(60, other + noise(50) + other), (61, other[:230] + other[5:240]), (None, noise(300)), (62, shared), (62, shared), (63, shared)]
    long = noise(3000)
    docs += [(70 + i, long[:1000] + f"<{i}>" + long[1000:2000] + f"[{i}]" + long[2000:]) for i in range(6)]
    assert run(spark, docs) == sorted([(i, *b) for (i, _), b in zip(docs, brute([t for _, t in docs]))], key=repr)


def test_text_and_pieces(spark, monkeypatch):
    from quire.llm import repeats

    r = random.Random(5)
    text = "".join(r.choice("abcdefgh") for _ in range(5000))
    whole = repeats.segments
    import numpy as np

    data = np.frombuffer((text + text[1000:1500]).encode(), np.uint8)
    parts = [(part, b, k) for part, b, k in repeats.in_pieces(data, np.array([0, len(data)]), 200, 700)]
    assert len(parts) > 5
    windows = sorted(int(f) + k + j for part, b, k in parts for f, n in zip(*whole(part, b)[1:3]) for j in range(int(n)))
    assert windows == list(range(len(data) - 199))
    df = spark.createDataFrame([(1, "é" * 150, 1), (2, "x" + "é" * 150, 2)], "doc_id long, text string, n_chars int")
    got = remove_repeats(df).orderBy("row.doc_id").collect()
    assert [x.text for x in got] == ["", "x"] and [x.row.n_chars for x in got] == [1, 2]
    assert remove_repeats(df.limit(0)).collect() == []


def test_driver_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = [tuple(x) for x in d.collect()]
    got = remove_repeats(d, digest_only=True).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "text")
    assert sorted(map(tuple, got.collect())) == sorted((i, *b) for (i, _), b in zip(docs, brute([t for _, t in docs])))


def brute_hashed(texts, length=200):
    """As brute, with a hash for each window instead of its bytes."""
    import numpy as np

    raw = [t.encode() for t in texts]
    hashes = [np.fromiter((hash(x[i : i + length]) for i in range(len(x) - length + 1)), np.int64) for x in raw]
    _, which, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    out, at = [], 0
    for x, h in zip(raw, hashes):
        change = np.zeros(len(x) + 1, np.int64)
        starts = np.flatnonzero(counts[which[at : at + len(h)]] > 1)
        change[starts] += 1
        change[starts + length] -= 1
        at += len(h)
        gone = np.cumsum(change[:-1]) > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_long_text_before_short_ones(spark):
    r = random.Random(12)
    noise = lambda n: r.randbytes(n * 3 // 4).hex()[:n]
    shared, other, third = noise(700), noise(400), noise(450)
    # borders of pieces, passages shared with the long text and among the short ones alone
    long = noise(5_000_000) + shared + noise(3_700_000) + other
    docs = [(0, noise(10_000)), (1, long), (2, noise(100_000) + shared[100:600] + noise(3000)), (3, noise(50_000) + other + noise(500)), (4, noise(900) + third + noise(900)), (5, third + noise(400))]
    assert brute_hashed([t for _, t in docs[2:]]) == brute([t for _, t in docs[2:]])
    assert run(spark, docs, parts=1) == sorted((i, *b) for (i, _), b in zip(docs, brute_hashed([t for _, t in docs])))


def test_pieces_of_several_texts():
    import numpy as np

    from quire.llm import repeats

    r = random.Random(14)
    texts = [r.randbytes(n) for n in (0, 150, 600, 5000, 0, 300, 900, 901, 3000, 2)]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    seen = []
    for part, edges, offset in repeats.in_pieces(data, bounds, 200, 700):
        doc, first, n, place, owner, content = repeats.segments(part, edges)
        seen += zip(doc.tolist(), (first + offset).tolist(), n.tolist(), (place + offset).tolist(), owner.tolist(), content.tolist())
    want = []
    for i, x in enumerate(texts):
        _, *rest = repeats.segments(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
        want += zip([i] * len(rest[0]), *(y.tolist() for y in rest))
    assert sorted(seen) == sorted(want)

"""Near-duplicates and components against brute force."""

import random
import re

import pytest

from quire.llm.components import connected_components
from quire.llm.common import shared_folder
from quire.llm.minhash import near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k, percent=80):
    sets = [shingles(t, k) for _, t in docs]
    parent = {i: i for i, _ in docs if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for n, ((i, _), s) in enumerate(zip(docs, sets)):
        if i is None:
            continue
        near = {m for x in s for m in index.get(x, ())}
        for m in near:
            t = sets[m]
            if 100 * len(s & t) >= percent * len(s | t):
                a, b = root(i), root(docs[m][0])
                parent[max(a, b)] = min(a, b)
        for x in s:
            index.setdefault(x, []).append(n)
    return sorted(((i, len(s), None if i is None else root(i) if s else i, i is None or not s or root(i) == i) for (i, _), s in zip(docs, sets)), key=repr)


def run(spark, docs, k):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, component_id int, a int")
    return sorted(map(tuple, near_duplicates(df, k=k).collect()), key=repr)


def test_small_cases(spark):
    r = random.Random(1)
    long = [f"w{r.randrange(500)}" for _ in range(120)]
    docs = [(1, "A b c"), (2, "a B c"), (3, "a b"), (4, None), (5, ""), (6, " \n\t"), (7, "Ä b c d e"), (8, "ä b c d e"), (None, "A b c"), (9, "x"), (9, "a b c"), (10, "x")]
    docs += [(100 - j, " ".join(long[: 100 + j] + [f"z{j}"])) for j in range(20)]
    docs += [(200 + j, " ".join(long)) for j in range(30)]
    assert run(spark, docs, 4) == brute(docs, 4)


def test_chains_and_empty(spark):
    r = random.Random(2)
    docs, words = [], [f"w{r.randrange(10**6)}" for _ in range(100)]
    for i in range(40):
        docs.append((i * 7 % 40, " ".join(words)))
        words[r.randrange(100)] = f"n{i}"
    assert run(spark, docs, 5) == brute(docs, 5)
    assert run(spark, [], 5) == []


@pytest.mark.parametrize("k", [4])
def test_driver_table(spark, k):
    docs = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), k=k)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, k)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(64)] + [(5, 5), (7, 8), (8, 7)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark, "test"))
    assert sorted(map(tuple, got.collect())) == sorted((x, root(x)) for x in parent)

"""Operator 4, MinHash near-duplicates.

A document's set holds 64-bit hashes of its distinct word shingles. HASHES universal hash functions
(multiply, add, shift) give its minima; bands of ROWS minima give bucket keys. At a similarity of
0.8 two documents miss all 40 buckets with probability 1.2e-7, above that with less.

Equal sets form a class, of which only the smallest id goes on. In each bucket every member is held
against the smallest id: sizes and signatures sort out what cannot reach the threshold, then the
full sets decide. Components of these links come from alternating stars. Where buckets still hold
several components, those that have the same member with the least hash form a group (so a group is a
member's own buckets at most, and does not grow through chains of buckets), and every pair of documents
of a group from different components is decided by counting, in blocks of bounded size that give a
forest of links. No pair of documents is ever a row of its own there.

Null or empty text and text without words has an empty set, linked with nothing. Rows with a null
id are kept, linked with nothing, and have a null component. Rows that repeat an id are one node
with the links of all its texts. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plan_size, remove, shared_folder, slices, small_batches, trimmed, written
from .components import connected_components
from .hashing import ODD, mixed, text_buffer, word_hashes

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: Bytes of text that are worked on at once.
SLICE = 1 << 18
#: Pairs whose signatures agree in a smaller part are not held against each other in full. At the
#: threshold the part has a standard deviation of 0.03.
LEAST_AGREEMENT = 0.6
#: Members of a star that meet its centre in one stream, and shingles in a block of a group.
STREAM, BLOCK = 256, 400_000
#: Ids of documents that are broadcast, 8 bytes each.
FEW = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
_random = np.random.Generator(np.random.PCG64(20))
_A = _random.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)
_B = _random.integers(0, 1 << 64, HASHES, np.uint64)
_C = _random.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_HALF = np.uint64(32)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, ASCII letters lower-cased."""
    data, bounds = text_buffer(texts)
    n = len(bounds) - 1
    empty = np.zeros(0, np.uint64)
    if not len(data):
        return [empty] * n
    words, at, _, _ = word_hashes(_LOWER[data], bounds, _SPACE)
    if not len(words):
        return [empty] * n
    whole = len(words) - k + 1
    if whole > 0:
        mixes = words[:whole] * _C[0]
        for i in range(1, k):
            mixes = mixes + words[i : i + whole] * _C[i]
        mixes = mixed(mixes)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(mixes[a : b - k + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * _C[k : k + b - a]).sum(keepdims=True) + np.full(1, b - a, np.uint64) * ODD))
        else:
            out.append(empty)
    return out


def minima(items: np.ndarray) -> np.ndarray:
    """HASHES minima, 32 bits each."""
    x = items >> _HALF
    least = np.full(HASHES, (1 << 32) - 1, np.uint64)
    for a in range(0, len(x), 256):
        h = _A[:, None] * x[None, a : a + 256]
        h += _B[:, None]
        h >>= _HALF
        np.minimum(least, h.min(axis=1), out=least)
    return least


def features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature (a byte for each minimum), bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = np.arange(1, BANDS + 1, dtype=np.uint64) * ODD
        for part in slices(batches, "text", SLICE):
            n, digests, signatures, keys = [], [], [], []
            for s in shingle_sets(part.column("text"), k):
                n.append(len(s))
                if not len(s):
                    digests.append(None)
                    signatures.append(None)
                    keys.append(None)
                    continue
                m = minima(s)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                signatures.append(m.astype(np.uint8).tobytes())
                keys.append(mixed((m.reshape(BANDS, ROWS) * _C[:ROWS]).sum(axis=1) + tag).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "signature", "keys"])

    return docs.mapInArrow(trimmed(run), "doc_id long, n_shingles long, digest binary, signature binary, keys array<long>")


def agreeing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose sizes and signatures let them reach the threshold."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("digest").alias(f"{x}_digest"), F.col("n_shingles").alias(f"{x}_n"), F.col("signature").alias(f"{x}_s"))
    t = pairs.join(side("b"), "b").join(side("a"), "a").where(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            s, t = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("a_s", "b_s"))
            yield x.filter(pa.array((s == t).mean(axis=1) >= LEAST_AGREEMENT)).select(["a", "b", "a_digest", "b_digest"])

    return t.select("a", "b", "a_digest", "b_digest", "a_s", "b_s").mapInArrow(run, "a long, b long, a_digest binary, b_digest binary").distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, most: int, k: int) -> DataFrame:
    """doc_id, digest and sorted shingle hashes of the documents that `wanted` names, `most` at most; up to FEW are broadcast."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            found = shingle_sets(part.column("text"), k)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["doc_id", "digest", "items"])

    wanted = F.broadcast(wanted) if most <= FEW else wanted
    return docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(trimmed(sets), "doc_id long, digest binary, items binary").dropDuplicates(["doc_id", "digest"])


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int, folder: str, name: str, most: int) -> DataFrame:
    """Pairs whose full sets reach the threshold. A row of pairs names a set by id and digest.

    A star's centre meets its members in streams of STREAM members about, its set first in each; a
    task holds one centre's set and one batch of members. most: a bound of the pairs.
    """
    pairs = written(pairs, folder, f"{name}-pairs", 56 * most)
    found = pairs.count()
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    held = full_sets(docs, wanted, 2 * found, k)
    streams = pairs.groupBy("a", "a_digest").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("n"))
    part = F.pmod(F.xxhash64("b", "b_digest"), F.col("n")).cast("int").alias("part")
    member = pairs.join(streams, ["a", "a_digest"]).select("a", "a_digest", part, F.col("b").alias("doc_id"), F.col("b_digest").alias("digest"))
    centre = streams.select("a", "a_digest", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.col("a").alias("doc_id"), F.col("a_digest").alias("digest"))
    rows = centre.withColumn("side", F.lit(0)).unionByName(member.withColumn("side", F.lit(1))).join(held, ["doc_id", "digest"])
    key = ["a", "a_digest", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for x in batches:
            a, b = [], []
            for at, node, side, items in zip(x.column("a").to_pylist(), x.column("doc_id").to_pylist(), x.column("side").to_pylist(), x.column("items"), strict=True):
                s = np.frombuffer(items.as_buffer(), np.uint64)
                if not side:
                    own = s.copy()
                    continue
                at_ = np.searchsorted(own, s)
                both = int((own[np.minimum(at_, len(own) - 1)] == s).sum())
                if 100 * both >= percent * (len(s) + len(own) - both):
                    a.append(at)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    t = rows.repartition(*key).sortWithinPartitions(*key, "side").select("a", "doc_id", "side", "items").mapInArrow(run, "a long, b long")
    return written(t, folder, f"{name}-links", 16 * found)


class Block:
    """Links among the documents of two blocks of a group, or of one, between different components."""

    def __init__(self, percent: int):
        self.percent = percent
        self.rows: list[tuple[int, int, bool, bytes, np.ndarray]] = []

    def links(self) -> list[tuple[int, int]]:
        """A forest of links that joins what the blocks' links join."""
        first = [r for r in self.rows if r[2]]
        second = [r for r in self.rows if not r[2]] or first
        parent = {r[1]: r[1] for r in self.rows}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        signs = np.frombuffer(b"".join(r[3] for r in second), np.uint8).reshape(-1, HASHES)
        sizes = np.array([len(r[4]) for r in second])
        flat = np.concatenate([r[4] for r in second])
        vocabulary, flat = np.unique(flat, return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        mark = np.zeros(len(vocabulary), np.int32)
        out = []
        for i, (a, c, _, sign, items) in enumerate(first):
            may = (signs == np.frombuffer(sign, np.uint8)).mean(axis=1) >= LEAST_AGREEMENT
            may &= 100 * np.minimum(sizes, len(items)) >= self.percent * np.maximum(sizes, len(items))
            if second is first:
                may[: i + 1] = False
            if not any(root(second[j][1]) != root(c) for j in np.flatnonzero(may)):
                continue
            at = np.searchsorted(vocabulary, items)
            at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == items)]
            mark[at] = 1
            both = np.add.reduceat(mark[flat], starts)
            mark[at] = 0
            for j in np.flatnonzero(may & (100 * both >= self.percent * (sizes + len(items) - both))):
                if (x := root(c)) != (y := root(second[j][1])):
                    parent[max(x, y)] = min(x, y)
                    out.append((a, second[j][0]))
        return out


def links_across(members: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, folder: str, n: int) -> DataFrame:
    """Links between components within groups. members: id, c (component), g (group), n rows at most.

    A group's largest component and the others are cut into blocks of about BLOCK shingles by a hash of
    the id. Two blocks, or one, are a unit of work, decided by counting, that gives a forest of links;
    two blocks of the largest component are none. So no pair is a row of a join, a unit's size is
    bounded whatever the group's, and a large component with few others costs as much as its rows.
    """
    t = members.join(reps.select(F.col("doc_id").alias("id"), "digest", "n_shingles", "signature"), "id")
    parts = t.groupBy("g", "c").agg(F.sum("n_shingles").alias("s"))
    size = parts.groupBy("g").agg(F.max(F.struct("s", "c")).alias("large"), F.sum("s").alias("s"))
    blocks = lambda s: F.ceil(s / BLOCK).cast("int")
    size = size.select("g", F.col("large.c").alias("large"), blocks(F.col("large.s")).alias("n_large"), blocks(F.col("s") - F.col("large.s")).alias("n_small"))
    # blocks of the others are numbered first
    small = F.col("c") != F.col("large")
    t = t.join(size, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.when(small, F.col("n_small")).otherwise(F.col("n_large"))).cast("int") + F.when(small, 0).otherwise(F.col("n_small")))
    sets = full_sets(docs, members.select(F.col("id").alias("doc_id")).distinct(), n, k)
    t = t.join(sets.select(F.col("doc_id").alias("id"), "digest", "items"), ["id", "digest"])
    t = t.select("*", F.explode(F.when(small, F.sequence(F.lit(0), F.col("n_small") + F.col("n_large") - 1)).otherwise(F.sequence(F.lit(0), F.col("n_small") - 1))).alias("o"))
    t = t.select("g", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), (F.col("b") <= F.col("o")).alias("first"), "id", "c", "signature", "items")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None

        def out():
            found = block.links()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            items = batch.column("items")
            for i, (g, x, y, first, id_, c, sign) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("g", "x", "y", "first", "id", "c", "signature")), strict=True)):
                if (g, x, y) != now:
                    if now is not None:
                        yield out()
                    now, block = (g, x, y), Block(percent)
                block.rows.append((id_, c, first, sign, np.frombuffer(items[i].as_py(), np.uint64)))
        if now is not None:
            yield out()

    return t.repartition("g", "x", "y").sortWithinPartitions("g", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, id, text, k, percent)


def _near_duplicates(docs: DataFrame, id: str, text: str, k: int, percent: int) -> DataFrame:
    folder = shared_folder(docs.sparkSession, "minhash")
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    all_ = written(features(docs, k), folder, "features", plan_size(docs))
    n = all_.count()
    known = all_.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    member = written(known.select("doc_id", "digest").join(classes, "digest").select("doc_id", "rep").distinct(), folder, "members", 16 * n)
    reps = known.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    reps = written(reps, folder, "representatives", 600 * n)
    rows = written(reps.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key")).distinct(), folder, "buckets", 16 * BANDS * n)

    # several texts of one id
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1")
    same = member.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).union(member.where("doc_id <> rep").join(several, "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))

    leads = rows.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = rows.join(leads, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    links = confirmed(agreeing(stars, reps, percent), docs, k, percent, folder, "stars", BANDS * n).union(written(same, folder, "same", 16 * n))
    found = written(connected_components(links, f"{folder}/first", rows=links.count()), folder, "components", 16 * n)

    placed = rows.join(leads.where("n > 2").select("key"), "key").join(found, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    placed = written(placed, folder, "placed", 24 * BANDS * n)
    several_ = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(F.xxhash64("id")).alias("g")).where("low < high")
    left = written(placed.join(several_, "key").select("id", "c", "g").distinct(), folder, "left", 24 * placed.count())
    if m := left.count():
        more = written(links_across(left, reps, docs, k, percent, folder, m), folder, "more", 16 * m)
        links = links.union(more)
        found = written(connected_components(links, f"{folder}/second", rows=links.count()), folder, "all-components", 16 * n)
    for name in ("buckets", "representatives", "stars-pairs", "stars-links", "same", "first", "placed", "left", "more", "second"):
        remove(docs.sparkSession, f"{folder}/{name}")  # all that is read below is written
    whole = member.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(found, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = all_.select("doc_id", "n_shingles").join(whole, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents, 4-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=4)

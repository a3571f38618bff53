"""Operator 7, removal of repeated byte strings.

Every byte that lies in a LENGTH-byte string which also starts somewhere else is removed, in all
its places. README.md says why the decision over whole corpora doesn't come from a suffix array.

Each window of LENGTH bytes is owned by the place of its least GRAM-byte hash, the leftmost of
equals, which depends on its bytes alone; so equal windows have equal owners at equal distances.
Consecutive windows with one owner form a segment (some 85 windows on average).

1. Each task writes its rows to a file of its own in the shared folder, compressed, and tells each
   text's digest. Of equal texts, one goes on; if they have LENGTH bytes, all their bytes go.
2. Tasks read those files and tell each segment's owner hash and the hash of all bytes it covers.
   Sorted by both, neighbours decide: an equal neighbour in both means all windows of the segment
   repeat; no neighbour with that owner hash means none does; else the segment stays open.
3. Open segments (and one or two of the repeated ones beside them) are told again in groups of GROUP
   windows, aligned by their distance from the owner: a hash of what all windows of the group have
   in common and one of all their bytes. Sorted by both, neighbours decide as before.
4. Open groups are told window by window, and decided alike.
5. Tasks read the files again and cut the repeated runs out.

Sorting streams through tasks with a row's neighbours in hand, so no group is ever gathered. Rows
carry hashes and places, never texts. Equality rests on two 64-bit hashes together.

Null text counts as empty. Null and repeated ids are fine: rows are told apart by their place. Rows
out are rows in; other columns travel in one struct, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Home, home_rows, new_folder, shared_folder, slices, small_batches, trimmed, written
from .hashing import ODD, Spans, mixed, text_buffer

LENGTH, GRAM, GROUP = 200, 32, 8
#: Texts are worked on in buffers of about so many bytes; longer texts in pieces that overlap.
BUFFER, PIECE = 1 << 18, 1 << 18
_LOW = np.uint64(24)


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n consecutive values, from running minima of blocks in both directions."""
    m = len(x)
    blocks = np.full(-(-m // n) * n, np.iinfo(np.uint64).max, np.uint64)
    blocks[:m] = x
    blocks = blocks.reshape(-1, n)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: m - n + 1], ahead[n - 1 : m])


def segments(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """text, first window's place in it, number of windows, the owner's place and hash, and the content hash of each segment."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    gram = min(GRAM, length)
    if len(data) < length:
        return none
    spans = Spans(data)
    at = np.arange(len(data) - gram + 1)
    grams = spans.rolling(gram)
    owner = (sliding_least((grams >> _LOW << _LOW) | at.astype(np.uint64), length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    change = np.zeros(len(data) + 1, np.int64)
    long = np.diff(bounds) >= length
    np.add.at(change, bounds[:-1][long], 1)
    np.add.at(change, bounds[1:][long] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(change)[: len(owner)] > 0)
    if not len(s):
        return none
    text = np.searchsorted(bounds, s, "right") - 1
    new = np.append(True, (owner[s[1:]] != owner[s[:-1]]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    a, b = s[first], s[last]
    return text[first], a - bounds[text[first]], b - a + 1, owner[a] - bounds[text[first]], grams[owner[a]].view(np.int64), spans.hashes(a, b + length).view(np.int64)


def in_pieces(data: np.ndarray, bounds: np.ndarray, length: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Buffers no longer than needed: texts together, or a text longer than a piece by itself, in pieces that share length - 1 bytes.

    With each the bounds of all texts in it (those that lie elsewhere are empty) and its offset in the
    long text. A piece ends where a segment does: one told in two parts would look like a repeated one.
    """
    at = 0
    for i in [*np.flatnonzero(np.diff(bounds) > piece + length).tolist(), len(bounds) - 1]:
        a, b = int(bounds[at]), int(bounds[i])
        if b > a:
            yield data[a:b], np.clip(bounds, a, b) - a, 0
        if i + 1 == len(bounds):
            return
        k, end = b, int(bounds[i + 1])
        while k < end:
            later = end
            if end - k > piece + length:
                near = k + piece - 2 * length  # more windows than two segments have
                later = near + int(segments(data[near : k + piece + length - 1], np.array([0, 3 * length - 1]), length)[1][-1])
            stop = min(later + length - 1, end)
            yield data[k:stop], np.clip(bounds, k, stop) - k, k - b
            k = later
        at = i + 1


def told(part, content, home, row, first, n, place, owner, whole, others=None) -> pa.RecordBatch:
    """Rows of segments, groups or windows: two hashes, of what they share and of all their bytes, and where they are.

    others: pairs (row, first) of equal ones in the same home, as bytes, or null.
    """
    columns = [np.asarray(x, np.int64) for x in (part, content, row, first, n, place, owner)]
    columns.insert(2, np.full(len(columns[0]), home, np.int32))
    others = pa.nulls(len(whole), pa.binary()) if others is None else pa.array(others, pa.binary())
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(whole), others], ["part", "content", "home", "row", "first", "n", "place", "owner", "whole", "others"])


def _neighbours(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray]]]:
    """Batches of sorted rows and, for each leading part of the keys, whether the row before and the row after have it too."""
    held = None

    def told(x: pa.RecordBatch, before: list[int] | None, after: list[int] | None):
        same = np.ones(x.num_rows - 1, bool)
        prior, later = True, True
        backs, fores = [], []
        for i, k in enumerate(keys):
            v = x.column(k).to_numpy()
            same = same & (v[1:] == v[:-1])
            prior = prior and before is not None and before[i] == v[0]
            later = later and after is not None and after[i] == v[-1]
            backs.append(np.concatenate([[prior], same]))
            fores.append(np.concatenate([same, [later]]))
        return x, backs, fores

    key = lambda x, i: [x.column(k)[i].as_py() for k in keys]
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield told(held, before, key(batch, 0))
            before = key(held, held.num_rows - 1)
        held = batch
    if held is not None:
        yield told(held, before, None)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, digest_only: bool = False) -> DataFrame:
    """Struct `row` with the other columns of docs, `text` with the repeated bytes cut out, n_bytes, n_removed, n_spans.

    A cut within a UTF-8 character drops the rest of that character. digest_only: `text` becomes the
    SHA-256 of the remaining bytes instead.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "repeats")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    docs = docs.select(F.struct(*others).alias("row"), F.col(f"`{text}`").alias("text"))
    root = new_folder(f"{folder}/homes")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Home(root) as home:
            for batch in slices(batches, "text", BUFFER):
                row = home.write(batch)
                data, bounds = text_buffer(batch.column("text"))
                raw = data.tobytes()
                digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n = len(digests)
                yield pa.RecordBatch.from_arrays([pa.array([home.number] * n, pa.int32()), pa.array(np.arange(row, row + n)), pa.array(digests, pa.binary()), pa.array(np.diff(bounds))], ["home", "row", "digest", "n"])

    with small_batches(spark):
        rows = written(docs.mapInArrow(trimmed(settle), "home int, row long, digest binary, n long"), folder, "rows")
    last, texts, size = rows.agg(F.max("home"), F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = rows.where(f"n >= {length}").groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("home", "row")).alias("one"))
    rows = rows.join(classes, "digest", "left").select("home", "row", "n", (F.col("copies") > 1).alias("copied"), (F.struct("home", "row") == F.col("one")).alias("goes_on"))
    rows = rows.select("home", "row", F.coalesce("copied", F.lit(False)).alias("copied"), F.coalesce("goes_on", F.lit(False)).alias("goes_on"))
    rows = written(rows, folder, "status", 32 * texts)

    def tell_segments(home: int, stored: Iterator[pa.RecordBatch], wanted: pa.Table) -> Iterator[pa.RecordBatch]:
        at = 0
        goes = np.zeros(int(pc.max(wanted["row"]).as_py()) + 1, bool)
        goes[wanted["row"].to_numpy()] = wanted["goes_on"].to_numpy()
        found: list[tuple[np.ndarray, ...]] = []
        for batch in stored:
            own = np.flatnonzero(goes[at : at + batch.num_rows])
            data, bounds = text_buffer(batch.column("text").take(pa.array(own)))
            for part, edges, offset in in_pieces(data, bounds, length):
                doc, first, n, place, owner, content = segments(part, edges, length)
                if len(doc):
                    found.append((owner, content, own[doc] + at, first + offset, n, place + offset))
            at += batch.num_rows
        if not found:
            return
        # equal segments of one home go on as one, so a hot one is a row of each home at most
        owner, content, row, first, n, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((content, owner))
        owner, content, row, first, n, place = (x[order] for x in (owner, content, row, first, n, place))
        heads = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (content[1:] != content[:-1])))
        sizes = np.diff(np.append(heads, len(owner)))
        pairs = np.stack([row, first], axis=1).astype(np.int64)
        for k in range(0, len(heads), 50_000):
            h, m = heads[k : k + 50_000], sizes[k : k + 50_000]
            others = [pairs[a + 1 : a + c].tobytes() if c > 1 else None for a, c in zip(h.tolist(), m.tolist(), strict=True)]
            yield told(owner[h], content[h], home, row[h], first[h], n[h], place[h], owner[h], np.zeros(len(h), bool), others)

    homes = (last or 0) + 1
    # a task for each home: rows are few, but each stands for a text to read
    by_home = lambda df, *order: df.repartitionByRange(homes, "home").sortWithinPartitions("home", *order)
    at_home = lambda work: trimmed(lambda it: home_rows(root, it, work))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, (part_back, all_back), (part_fore, all_fore) in _neighbours(batches, ["part", "content"]):
            old = x.column("whole").to_numpy(zero_copy_only=False)
            whole = all_back | all_fore | np.asarray(x.column("others").is_valid())
            beside = (part_back & ~all_back) | (part_fore & ~all_fore)
            kept = pa.array((whole & ~old) | beside)
            names = ["home", "row", "first", "n", "place", "owner", "others"]
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in names), pa.array(whole | old), pa.array(whole & ~old), pa.array(beside)], [*names, "whole", "marked", "beside"]).filter(kept)

    def judged(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        schema = "home int, row long, first long, n long, place long, owner long, others binary, whole boolean, marked boolean, beside boolean"
        return written(df.repartition(*keys).sortWithinPartitions("part", "content", "home", "row", "first").mapInArrow(trimmed(judge), schema), folder, name, size)

    def finer(tell: Callable) -> Callable:
        """For the wanted rows of a home, what `tell` says about their texts."""

        def work(home: int, stored: Iterator[pa.RecordBatch], wanted: pa.Table) -> Iterator[pa.RecordBatch]:
            at, row = 0, wanted["row"].to_numpy()
            rest = [wanted[c].to_numpy() for c in ("first", "n", "place", "owner", "whole")]
            for batch in stored:
                a, b = np.searchsorted(row, [at, at + batch.num_rows])
                if b > a:
                    own, which = np.unique(row[a:b] - at, return_inverse=True)
                    data, bounds = text_buffer(batch.column("text").take(pa.array(own)))
                    first, n, place, owner, whole = (x[a:b] for x in rest)
                    i, part, content, first, n = tell(Spans(data), bounds[which], bounds[which + 1], first, n, place, owner, mixed(np.uint64(home << 40) + row[a:b].astype(np.uint64)))
                    yield told(part, content, home, row[a:b][i], first, n, place[i], owner[i], whole[i])
                at += batch.num_rows

        return work

    def groups(spans: Spans, begin: np.ndarray, end: np.ndarray, first: np.ndarray, n: np.ndarray, place: np.ndarray, owner: np.ndarray, tag: np.ndarray):
        low, high = (place - first - n + 1) // GROUP, (place - first) // GROUP
        counts = high - low + 1
        i = np.repeat(np.arange(len(first)), counts)
        far = place[i] - GROUP * (low[i] + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts))  # its last window
        a, b = np.maximum(first[i], far - GROUP + 1), np.minimum(first[i] + n[i] - 1, far)
        common = spans.hashes(begin[i] + far, begin[i] + far - GROUP + 1 + length)
        inside = (far - GROUP + 1 >= 0) & (begin[i] + far + length <= end[i])
        x, y = np.where(inside, begin[i] + far - GROUP + 1, 0), np.where(inside, begin[i] + far + length, 0)
        # what reaches out of its text is like nothing else
        content = np.where(inside, spans.hashes(x, y), mixed(common + tag[i] + far.astype(np.uint64) * ODD))
        return i, mixed(common + owner[i].view(np.uint64)).view(np.int64), content.view(np.int64), a, b - a + 1

    def windows(spans: Spans, begin: np.ndarray, end: np.ndarray, first: np.ndarray, n: np.ndarray, place: np.ndarray, owner: np.ndarray, tag: np.ndarray):
        i = np.repeat(np.arange(len(first)), n)
        s = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        return i, owner[i], spans.hashes(begin[i] + s, begin[i] + s + length).view(np.int64), s, np.ones(len(i), np.int64)

    schema = "part long, content long, home int, row long, first long, n long, place long, owner long, whole boolean, others binary"
    one = judged(by_home(rows, "row").mapInArrow(at_home(tell_segments), schema), ["part"], "segments")
    two = judged(by_home(one.where("beside"), "row", "first").mapInArrow(at_home(finer(groups)), schema), ["part"], "groups")
    three = judged(by_home(two.where("beside"), "row", "first").mapInArrow(at_home(finer(windows)), schema), ["part", "content"], "windows")
    marks = one.union(two).union(three).where("marked").select("home", "row", "first", "n", "others")
    marks = marks.union(rows.select("home", "row", F.lit(-1).cast("long"), F.col("copied").cast("long"), F.lit(None).cast("binary")))  # at least one row for each text
    schema = T.StructType([*docs.schema, *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans"))])

    def cut(home: int, stored: Iterator[pa.RecordBatch], wanted: pa.Table) -> Iterator[pa.RecordBatch]:
        at = 0
        row, first, n = (wanted[c].to_numpy() for c in ("row", "first", "n"))
        more = wanted["others"].combine_chunks() if wanted.num_rows else wanted["others"]
        with_more = np.flatnonzero(np.asarray(more.is_valid()))
        if len(with_more):
            packed = [np.frombuffer(more[int(i)].as_buffer(), np.int64).reshape(-1, 2) for i in with_more]
            rest = np.concatenate(packed)
            row, first = np.append(row, rest[:, 0]), np.append(first, rest[:, 1])
            n = np.append(n, np.repeat(n[with_more], [len(x) for x in packed]))
            order = np.argsort(row, kind="stable")
            row, first, n = row[order], first[order], n[order]
        all_ = np.zeros(int(row[-1]) + 1, bool)
        all_[row[(first < 0) & (n > 0)]] = True
        real = first >= 0
        row, first, n = row[real], first[real], n[real]
        for batch in stored:
            data, bounds = text_buffer(batch.column("text"))
            change = np.zeros(len(data) + 1, np.int32)
            a, b = np.searchsorted(row, [at, at + batch.num_rows])
            begin = bounds[row[a:b] - at] + first[a:b]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + n[a:b] + length - 1, -1)
            gone = np.flatnonzero(all_[at : at + batch.num_rows])
            np.add.at(change, bounds[gone], 1)
            np.add.at(change, bounds[gone + 1], -1)
            out = np.cumsum(change[:-1]) > 0
            edge = out.copy()
            edge[1:] &= ~out[:-1]
            starts = bounds[:-1][np.diff(bounds) > 0]
            edge[starts] = out[starts]
            removed, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (out, edge))
            kept, left = data[~out].tobytes(), bounds - removed[bounds]
            parts = [kept[x:y] for x, y in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
            texts = [hashlib.sha256(p).hexdigest() for p in parts] if digest_only else [p.decode("utf-8", "ignore") for p in parts]
            counts = [pa.array(np.diff(x)) for x in (bounds, removed[bounds], runs[bounds])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), *counts], ["row", "text", "n_bytes", "n_removed", "n_spans"])
            at += batch.num_rows

    return by_home(marks, "row", "first").mapInArrow(at_home(cut), schema)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    t = remove_repeats(docs, digest_only=True)
    return t.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.col("text").alias("kept_sha256"))

"""Operator 10, media columns in content-defined chunks.

A payload (8-bit samples) is cut where a rolling gear hash of the last 64 bytes has its top bits
at 0, between LEAST and MOST bytes. Each task compresses the chunks that it meets into a pack, one
that it has met before once. Digests are then grouped over all packs: each is owned by the first
place that holds it. A task for each pack copies the owned frames to the pack's final form and deletes
the first one, so every chunk is stored once, whichever tasks met it, no payload is shuffled, and the
folder holds little more than one copy at any time. Chunk lists are joined with the final places.

Reading back takes each payload's ordered chunk list, reads places by range, checks each chunk's
digest and joins the chunks. The stored form of a payload is the list in a header, then its samples:
`QCDC`, number of chunks (4 bytes), bytes (8), for each chunk length (4) and SHA-256 (32), samples.

Packs are written under an attempt's name and renamed, so a task that runs again replaces them; one
that finds a final pack leaves it, as its places follow from the list of owned frames.

Null text counts as empty: a payload of padding. A null id keeps its row; rows are told apart by
their place, so repeated ids and texts give a row each. An empty table gives no rows. A very long text is
held whole, its chunks are not. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attempt, file_system, new_folder, remove, shared_folder, slices, written
from .hashing import BYTE_HASH, text_buffer

FRAME = 576
LEAST, BITS, MOST = 1024, 12, 16384
#: Chunks that a task remembers as met.
MET = 200_000


def gear(data: np.ndarray) -> np.ndarray:
    """Sum over the last 64 bytes of each byte's random number, shifted by its distance."""
    h = BYTE_HASH[data]
    for k in (1, 2, 4, 8, 16, 32):
        h[k:] = h[k:] + (h[:-k] << np.uint64(k))
    return h


def cuts(candidates: np.ndarray, a: int, b: int) -> list[int]:
    """Ends of the chunks of a payload at a..b; candidates: sorted places after which the hash allows a cut."""
    out, at = [], a
    while b - at > LEAST:
        i = np.searchsorted(candidates, at + LEAST - 1)
        end = int(candidates[i]) + 1 if i < len(candidates) else b
        at = min(end, at + MOST, b)
        out.append(at)
    if at < b:
        out.append(b)
    return out


def padded(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Payloads one after the other, their bounds, and the texts' own sizes."""
    data, bounds = text_buffer(texts)
    raw, sizes = data.tobytes(), np.diff(bounds)
    full = np.maximum(-(-sizes // FRAME), 1) * FRAME
    parts = [raw[a:b] + b"\xff" * p for a, b, p in zip(bounds[:-1].tolist(), bounds[1:].tolist(), (full - sizes).tolist(), strict=True)]
    return b"".join(parts), np.concatenate([[0], np.cumsum(full)]), sizes


def store(docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the chunks that each task meets; returns the chunk lists: row, id, n_bytes, payload_bytes, ord, digest, size, pack, place, length."""
    root = new_folder(f"{folder}/met")
    names = ["row", "id", "n_bytes", "payload_bytes", "ord", "digest", "size", "pack", "place", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, packer = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3, write_content_size=True)
        with attempt(root, f"{pack:06d}") as out:
            yield from chunked(batches, pack, packer, out)

    def chunked(batches: Iterator[pa.RecordBatch], pack: int, packer, out) -> Iterator[pa.RecordBatch]:
        place, row, met = 0, pack << 40, {}
        limit = np.uint64(1 << (64 - BITS))
        for batch in slices(batches, "text", 1 << 20):
            raw, bounds, sizes = padded(batch.column("text"))
            at = np.flatnonzero(gear(np.frombuffer(raw, np.uint8)) < limit)
            rows: list[tuple] = []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                begin = a
                for ord_, end in enumerate(cuts(at, a, b)):
                    chunk = raw[begin:end]
                    digest = hashlib.sha256(chunk).digest()
                    if digest not in met:
                        frame = packer.compress(chunk)
                        out.write(frame)
                        if len(met) >= MET:
                            met = {}
                        met[digest] = (place, len(frame))
                        place += len(frame)
                    rows.append((row, i, ord_, digest, end - begin, *met[digest]))
                    begin = end
                row += 1
            r, i, o, d, s, p, n = zip(*rows, strict=True)
            i = np.array(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, pa.int64()), batch.column("id").take(pa.array(i)), pa.array(sizes[i]), pa.array(np.diff(bounds)[i]), pa.array(o, pa.int32()), pa.array(d, pa.binary()), pa.array(s, pa.int32()), pa.array([pack] * len(r), pa.int32()), pa.array(p, pa.int64()), pa.array(n, pa.int32())],
                names,
            )

    t = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return written(t.mapInArrow(run, "row long, id long, n_bytes long, payload_bytes long, ord int, digest binary, size int, pack int, place long, length int"), folder, "chunks")


def keep_one(chunks: DataFrame, folder: str) -> DataFrame:
    """Store each chunk once; returns digest, pack, place, length."""
    met, packs = f"{folder}/met", new_folder(f"{folder}/packs")
    last, n = chunks.agg(F.max("pack"), F.count("*")).first()
    owned = chunks.groupBy("digest").agg(F.min(F.struct("pack", "place", "length")).alias("at")).select("at.pack", "at.place", "at.length", "digest")

    def copy(pack: int, frames: list[tuple[int, int]]) -> None:
        name = f"{pack:06d}"
        fs, final = file_system(f"{packs}/{name}")
        if fs.get_file_info(final).type != pafs.FileType.NotFound:
            return
        first = file_system(f"{met}/{name}")[1]
        with attempt(packs, name) as out, fs.open_input_file(first) as pack_met:
            for place, length in frames:
                out.write(pack_met.read_at(length, place))
        fs.delete_file(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = batch.column("pack").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and b > a and held[0].column("pack")[0].as_py() != at[a]:
                    yield compacted(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield compacted(held)

    def compacted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        lengths = t["length"].to_numpy()
        copy(t["pack"][0].as_py(), list(zip(t["place"].to_pylist(), lengths.tolist(), strict=True)))
        one = t.combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([one.column("digest"), one.column("pack"), pa.array(np.cumsum(lengths, dtype=np.int64) - lengths), one.column("length")], ["digest", "pack", "place", "length"])

    by_pack = owned.repartitionByRange((last or 0) + 1, "pack").sortWithinPartitions("pack", "place")
    places = written(by_pack.mapInArrow(run, "digest binary, pack int, place long, length int"), folder, "places", 64 * n)
    remove(chunks.sparkSession, met)
    return places


def chunk_lists(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """A row for each payload with its chunks in order, each at the place of its digest.

    Payloads of one pack stay together, one task for each pack: rows are few, but each stands for bytes to read.
    """
    packs = (chunks.agg(F.max("pack")).first()[0] or 0) + 1
    t = chunks.select("row", "id", "n_bytes", "payload_bytes", "ord", "digest", "size").join(places, "digest")
    return t.repartitionByRange(packs, "row").groupBy("row").agg(F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("ord", "pack", "place", "length", "size", "digest"))).alias("chunks"))


def features(payload: np.ndarray) -> str:
    """Frames, mean and mean square of the samples, crossings of 128, and shares of eight ranges, in integers per million."""
    n, x = len(payload), payload.astype(np.int64)
    high = payload >= 128
    shares = np.bincount(payload >> 5, minlength=8) * 1_000_000 // n
    return f"frames={n // FRAME};mean={int(x.sum()) * 1000 // n};square={int((x * x).sum()) * 1000 // n};cross={int((high[1:] != high[:-1]).sum())};shares={','.join(map(str, shares.tolist()))}"


class Packs:
    """Chunks by place; the last few packs stay open."""

    def __init__(self, root: str):
        self.fs, self.path = file_system(root)
        self.open: dict[int, object] = {}
        self.unpack = zstandard.ZstdDecompressor().decompress

    def chunk(self, pack: int, place: int, length: int, digest: bytes) -> bytes:
        if pack not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[pack] = self.fs.open_input_file(f"{self.path}/{pack:06d}")
        out = self.unpack(self.open[pack].read_at(length, place))
        if hashlib.sha256(out).digest() != digest:
            raise ValueError(f"a chunk in pack {pack} at {place} doesn't have its digest")
        return out


def read_back(lists: DataFrame, folder: str) -> DataFrame:
    """Digests, stored form and features of each payload, from the packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = Packs(f"{folder}/packs")
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part, rows = batch.slice(i, 500), []
                for chunks in part.column("chunks").to_pylist():
                    payload = b"".join(packs.chunk(c["pack"], c["place"], c["length"], c["digest"]) for c in chunks)
                    head = b"QCDC" + struct.pack("<IQ", len(chunks), len(payload)) + b"".join(struct.pack("<I", c["size"]) + c["digest"] for c in chunks)
                    form = hashlib.sha256(head)
                    form.update(payload)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(head) + len(payload), form.hexdigest(), features(np.frombuffer(payload, np.uint8))))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return lists.select("id", "n_bytes", "chunks").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as samples, read the stored bytes back."""
    folder = shared_folder(spark, "media")
    chunks = store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_back(chunk_lists(chunks, keep_one(chunks, folder)), folder)

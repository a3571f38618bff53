"""Operator 6, token ids in Arrow stream files of equal-length sequences with masks.

Documents are dealt out by ranges of doc_id and sorted. Each task encodes its range, appends the
end id to each document, and writes one stream file: batches of fixed-size lists `ids` (unsigned 16
bits where the tokenizer's largest id and the end id allow it, else 32) and `mask` (false where the last sequence is padded).
All batches but the last of a file have the same number of rows and bytes, so any sequence is found by
arithmetic; in a mapped file it and its mask are slices of the file, without a copy. A manifest has shard, place and length of each document;
the start over all shards is the sum of the shards before plus the place within.

A shard is written to a file named after the attempt and then renamed, so a task that runs again
replaces it by the same bytes.

Null text counts as empty (the end id alone). Null doc_id comes first, repeated doc_ids go by
text. A very long text is encoded whole and spread over as many batches as it needs. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import library_encoder, tokenizer_path
from .common import attempt, file_system, new_folder, shared_folder, slices, written

SEQUENCE = 2048
#: Sequences in a batch.
ROWS = 64
#: Bytes of the mark that ends an Arrow stream.
END = 8


def sequences(flat: np.ndarray, filled: int, length: int) -> pa.RecordBatch:
    """A batch of whole sequences, of which `filled` ids are real."""
    mask = np.arange(len(flat)) < filled
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], ["ids", "mask"])


def id_kind(tokenizer: str, end_id: int) -> type:
    """The unsigned type that holds all ids of a tokenizer and the end id."""
    from tokenizers import Tokenizer

    most = max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())
    return np.uint16 if most < 1 << 16 else np.uint32


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, length: int = SEQUENCE, rows: int = ROWS, wide: bool = False) -> DataFrame:
    """Write the shards; returns the manifest: shard, doc_id, place, n_tokens, start. wide: 32 bits in any case."""
    kind = np.uint32 if wide else id_kind(tokenizer, end_id)
    root = new_folder(f"{folder}/shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        with attempt(root, f"{shard:06d}.arrow") as out:
            yield from filled(batches, shard, encoder, out)

    def filled(batches: Iterator[pa.RecordBatch], shard: int, encoder, out) -> Iterator[pa.RecordBatch]:
        held, room, place, writer, most = [], 0, 0, None, length * rows
        for batch in slices(batches, "text", 1 << 20):
            writer = writer or pa.ipc.new_stream(out, sequences(np.zeros(0, kind), 0, length).schema)
            flat, counts = encoder.encode(batch.column("text"))
            held.append(np.insert(flat, np.cumsum(counts), end_id).astype(kind))
            sizes = counts + 1
            room += len(held[-1])
            if room >= most:
                flat = np.concatenate(held)
                whole = room // most * most
                for a in range(0, whole, most):
                    writer.write_batch(sequences(flat[a : a + most], most, length))
                held, room = [flat[whole:].copy()], room - whole
            places = place + np.cumsum([0, *sizes], dtype=np.int64)
            place = int(places[-1])
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(sizes), pa.int32()), batch.column("doc_id"), pa.array(places[:-1]), pa.array(sizes)], ["shard", "doc_id", "place", "n_tokens"])
        if writer is not None:
            if room:
                flat = np.zeros(-(-room // length) * length, kind)
                flat[:room] = np.concatenate(held)
                writer.write_batch(sequences(flat, room, length))
            writer.close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = written(ordered.mapInArrow(run, "shard int, doc_id long, place long, n_tokens long"), folder, "manifest")
    # one row for each shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return manifest.join(bases, "shard").select("shard", "doc_id", "place", "n_tokens", (F.col("base") + F.col("place")).alias("start"))


class TokenFile:
    """Random access to one shard: mapped if it lies in a local file system, else read by ranges.

    All batches of a stream but the last have the same size in bytes, so batch k begins k strides
    after the first; what is handed out are views of the file's bytes.
    """

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.file))
        self.length = self.schema.field("ids").type.list_size
        self.first, self.at, self.held = self.file.tell(), -1, None
        self.per = self._batch(0).num_rows
        self.stride = self.file.tell() - self.first

    def _batch(self, k: int) -> pa.RecordBatch:
        """Batch k; the last one read is kept."""
        if k != self.at:
            place = self.first + k * self.stride if k else self.first
            if place >= self.file.size() - END:
                raise EOFError("the file ends before")
            self.file.seek(place)
            self.at, self.held = k, pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)
        return self.held

    def take(self, place: int, n: int) -> np.ndarray:
        """n ids from `place` on."""
        out, most = [], self.per * self.length
        while n > 0:
            k, a = divmod(place, most)
            got = self._batch(k).column("ids").flatten().to_numpy()[a : a + n]
            if not len(got):
                raise EOFError("the file ends before the document does")
            out.append(got)
            place, n = place + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence i, without a copy."""
        k, row = divmod(i, self.per)
        try:
            batch = self._batch(k)
        except EOFError:
            raise IndexError(i) from None
        if row >= batch.num_rows:
            raise IndexError(i)
        a, n = row * self.length, self.length
        return batch.column("ids").flatten().to_numpy()[a : a + n], batch.column("mask").flatten().slice(a, n)


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Each document of the manifest with a checksum of its ids, read from the shards."""
    root = f"{folder}/shards"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for batch in batches:
            sums = []
            for shard, place, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "place", "n_tokens")), strict=True):
                if shard != at:
                    at, file = shard, TokenFile(f"{root}/{shard:06d}.arrow")
                sums.append(zlib.crc32(file.take(place, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition("shard").sortWithinPartitions("shard", "place").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Write all documents as token files, read them back."""
    folder = shared_folder(spark, "token-files")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer or tokenizer_path())
    return read_documents(manifest, folder)

"""Operator 3, BPE encoding and decoding; its encoder with a cache also serves operator 6.

A text is cut where no pre-token can reach across: before a space or line break that follows
anything but white space, and before ASCII punctuation that follows an ASCII letter. The pieces
repeat a lot, so each worker keeps the ids of those that it has met in a table of bounded size,
keyed by 64-bit hashes; finding pieces, looking them up and laying out their ids are array
operations over a slice of a batch. A piece met for the first time is pre-tokenized and merged.

Merging: a priority queue holds (rank, place, left, right) for neighbours that the merge list
knows; symbols form a doubly linked list. The lowest rank is taken first; an entry whose symbols
have changed since is stale and skipped. Decoding concatenates vocabulary strings and maps their
characters back to bytes.

Null text counts as empty and gives no ids. Repeated rows, ties and empty tables need no special
case: each row stands alone, and rows out are rows in. A very long text is encoded whole, its pieces and
ids as arrays. Other columns travel in one struct, whatever their names; an input column that has the
name of an output column is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, trimmed
from .hashing import Spans, text_buffer

#: Bytes of text that are worked on at once; arrays over them take some hundred times as much.
SLICE = 1 << 18
#: Slots of a worker's table of pieces, a power of two, and pieces after which it starts anew.
SLOT_BITS = 20
CACHE = 600_000
_PROBES = 8

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [*range(9, 14), *range(28, 33)])
_CUT_SPACE = np.isin(_BYTES, [10, 32])
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122)
_PUNCTUATION = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~((_BYTES >= 48) & (_BYTES <= 57))


def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of UTF-8 texts begin; starts: where non-empty texts begin.

    Within a run of white space only its first character may begin a piece. Three-byte characters
    led by E1 to E3 hold the rarer white space, so nothing is cut after one of those.
    """
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        cut[1:] = _CUT_SPACE[b] & ~_SPACE[a] | _PUNCTUATION[b] & _LETTER[a]
    if len(data) > 2:
        two = (data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0))
        cut[2:] &= ~two
    if len(data) > 3:
        cut[3:] &= ~((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3))
    cut[starts] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Ids of texts, by a function that encodes pieces."""

    def __init__(self, encode_pieces: Callable[[list[bytes]], list[list[int]]], specials: dict[str, int]):
        self.encode_pieces = encode_pieces
        self.specials = {k.encode(): v for k, v in specials.items()}
        self.pattern = re.compile(b"|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))))
        self.mask = np.uint64((1 << SLOT_BITS) - 1)
        self.shift = np.uint64(64 - SLOT_BITS)
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.entry = np.zeros(1 << SLOT_BITS, np.int32)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.count, self.entries = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """New entries, numbered from self.entries on; those that find no slot are used once."""
        counts = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.array([x for y in ids for x in y], np.uint32)
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while self.entries + len(keys) > len(self.at):
            self.at, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.count))
        new = slice(self.entries, self.entries + len(keys))
        self.store[self.used : self.used + len(flat)] = flat
        self.at[new] = self.used + np.cumsum(counts) - counts
        self.count[new] = counts
        left = np.arange(len(keys))
        for k in range(_PROBES):
            slot = ((keys[left] >> self.shift) + np.uint64(k)) & self.mask
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]  # of several that want one slot the last gets it
            won = free & (self.keys[slot] == keys[left])
            self.entry[slot[won]] = self.entries + left[won]
            left = left[~won]
            if not len(left):
                break
        self.used += len(flat)
        self.entries += len(keys)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        slot = (keys >> self.shift) & self.mask
        found = np.where(self.keys[slot] == keys, self.entry[slot], -1)
        left = np.flatnonzero((found < 0) & (self.keys[slot] != 0))
        for k in range(1, _PROBES):
            if not len(left):
                break
            slot = ((keys[left] >> self.shift) + np.uint64(k)) & self.mask
            hit = self.keys[slot] == keys[left]
            found[left[hit]] = self.entry[slot[hit]]
            left = left[~hit & (self.keys[slot] != 0)]
        return found

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts data[bounds[i]:bounds[i + 1]], one after the other, and their counts."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        if self.entries > CACHE:
            self.reset()
        starts = piece_starts(data, bounds[:-1][np.diff(bounds) > 0])
        ends = np.append(starts[1:], len(data))
        keys = Spans(data).hashes(starts, ends)
        keys[keys == 0] = 1
        found = self._find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            raw = data.tobytes()
            first = missing[first]
            pieces = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            base = self.entries
            self._add(new, self.encode_pieces(pieces))
            found[missing] = base + np.searchsorted(new, keys[missing])
        counts = self.count[found].astype(np.int64)
        total = np.cumsum(counts)
        ids = self.store[np.repeat(self.at[found] - (total - counts), counts) + np.arange(total[-1])]
        till = np.concatenate([[0], total])[np.searchsorted(starts, bounds)]
        return ids, np.diff(till)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each text's ids; null: none."""
        data, bounds = text_buffer(texts)
        if self.specials and self.pattern.search(data):
            return self._with_specials(data.tobytes(), bounds)
        return self._encode(data, bounds)

    def _with_specials(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain, owner, special = [], [], []
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            at = a
            for m in self.pattern.finditer(raw[a:b]):
                plain.append((at, a + m.start()))
                special.append(self.specials[m[0]])
                owner.append(i)
                at = a + m.end()
            plain.append((at, b))
            special.append(-1)
            owner.append(i)
        kept = [raw[a:b] for a, b in plain]
        ids, counts = self._encode(np.frombuffer(b"".join(kept), np.uint8), np.cumsum([0, *map(len, kept)]))
        special, owner = np.array(special), np.array(owner)
        put = special >= 0
        ids = np.insert(ids, np.cumsum(counts)[put], special[put].astype(np.uint32))
        return ids, np.bincount(owner, counts + put, len(bounds) - 1).astype(np.int64)


def byte_table() -> dict[int, str]:
    """For str.translate: Latin-1 characters to those of the byte-level vocabulary."""
    return dict(enumerate(byte_characters()))


def plain_word(text: str) -> bool:
    """Whether a piece is one pre-token for certain: letters below U+0250, after a space or none."""
    word = text[1:] if text[:1] == " " else text
    return word.isalpha() and max(word) < "\u0250"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that are printable in Latin-1 stand for themselves; the others take the code points from
    256 on, in order.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class HeapBpe:
    """Byte-level BPE from a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE file is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        to_byte = {c: i for i, c in enumerate(byte_characters())}
        self.table = byte_table()
        self.strings: list[bytes] = [b""] * (1 + max([*self.vocab.values(), *self.specials.values()]))
        for s, i in self.vocab.items():
            self.strings[i] = bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode()
        for s, i in self.specials.items():
            self.strings[i] = s.encode()
        self.sizes = np.array([*map(len, self.strings)], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.strings), np.uint8)
        self.decimal = [*map(str, range(len(self.strings)))]

    def merged(self, token: str) -> list[int]:
        """Ids of one pre-token."""
        vocab, ranks = self.vocab, self.ranks
        ids = [vocab[c] for c in token]
        n = len(ids)
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        queue = []
        for i in range(n - 1):
            if m := ranks.get((ids[i], ids[i + 1])):
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := ranks.get((new, ids[k])):
                    heapq.heappush(queue, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := ranks.get((ids[h], new))):
                heapq.heappush(queue, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out, split, merged = [], self.split, self.merged
        for piece in pieces:
            text = piece.decode()
            if plain_word(text):
                out.append(merged(piece.decode("latin-1").translate(self.table)))
            else:
                out.append([i for token, _ in split(text) for i in merged(token)])
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids that stand one after the other."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.strings)):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.sizes[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.flat[np.repeat(self.at[ids] - total[:-1], sizes) + np.arange(total[-1])].tobytes()
        ends = total[np.cumsum(counts)]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


@lru_cache(maxsize=2)
def heap_encoder(path: str) -> tuple[HeapBpe, PieceEncoder]:
    bpe = HeapBpe(path)
    return bpe, PieceEncoder(bpe.encode_pieces, bpe.specials)


@lru_cache(maxsize=2)
def library_encoder(path: str) -> PieceEncoder:
    """The tokenizers library's ids, piece by piece."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    specials = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    tok.encode_special_tokens = True  # the encoder cuts them out itself
    model, table = tok.model, byte_table()

    def encode_pieces(pieces: list[bytes]) -> list[list[int]]:
        out = []
        for piece in pieces:
            text = piece.decode()
            if plain_word(text):
                out.append([t.id for t in model.tokenize(piece.decode("latin-1").translate(table))])
            else:
                out.append(tok.encode(text, add_special_tokens=False).ids)
        return out

    return PieceEncoder(encode_pieces, specials)


def _mapped(df: DataFrame, of: str, out: str, work: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """Struct `row` with the other columns of df, and the columns `out` (a schema) made from the column `of`, slice by slice."""
    names = [f.name for f in T.StructType.fromDDL(out)]
    of_text = isinstance(df.schema[of].dataType, T.StringType)
    kept = [F.col(f"`{c}`") for c in df.columns if c != of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = slices(batches, "of", SLICE) if of_text else (b.slice(i, 400) for b in batches for i in range(0, b.num_rows, 400))
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column("row"), *work(part.column("of"))], ["row", *names])

    t = df.select(F.struct(*kept).alias("row") if kept else F.struct(F.lit(0).alias("none")).alias("row"), F.col(f"`{of}`").alias("of"))
    return t.mapInArrow(trimmed(run), T.StructType([t.schema["row"], *T.StructType.fromDDL(out)]))


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of its texts, an array of int, in place of the texts; null text gives an empty array."""

    def work(texts: pa.Array) -> list[pa.Array]:
        flat, counts = heap_encoder(tokenizer)[1].encode(texts)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int32)))]

    t = _mapped(df, text, "made array<int>", work)
    return t.select(*(F.col(f"row.`{c}`") for c in df.columns if c not in (text, ids)), F.col("made").alias(ids))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the texts of its ids in their place; null ids give an empty text, unknown ids an error."""

    def work(column: pa.Array) -> list[pa.Array]:
        offsets = np.asarray(column.offsets)
        counts = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return [pa.array(heap_encoder(tokenizer)[0].decode(flat, counts), pa.string())]

    t = _mapped(df, ids, "made string", work)
    return t.select(*(F.col(f"row.`{c}`") for c in df.columns if c not in (text, ids)), F.col("made").alias(text))


def round_trip(df: DataFrame, tokenizer: str, text: str = "text", digest_only: bool = False) -> DataFrame:
    """Struct `row` with the other columns of df, n_tokens, ids_sha256 and the decoded text, in one pass: ids stay in the task.

    digest_only: the SHA-256 of the decoded text instead.
    """

    def work(texts: pa.Array) -> list[pa.Array]:
        bpe, encoder = heap_encoder(tokenizer)
        flat, counts = encoder.encode(texts)
        decoded = bpe.decode(flat, counts)
        ends = np.cumsum(counts).tolist()
        joined = (",".join(map(bpe.decimal.__getitem__, flat[a:b].tolist())) for a, b in zip([0, *ends], ends, strict=False))
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in joined]
        if digest_only:
            decoded = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
        return [pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]

    return _mapped(df, text, "n_tokens long, ids_sha256 string, decoded string", work)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Encode and decode every text of documents; digests of ids and of decoded texts."""
    tokenizer = tokenizer or tokenizer_path()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, tokenizer, digest_only=True).select("row.doc_id", "n_tokens", "ids_sha256", F.col("decoded").alias("decoded_sha256"))

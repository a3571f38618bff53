"""Operator 9, WARC archives with a two-level capture index.

Every page becomes a record in a gzip member of its own. Among payloads of LEAST bytes or more
that are equal, the one with the smallest page_id is a response; the others are revisits, which
name it and carry no payload (their HTTP headers keep the payload's length). Smaller ones are responses.

Writing: tasks store their rows in files of the shared folder (homes) and tell only digests, which
are grouped; then a task for each home reads it again with the decisions and writes its records. So
no html is shuffled, and equal pages never meet.

Captures are sorted by reversed-host URL key and page_id and cut into compressed blocks of BLOCK
lines. The directory has two levels: beside each index file lies a sparse list with the first capture
and the place of each of its blocks, and the first captures of all index files make the top. A lookup
bisects the top and a file's list, reads a block by range, and reads the records that it names by
range. Reading an archive back looks up every capture that is asked for, in order of the keys.

Files are written under an attempt's name and renamed, so a task that runs again replaces them.

Null html is an empty payload. A null url has an empty key. A null page_id keeps its row; it never
is the smallest. Repeated rows of one page are all responses if theirs is the smallest id. An empty
table writes no file and gives no rows. A very long payload is held whole by the task that writes or reads its record. Other columns are not read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Home, attempt, file_system, home_rows, new_folder, remove, shared_folder, slices, written

LEAST = 100
BLOCK = 1000
#: The date of all captures, a parameter so that archives can be made again byte by byte.
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://www.A.com:80/B?c gives com,a)/b?c ."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return quote(url.strip().lower(), safe="/:?#[]@!$&'()*+,;=%")
    host = host.removeprefix("www.")
    at = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(f"{at}){path}".lower(), safe="/:?#[]@!$&'()*+,;=%")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A gzip member with one WARC record."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": quote(url or "", safe="/:?#[]@!$&'()*+,;=%~"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Page-Id": "" if page_id is None else str(page_id),
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(refers_to), "X-Refers-To-Page-Id": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers of a record, its payload's whole length, and the payload that it carries."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, int(re.search(rb"Content-Length: (\d+)", http)[1]), payload


def _refers_to(pages: DataFrame, folder: str, least: int) -> tuple[DataFrame, int, int]:
    """home, row and refers_to of every page, after writing the pages to homes; and the numbers of homes and pages."""
    root = new_folder(f"{folder}/homes")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Home(root) as home:
            for batch in slices(batches, "html"):
                row = home.write(batch)
                html = pc.fill_null(batch.column("html"), "")
                digests = [hashlib.sha256(h.as_buffer()).digest() for h in html]
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([home.number] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), batch.column("page_id"), pc.binary_length(html).cast(pa.int64()), pa.array(digests, pa.binary())], ["home", "row", "page_id", "n", "digest"])

    t = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = written(t.mapInArrow(settle, "home int, row long, page_id long, n long, digest binary"), folder, "rows")
    first = rows.where(f"n >= {least}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL")
    refers = F.when((F.col("n") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    last, n = rows.agg(F.max("home"), F.count("*")).first()
    return rows.join(first, "digest", "left").select("home", "row", F.hex("digest").alias("digest"), refers.alias("refers_to")), (last or 0) + 1, n


def write_archive(pages: DataFrame, folder: str, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """Write records and index of pages (page_id, url, html); returns the top of the directory: key, page_id, file."""
    decided, homes, n = _refers_to(pages, folder, least)
    root, records = f"{folder}/homes", new_folder(f"{folder}/records")

    def write(home: int, stored: Iterator[pa.RecordBatch], wanted: pa.Table) -> Iterator[pa.RecordBatch]:
        file, place, at = f"part-{home:06d}.warc.gz", 0, 0
        digests, refers = wanted["digest"].to_pylist(), wanted["refers_to"].to_pylist()
        with attempt(records, file) as out:
            for batch in stored:
                keys, lines = [], []
                for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                    page_id, url, digest, refers_to = page_id.as_py(), url.as_py(), digests[at].lower(), refers[at]
                    member = record(page_id, url, (html.as_py() or "").encode(), digest, refers_to)
                    out.write(member)
                    keys.append(url_key(url))
                    lines.append(json.dumps({"page": page_id, "type": "response" if refers_to is None else "revisit", "digest": digest, "file": file, "place": place, "length": len(member)}))
                    place, at = place + len(member), at + 1
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column("page_id"), pa.array(lines, pa.string())], ["key", "page_id", "line"])

    by_home = decided.repartitionByRange(homes, "home").sortWithinPartitions("home", "row")
    captures = written(by_home.mapInArrow(lambda it: home_rows(root, it, write), "key string, page_id long, line string"), folder, "captures", 400 * n)
    index = new_folder(f"{folder}/index")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, place, held, rows = f"cdx-{TaskContext.get().partitionId():06d}.gz", 0, [], []
        with attempt(index, file) as out:
            for batch in batches:
                for capture in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "line")), strict=True):
                    held.append(capture)
                    if len(held) == block:
                        rows.append((*_capture(*held[0][:2]), place, _write_block(out, held)))
                        place, held = place + rows[-1][3], []
            if held:
                rows.append((*_capture(*held[0][:2]), place, _write_block(out, held)))
        if rows:
            with attempt(index, f"{file}.json") as out:
                out.write(json.dumps(rows).encode())
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([rows[0][1]], pa.int64()), pa.array([file])], ["key", "page_id", "file"])

    order = [F.col("key"), F.col("page_id").asc_nulls_first(), F.col("line")]
    ordered = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    top = written(ordered.mapInArrow(blocks, "key string, page_id long, file string"), folder, "directory")
    for name in ("homes", "rows", "captures"):
        remove(pages.sparkSession, f"{folder}/{name}")
    return top


def _capture(key: str, page_id: int | None) -> tuple[str, int]:
    """A capture's place in the order of the index; null ids come first."""
    return key, -(1 << 63) if page_id is None else page_id


def _write_block(out, captures: list[tuple]) -> int:
    member = gzip.compress("".join(f"{k} {x}\n" for k, _, x in captures).encode(), 6, mtime=0)
    out.write(member)
    return len(member)


class Files:
    """Range reads of files in a folder; the last few stay open."""

    def __init__(self, root: str, most: int = 64):
        self.fs, self.path = file_system(root)
        self.open: dict[str, object] = {}
        self.most = most

    def read(self, file: str, place: int, length: int) -> bytes:
        if file not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[file] = self.fs.open_input_file(f"{self.path}/{file}")
        return self.open[file].read_at(length, place)

    def whole(self, file: str) -> bytes:
        with self.fs.open_input_stream(f"{self.path}/{file}") as f:
            return f.read()


class Archive:
    """Lookups by bisection. top: the first capture and the name of each index file, one row for each."""

    def __init__(self, folder: str, top: list[tuple[str, int | None, str]]):
        rows = sorted((*_capture(key, page_id), file) for key, page_id, file in top)
        self.firsts, self.files = [r[:2] for r in rows], [r[2] for r in rows]
        self.index, self.records = Files(f"{folder}/index"), Files(f"{folder}/records")
        self.list: tuple[str, list, list] = ("", [], [])
        self.block: tuple[tuple, list] = ((), [])

    def _list(self, file: str) -> tuple[list, list]:
        """First captures and places of a file's blocks; that of the last file is kept."""
        if self.list[0] != file:
            rows = json.loads(self.index.whole(f"{file}.json"))
            self.list = file, [(r[0], r[1]) for r in rows], [(r[2], r[3]) for r in rows]
        return self.list[1:]

    def _block(self, file: str, place: int, length: int) -> list[tuple[tuple[str, int], dict]]:
        if self.block[0] != (file, place):
            text = zlib.decompress(self.index.read(file, place, length), 31).decode()
            lines = [(k, json.loads(x)) for k, _, x in (line.partition(" ") for line in text.split("\n")[:-1])]
            self.block = (file, place), [(_capture(k, x["page"]), x) for k, x in lines]
        return self.block[1]

    def captures(self, low: tuple[str, int], high: tuple[str, int]) -> Iterator[dict]:
        """Index lines of captures from low to high, in order."""
        for i in range(max(0, bisect.bisect_left(self.firsts, low) - 1), bisect.bisect_right(self.firsts, high)):
            firsts, places = self._list(self.files[i])
            for j in range(max(0, bisect.bisect_left(firsts, low) - 1), bisect.bisect_right(firsts, high)):
                block = self._block(self.files[i], *places[j])
                a, b = bisect.bisect_left(block, low, key=lambda x: x[0]), bisect.bisect_right(block, high, key=lambda x: x[0])
                yield from (x for _, x in block[a:b])

    def read(self, capture: dict) -> tuple[dict[str, str], int, bytes]:
        return parsed(self.records.read(capture["file"], capture["place"], capture["length"]))

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Headers and payloads of all captures of a URL."""
        key = url_key(url)
        return [(head, payload) for head, _, payload in map(self.read, self.captures((key, -(1 << 63)), (key, (1 << 63) - 1)))]


def read_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Every record of pages (page_id, url): page_id, payload_bytes, payload_digest, record_type, refers_to.

    The captures asked for are sorted like the index, so a task reads each block that it needs once. The
    top of the directory, a row for each index file, is read by each task.
    """
    folder_of_top = f"{folder}/directory"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(url_key, batch.column("url").to_pylist()), pa.string()), batch.column("page_id")], ["key", "page_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                if archive is None:
                    top = ds.dataset(file_system(folder_of_top)[1], filesystem=file_system(folder_of_top)[0], format="parquet").to_table()
                    archive = Archive(folder, list(zip(*(top[c].to_pylist() for c in ("key", "page_id", "file")), strict=True)))
                found = [x for key, page_id in zip(part.column("key").to_pylist(), part.column("page_id").to_pylist(), strict=True) for x in archive.captures(_capture(key, page_id), _capture(key, page_id))]
                out = []
                for x in sorted(found, key=lambda x: (x["file"], x["place"])):
                    head, n, payload = archive.read(x)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    page, revisit = int(head["X-Page-Id"]) if head["X-Page-Id"] else None, head["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"page {page}: the payload doesn't have its digest")
                    out.append((page, n, digest, head["WARC-Type"], int(head["X-Refers-To-Page-Id"]) if revisit else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    order = [F.col("key"), F.col("page_id").asc_nulls_first()]
    t = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    wanted = t.mapInArrow(keyed, "key string, page_id long").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    return wanted.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as an archive with its index, read it back."""
    folder = shared_folder(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_archive(pages, folder)
    return read_archive(pages, folder)


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""

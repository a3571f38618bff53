"""Containers of fragments: images of SQLite databases, alone or in a zip archive, as a table of fragments.

A container is read whole in a task. Tables: fragments (id, payload_type, payload_value), fragment_properties (id, key,
value), capabilities (key, version).
"""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FRAGMENTS = "container string, id string, kind string, element string, location string, data binary, error string"
CAPABILITIES = "container string, key string, version long"

#: The mark that begins a binary value, and fragments that describe the container itself.
MARK = b"\xe0\x01\x00\xea"
OWN = ("$ion_symbol_table", "max_id", "max_eid_in_sections")
IMAGE = b"SQLite format 3\x00"


def opened(raw: bytes) -> tuple[sqlite3.Connection, Callable[[str], bytes | None]]:
    """The database of a container, and what finds its external resources: files of the archive around it."""
    find: Callable[[str], bytes | None] = lambda path: None
    if raw[:4] == b"PK\x03\x04":
        z = zipfile.ZipFile(io.BytesIO(raw))
        inside = sorted(n for n in z.namelist() if n.lower().endswith(".kdf"))
        if len(inside) != 1:
            raise ValueError(f"{len(inside)} databases in the archive")
        folder = inside[0].rpartition("/")[0]

        def find(path: str) -> bytes | None:
            names = [path, f"{folder}/{path}" if folder else path]
            return next((z.read(n) for n in names if n in z.NameToInfo), None)

        raw = z.read(inside[0])
    if not raw.startswith(IMAGE):
        raise ValueError("not a database")
    db = sqlite3.connect(":memory:")
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    db.deserialize(raw)
    return db, find


def fragment_rows(name: str, raw: bytes) -> list[dict]:
    """What each fragment is: media (bytes that aren't a value), value (with the element that its properties name), path (a resource elsewhere)."""
    db, find = opened(raw)
    elements = dict(db.execute("SELECT id, value FROM fragment_properties WHERE key = 'element_type'"))
    out = []
    for id_, kind, payload in db.execute("SELECT id, payload_type, payload_value FROM fragments ORDER BY id"):
        payload = payload.encode() if isinstance(payload, str) else bytes(payload or b"")
        if id_ in OWN or not payload:
            continue
        row = {"container": name, "id": id_, "element": elements.get(id_)}
        if kind == "path":
            location = payload.decode("utf-8", "replace").strip()
            out.append(row | {"kind": "path", "location": location, "data": find(location)})
        elif not payload.startswith(MARK):
            out.append(row | {"kind": "media", "data": payload})
        elif len(payload) > len(MARK):
            out.append(row | {"kind": "value", "data": payload})
    return out


def capability_rows(name: str, raw: bytes) -> list[dict]:
    db, _ = opened(raw)
    return [{"container": name, "key": k, "version": v} for k, v in db.execute("SELECT key, version FROM capabilities ORDER BY key")]


def _read(files: DataFrame, rows: Callable[[str, bytes], list[dict]], schema: str, errors: bool) -> DataFrame:
    from .books import _arrow

    kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in files.sparkSession.createDataFrame([], schema).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    found = rows(path, raw)
                except (ValueError, sqlite3.Error, zipfile.BadZipFile) as e:  # one bad container doesn't stop the others
                    found = [{"container": path, "error": str(e)}] if errors else []
                yield pa.RecordBatch.from_pylist(found, schema=kinds)

    return files.select("path", "content").mapInArrow(run, schema)


def fragments(files: DataFrame) -> DataFrame:
    """files: path, content. A container that can't be read gives one row with its error."""
    return _read(files, fragment_rows, FRAGMENTS, True)


def capabilities(files: DataFrame) -> DataFrame:
    return _read(files, capability_rows, CAPABILITIES, False)


def fragment_types(fragments: DataFrame) -> DataFrame:
    """The distinct elements of each container."""
    return fragments.where("element IS NOT NULL").select("container", "element").distinct()


def statistics(fragments: DataFrame, roots: list[str], singletons: list[str]) -> DataFrame:
    """For each container: fragments in all, media, roots, singletons among them, and others."""
    from pyspark.sql import functions as F

    root = F.col("element").isin(roots)
    single = F.col("element").isin(singletons)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return fragments.where("error IS NULL").groupBy("container").agg(F.count("*").alias("total"), n(F.col("kind") != "value").alias("raw"), n(root).alias("root"), n(root & single).alias("singleton"), n(~F.coalesce(root, F.lit(False)) & (F.col("kind") == "value")).alias("regular"))

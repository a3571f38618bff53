"""Registered queries on the driver's tables against plain Python, and pipeline stages on odd tables."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quire.llm.bpe import tokenizer_path
from quire.llm.hashing import BYTE_HASH
from quire.llm.licenses import TEMPLATES, shingled
from quire.llm.media import BITS, FRAME, LEAST, MOST
from quire.llm.queries import QUERIES
from tests.llm.test_formats import chat_brute

D = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_chat(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{D}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    got = QUERIES["op1_chat"](spark, D).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == chat_brute(rows) and len(got) == len({r[0] for r in rows})
    assert all(r.formatted_chars >= r.loss_chars for r in got)


def test_bpe_and_token_files(spark, docs, tok):
    ids = {i: tok.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op3_bpe"](spark, D).collect()}
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(tok.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    at, want = 0, {}
    for i in sorted(docs):
        x = [*ids[i], 2]
        want[i] = (at, len(x), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x)))
        at += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op6_token_files"](spark, D).collect()} == want


def test_licenses(spark, docs):
    import pyarrow as pa

    sets = {n: set(shingled(pa.array([t]))[0].tolist()) for n, t in TEMPLATES.items()}
    got = {(r.doc_id, r.license) for r in QUERIES["op5_licenses"](spark, D).collect()}
    for i, t in docs.items():
        flat = set(shingled(pa.array([t]))[0].tolist())
        for n, s in sets.items():
            if len(TEMPLATES[n].split()) >= 5:
                # short texts fit into one window, so the whole text decides
                if len(s & flat) < 0.8 * len(s):
                    assert (i, n) not in got
                elif len(t.split()) <= len(TEMPLATES[n].split()):
                    assert (i, n) in got
        if t.rstrip().endswith("Released under the MIT License."):
            assert (i, "MIT notice") in got


def test_archive(spark):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{D}/pages.parquet").collect()]
    first = {}
    for i, x in pages:
        if len(x) >= 100:
            first[x] = min(i, first.get(x, i))
    want = {i: (len(x), sha(x), "revisit" if first.get(x, i) != i else "response", first[x] if first.get(x, i) != i else None) for i, x in pages}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op9_warc"](spark, D).collect()} == want


def plain_chunks(x: bytes) -> list[bytes]:
    """Cuts by a gear hash that rolls byte by byte."""
    out, begin, h, table = [], 0, 0, BYTE_HASH.tolist()
    for i, b in enumerate(x):
        h = ((h << 1) + table[b]) % (1 << 64)
        n = i + 1 - begin
        if (n >= LEAST and h < 1 << (64 - BITS) and n < len(x) - begin) or n == MOST:
            out.append(x[begin : i + 1])
            begin = i + 1
    return [*out, x[begin:]] if begin < len(x) else out


def test_media(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op10_media"](spark, D).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        raw = t.encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), sha(full), zlib.crc32(full[-32:]))
        parts = plain_chunks(full)
        head = b"QCDC" + struct.pack("<IQ", len(parts), len(full)) + b"".join(struct.pack("<I", len(p)) + hashlib.sha256(p).digest() for p in parts)
        assert (r.media_bytes, r.media_sha256) == (len(head) + len(full), sha(head + full))
        assert r.feature.startswith(f"frames={len(full) // FRAME};mean={sum(full) * 1000 // len(full)};")
    by = defaultdict(set)
    for i, t in docs.items():
        by[t].add(tuple(got[i])[1:])
    assert all(len(x) == 1 for x in by.values())


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, place string, `all` string, words string, copies string, made string, `of` string, __in string, n_bytes string, n_removed string, key string, size string, `class` string"


def odd_rows():
    good = " ".join(f"word{i}" for i in range(90))
    long = " ".join(f"long{i % 9000}" for i in range(60_000))
    base = [(1, good, "s"), (1, good, "s"), (2, good + " more", "s"), (None, good + " else", None), (3, None, "t"), (4, "", None), (5, long, "t"), (6, "few words only", "s"), (None, None, None), (7, " ".join(f"other{i}" for i in range(120)), None), (7, " ".join(f"third{i}" for i in range(120)), "u")]
    return [(i, t, "en", s, None if t is None else len(t), *("c" for _ in range(13))) for i, t, s in base]


def test_stages_on_odd_rows(spark, tmp_path):
    df = spark.createDataFrame(odd_rows(), CLASHING)
    spark.read.parquet(f"{D}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = Counter(map(tuple, df.collect()))
    stages = dict(corpus_pipeline.STAGES)

    def through(name, df):
        out = stages[name](spark, df, str(tmp_path))
        got = out.collect()
        assert name == "bpe" or out.columns == df.columns
        assert stages[name](spark, df.limit(0), str(tmp_path)).collect() == []
        return out, got

    # quality keeps or drops rows as they are; what has under 50 words goes
    _, got = through("quality", df)
    assert not Counter(map(tuple, got)) - rows and all(len((r.text or "").split()) >= 50 for r in got)
    # of the four near-copies one stays, that with the smallest id; texts without words stay
    _, got = through("near_duplicates", df)
    kept = Counter(map(tuple, got))
    assert not kept - rows and sum(kept.values()) == len(odd_rows()) - 3
    assert [r.doc_id for r in got if (r.text or "").startswith("word0")] == [1]
    # repeats: the shared passage goes from all that have it
    _, got = through("repeats", df)
    assert len(got) == len(odd_rows()) and not [r for r in got if (r.text or "").startswith("word0")]
    assert all(r.n_chars == len(r.text or "") or (r.n_chars is None and not r.text) for r in got)
    assert {r.text[:6] for r in got if r.text} == {"few wo", "other0", "third0", "long0 "} or {r.text[:6] for r in got if r.text} >= {"few wo", "other0", "third0"}
    # mixing: copies of whole rows, three at most, and the same ones again, whatever the order of rows
    _, got = through("mixing", df)
    copies = Counter(map(tuple, got))
    assert set(copies) <= set(rows) and all(n <= 3 * rows[x] for x, n in copies.items())
    again = stages["mixing"](spark, df.repartition(5), str(tmp_path)).collect()
    assert Counter(map(tuple, again)) == copies
    # bpe: texts come back
    _, got = through("bpe", df)
    assert Counter((r.doc_id, r.source, r.text) for r in got) == Counter((x[0], x[3], x[1] or "") for x in odd_rows())


def test_entry_stands_without_what_the_operators_need():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not [n for n in q if n.startswith('op1_')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2], timeout=120)

"""Chat windows, WARC archives, media chunks, token files and licenses: round trips and brute force."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import hashing
from quire.llm.bpe import decode, encode, heap_encoder, library_encoder, round_trip, tokenizer_path
from quire.llm.chat import HISTORY, SPAN, chat_windows, format_turns, parse_turns, read_back, unescaped
from quire.llm.common import file_system, shared_folder
from quire.llm.hashing import Spans
from quire.llm.licenses import SHINGLE, TEMPLATES, Scanner, bands_needed, read_templates, scan_licenses, shingled, worded
from quire.llm.media import chunk_lists, cuts, features, gear, keep_one, store
from quire.llm.media import read_back as media_back
from quire.llm.mixing import mix
from quire.llm.token_files import TokenFile, read_documents, write_token_files
from quire.llm.warc import Archive, read_archive, url_key, write_archive

ODD = ["", " ", "\\", "###", "</turn>", "\\### Assistant: </turn> ok", ":", "a: b", "\n", "\\\\", "<|endoftext|>", "é中\U0001f600", "\x00", "  \n\n x  ", "\r\n", "# ##"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([*ODD, "user", "assistant"]), st.lists(st.sampled_from(ODD), max_size=5).map("".join), st.booleans()), max_size=6))
def test_template_is_reversible(turns):
    text, spans = format_turns(turns)
    assert parse_turns(text) == [(r, t) for r, t, _ in turns]
    assert [unescaped(text[a:b]) for a, b in spans] == [t for _, t, own in turns if own]


def chat_brute(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        h, loss = hashlib.sha256(), "".join(t for *_, r, t in turns if r == "assistant")
        for *_, r, t in turns:
            h.update(f"{r}\n{t}\n".encode())
        out[c] = (len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark):
    r = random.Random(6)
    rows = [(-7, i, "user" if i == 0 else "assistant", ODD[5]) for i in range(2)]
    for c in range(12):
        rows += [(c, i, ["system", "user", "assistant"][0 if i == 0 and c % 2 else 1 + i % 2], r.choice(ODD) * r.randrange(400)) for i in range(r.randrange(1, 40))]
    rows += [(20, i // 3, "assistant", "same" * 30) for i in range(900)] + [(None, None, None, None), (None, 1, "assistant", "x"), (21, 0, "system", "s" * 9000), (21, 1, "user", "u" * 20000), (21, 2, "assistant", "t")]
    df = spark.createDataFrame([(*x, "k") for x in rows], "conv_id long, turn long, role string, text string, key string")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    windows = chat_windows(df).cache()
    got = {x.conv_id: tuple(x)[1:5] for x in read_back(windows).collect()}
    assert got == chat_brute(rows)
    for w in windows.collect():
        turns = parse_turns(w.formatted)
        weigh = lambda ts: len(tok.encode(format_turns([(r, t, False) for r, t in ts])[0], add_special_tokens=False).ids)
        assert len(turns) == w.n_repeated + 1 or weigh(turns[w.n_repeated :]) <= SPAN
        history = turns[: w.n_repeated]
        assert weigh([h for h in history if h[0] != "system"]) <= HISTORY
    assert windows.groupBy("key").count().where("count > 3").count() > 0
    assert chat_windows(df.limit(0)).collect() == []


def test_long_system_turn_leads_each_window(spark):
    system = "s" * 9000
    rows = [(c, i, "user" if i % 2 else "assistant", f"{i} " * 200) for c in (1, 2) for i in range(1, 30)] + [(1, 0, "system", system), (2, 0, "system", "short")]
    windows = chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    for c, head in ((1, system), (2, "short")):
        parsed = [(w, parse_turns(w.formatted)) for w in windows.where(f"conv_id = {c}").orderBy("start").collect()]
        assert len(parsed) > 5 and all(turns[0] == ("system", head) and turns.count(turns[0]) == 1 for _, turns in parsed)
        assert [w.n_repeated > 0 for w, _ in parsed] == [False] + [True] * (len(parsed) - 1)
    assert {x.conv_id: tuple(x)[1:5] for x in read_back(windows).collect()} == chat_brute(rows)


def test_archive(spark):
    pages = [(1, "http://www.B.com/x?q=1", "x" * 100), (2, "https://a.org", "x" * 100), (3, "http://b.com:80/x?q=1#top", "x" * 99), (4, None, "x" * 99), (5, "no url\r\nat all", None), (None, "http://c.de/ü", "x" * 100)]
    pages += [(1, "http://www.B.com/x?q=1", "x" * 100)] + [(10 + i, f"http://h{i % 7}.net/p{i}", "é" * (40 + i % 40)) for i in range(300)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, digest int")
    folder = shared_folder(spark, "test")
    directory = write_archive(df, folder, block=16)
    fs, path = file_system(folder)
    assert sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(path))) == ["directory", "index", "records"]
    first = {}
    for i, _, h in pages:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in pages:
        h = h or ""
        other = first[h] if h in first and first[h] != i else None
        want.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if other is not None else "response", other))
    assert sorted(map(tuple, read_archive(df, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == sorted(want, key=repr)
    archive = Archive(folder, [tuple(x) for x in directory.collect()])
    assert sum(len(archive._list(f)[0]) for f in archive.files) > 10
    for i, url, h in pages:
        found = archive.lookup(url or "")
        same = sorted(str(p[0]) for p in pages if url_key(p[1]) == url_key(url))
        assert sorted(head["X-Page-Id"] or "None" for head, _ in found) == same
        assert all(body.decode() in ("", h or "") or head["X-Page-Id"] != str(i) for head, body in found)
    assert archive.lookup("http://nowhere.example/") == []
    one = archive._list(archive.files[0])[0][3]
    assert [x["page"] for x in archive.captures(one, one)] == [one[1]]
    write_archive(df.limit(0), f"{folder}/none")
    assert read_archive(df.limit(0), f"{folder}/none").collect() == []


def test_archive_reads_only_the_blocks_asked_for(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://h{i % 5}.net/p{i}", f"<p>{i}</p>" * 20) for i in range(400)], "page_id long, url string, html string").coalesce(1)
    folder = shared_folder(spark, "test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        archive = Archive(folder, [tuple(x) for x in write_archive(df, folder, block=10).collect()])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(archive.files) > 1
    read = []
    whole = archive.index.read
    monkeypatch.setattr(archive.index, "read", lambda *x: read.append(x) or whole(*x))
    assert [payload for _, payload in archive.lookup("http://h3.net/p123")] == [b"<p>123</p>" * 20]
    assert 1 <= len(read) <= 2
    assert [x.page_id for x in read_archive(df.where("page_id = 77"), folder).collect()] == [77]


def test_media(spark):
    r = random.Random(7)
    body = "".join(r.choice("abcdefgh ") for _ in range(60000))
    texts = ["", None, "x" * 576, "x" * 577, "é", body, body, body[:20000] + "!" + body[20000:], "z" * 50000]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(0, "", "c"), (None, "n", "c")], "doc_id long, text string, pack string").repartition(3)
    folder = shared_folder(spark, "test")
    chunks = store(df, folder)
    places = keep_one(chunks, folder)
    got = media_back(chunk_lists(chunks, places), folder).collect()
    for x in got:
        raw = ("n" if x.doc_id is None else texts[x.doc_id] or "").encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert len(got) == len(texts) + 2
    by = {x.doc_id: tuple(x)[1:] for x in got}
    assert by[5] == by[6] and by[0] == by[1]
    sizes = {x.digest: x.size for x in chunks.collect()}
    assert sum(sizes.values()) < 2 * 60000 + 60000  # the third body shares most chunks
    # the packs hold each chunk once, and nothing is left of the first ones
    fs, path = file_system(folder)
    stored = sum(f.size for f in fs.get_file_info(pafs.FileSelector(f"{path}/packs")))
    assert stored == places.selectExpr("sum(length)").first()[0] and places.count() == places.select("digest").distinct().count() == len(sizes)
    assert chunks.groupBy("digest").agg(F.count_distinct("pack").alias("n")).where("n > 1").count() > 0
    assert fs.get_file_info(f"{path}/met").type == pafs.FileType.NotFound
    for x in got:
        parts = [c.size for c in sorted(chunks.where("id = 7").collect(), key=lambda c: c.ord)] if x.doc_id == 7 else None
        raw = (texts[7]).encode() if parts else b""
        if parts:
            full = raw + b"\xff" * (-len(raw) % 576)
            ends = [sum(parts[: i + 1]) for i in range(len(parts))]
            head = b"QCDC" + struct.pack("<IQ", len(parts), len(full)) + b"".join(struct.pack("<I", n) + hashlib.sha256(full[e - n : e]).digest() for n, e in zip(parts, ends))
            assert (x.media_bytes, x.media_sha256) == (len(head) + len(full), hashlib.sha256(head + full).hexdigest())
            assert x.feature == features(np.frombuffer(full, np.uint8))
    none = store(df.limit(0), f"{folder}/none")
    assert media_back(chunk_lists(none, keep_one(none, f"{folder}/none")), f"{folder}/none").collect() == []


def test_features_of_samples():
    x = np.array([0, 255] * 288 + [128] * 576, np.uint8)
    assert features(x) == "frames=2;mean=127750;square=24448250;cross=575;shares=250000,0,0,0,500000,0,0,250000"


def test_gear_against_a_rolling_one():
    import numpy as np

    from quire.llm.hashing import BYTE_HASH

    data = np.frombuffer(random.Random(8).randbytes(5000), np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(BYTE_HASH[b])) % (1 << 64)
        want.append(h)
    assert gear(data).tolist()[63:] == want[63:]
    assert cuts(np.array([], int), 5, 5) == [] and cuts(np.array([1500, 2100]), 0, 3000) == [1501, 3000]


def test_bpe(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    r = random.Random(9)
    alphabet = [*ODD, "word", "It's", ", ", ". ", "  ", "\t", " ", "\x85", " ", "　", "1", "'ll", "!!", "x"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(400)] + [None, "q" * 5000]
    df = spark.createDataFrame([(i, t, "i", "r", 7, 8) for i, t in enumerate(texts)], "doc_id long, text string, ids string, row string, of int, __in int")
    want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    ids = encode(df, tokenizer_path())
    assert ids.columns == ["doc_id", "row", "of", "__in", "ids"] and [x.ids for x in sorted(ids.collect())] == want
    back = sorted(decode(ids, tokenizer_path()).collect())
    assert [x.text for x in back] == [tok.decode(i, skip_special_tokens=False) for i in want] and {(x.row, x.of, x["__in"]) for x in back} == {("r", 7, 8)}
    for only in (False, True):
        whole = sorted(round_trip(df, tokenizer_path(), digest_only=only).collect(), key=lambda x: x.row.doc_id)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert [x.decoded for x in whole] == [sha(x.text) if only else x.text for x in back]
        assert [(x.n_tokens, x.ids_sha256) for x in whole] == [(len(i), sha(",".join(map(str, i)))) for i in want]
    assert round_trip(df.select("text").limit(0), tokenizer_path()).collect() == []
    for e in (library_encoder(tokenizer_path()), heap_encoder(tokenizer_path())[1]):
        flat, counts = e.encode(pa.array(texts))
        assert flat.tolist() == [x for w in want for x in w] and counts.tolist() == [*map(len, want)]
    with pytest.raises(ValueError):
        heap_encoder(tokenizer_path())[0].decode(__import__("numpy").array([10**6]), __import__("numpy").array([1]))


def test_ids_of_texts_that_weak_hashes_confuse():
    """Thue-Morse words and their complements agree in polynomial hashes modulo powers of two."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    for n in (1024, 2048, 4096):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        texts = [word, word.translate(str.maketrans("ab", "ba")), word]
        want = [x for t in texts for x in tok.encode(t, add_special_tokens=False).ids]
        for e in (library_encoder(tokenizer_path()), heap_encoder(tokenizer_path())[1]):
            assert e.encode(pa.array(texts))[0].tolist() == want
    data = np.frombuffer(word.encode(), np.uint8)
    starts = np.arange(0, 4096 - 200)
    seen = {}
    for a, h in zip(starts.tolist(), Spans(data).hashes(starts, starts + 200).tolist()):
        assert seen.setdefault(h, word[a : a + 200]) == word[a : a + 200]


def test_spans_of_long_buffers(monkeypatch):
    r = np.random.default_rng(3)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    starts = r.integers(0, 5000, 300)
    ends = np.minimum(starts + r.integers(0, 3000, 300), 5000)
    want, rolled = Spans(data).hashes(starts, ends), Spans(data).rolling(32)
    plain = [sum((int(x) + 1) * pow(hashing._BASE, i, hashing._P) for i, x in enumerate(data[a:b])) % hashing._P for a, b in zip(starts[:20], ends[:20])]
    assert want[:20].tolist() == hashing.mixed(np.array(plain, np.uint64) + (ends - starts)[:20].astype(np.uint64) * hashing.ODD).tolist()
    monkeypatch.setattr(hashing, "MOST", 512)
    assert Spans(data).hashes(starts, ends).tolist() == want.tolist() and Spans(data).rolling(32).tolist() == rolled.tolist()


def test_very_long_texts():
    from tokenizers import Tokenizer

    tok, r = Tokenizer.from_file(tokenizer_path()), random.Random(12)
    text = " ".join(r.choice(["alpha", "beta", "gamma-ray", "é", "\n\n", "x1"]) for _ in range(700_000))
    assert len(text.encode()) > 2 * hashing.MOST // 2 and len(text) > 1 << 21
    want = tok.encode(text, add_special_tokens=False).ids
    flat, counts = heap_encoder(tokenizer_path())[1].encode(pa.array(["a", text, None, "b"]))
    assert flat[counts[0] : counts[0] + counts[1]].tolist() == want


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    r = random.Random(10)
    docs = [(r.randrange(1000), " ".join(r.choice(["alpha", "beta", "é", "\n", "x y"]) for _ in range(r.randrange(60)))) for _ in range(300)] + [(None, None), (5, ""), (7, "w " * 3000)]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, shard string")
    folder = shared_folder(spark, "test")
    manifest = write_token_files(df, folder, tokenizer_path(), length=16, rows=4)
    got = sorted(map(tuple, read_documents(manifest, folder).collect()), key=lambda x: x[1])
    at, want = 0, []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    assert got == want
    m = manifest.collect()
    shard = m[0].shard
    file = TokenFile(f"{folder}/shards/{shard:06d}.arrow")
    n = sum(x.n_tokens for x in m if x.shard == shard)
    ids, mask = file.sequence(n // 16)
    assert len(ids) == 16 and mask.true_count == (n % 16 or 16) and file.sequence(0)[1].true_count == 16
    with pytest.raises(IndexError):
        file.sequence(n // 16 + 1)
    with pytest.raises(IndexError):
        file.sequence(n)
    # in any order, and the same by ranges; ids and masks are views of the mapped file
    remote = TokenFile.__new__(TokenFile)
    monkeypatch.setattr("quire.llm.token_files.pa.memory_map", lambda path: pafs.LocalFileSystem().open_input_file(path))
    remote.__init__(f"{folder}/shards/{shard:06d}.arrow")
    for i in (n // 16 - 1, 0, 9, 3, 9):
        ids, mask = file.sequence(i)
        assert remote.sequence(i)[0].tolist() == ids.tolist() and remote.sequence(i)[1] == mask
        begin = file.held.column("ids").flatten().buffers()[1].address
        assert begin <= ids.ctypes.data < begin + file.held.column("ids").flatten().buffers()[1].size
        assert mask.buffers()[1].address == file.held.column("mask").flatten().buffers()[1].address
    assert read_documents(write_token_files(df.limit(0), f"{folder}/none", tokenizer_path()), f"{folder}/none").collect() == []


def test_token_files_of_wide_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.add_tokens([f"<|x{i}|>" for i in range(66_000 - tok.get_vocab_size())])
    tok.save(str(tmp_path / "large.json"))
    last = tok.id_to_token(65_999)
    df = spark.createDataFrame([(1, f"a {last} b"), (2, None)], "doc_id long, text string")
    for tokenizer, end in ((str(tmp_path / "large.json"), 2), (tokenizer_path(), 70_000)):
        ids = [[*Tokenizer.from_file(tokenizer).encode(t, add_special_tokens=False).ids, end] for t in (f"a {last} b", "")]
        assert max(ids[0]) >= 1 << 16
        folder = shared_folder(spark, "test")
        got = sorted(read_documents(write_token_files(df, folder, tokenizer, end_id=end), folder).collect())
        assert [x.ids_crc32 for x in got] == [zlib.crc32(b"".join(i.to_bytes(4, "little") for i in d)) for d in ids]


def test_licenses(spark):
    r = random.Random(11)
    noise = lambda n: " ".join(f"n{r.randrange(999)}" for _ in range(n))
    names = sorted(TEMPLATES)
    docs, want = [], {}
    for i in range(160):
        name = names[i % len(names)]
        words = TEMPLATES[name].split()
        if i % 3 == 1 and len(words) > 40:
            words[r.randrange(len(words))] = "other"
        if i % 3 == 2:
            words = [w.upper() + "," for w in words]
        docs.append((i, f"{noise(r.randrange(80))} {' '.join(words)} {noise(r.randrange(80))}"))
        want[i] = name
    docs += [(500, None), (501, ""), (502, noise(4)), (503, noise(500)), (None, TEMPLATES["MIT notice"])]
    df = spark.createDataFrame([(*d, "l") for d in docs], "doc_id long, text string, license string")
    got = scan_licenses(df).collect()
    sets = {n: set(shingled(pa.array([t]))[0].tolist()) for n, t in TEMPLATES.items()}
    exact = set()
    for i, t in docs:
        flat = shingled(pa.array([t], pa.string()))[0].tolist()
        for n, s in sets.items():
            m = shingled(pa.array([TEMPLATES[n]]))[1][1]
            if any(len(s & set(flat[a : a + int(m)])) >= 0.8 * len(s) for a in range(len(flat))):
                exact.add((i, n))
    assert exact <= {(x.doc_id, x.license) for x in got}
    assert {(i, n) for i, n in want.items()} <= {(x.doc_id, x.license) for x in got}
    # nothing else: each row's window, two blocks of the template's size class, holds that much of it
    texts = dict(docs)
    for x in got:
        if len(TEMPLATES[x.license].split()) < SHINGLE:
            assert TEMPLATES[x.license].lower().strip(".") in texts[x.doc_id].lower().replace(",", "")
            continue
        flat = shingled(pa.array([texts[x.doc_id]]))[0].tolist()
        window = set(flat[x.first_word : x.first_word + 4 * max(1, len(sets[x.license]))])
        assert len(sets[x.license] & window) >= 0.8 * len(sets[x.license])
    assert not {500, 501, 502, 503} & {x.doc_id for x in got}
    assert all(x.containment >= 0.8 for x in got)
    assert scan_licenses(df.limit(0)).collect() == [] and scan_licenses(df, templates={}).collect() == []
    assert (1 - 0.3) ** bands_needed(0.3) <= 1e-6 and SHINGLE == 5 and Scanner(TEMPLATES).bands


def test_short_templates(spark):
    docs = [(1, "A b c. All RIGHTS reserved."), (2, "all rights, reserved"), (3, "all rights are reserved"), (4, "x all rights"), (5, "reserved y"), (6, "Word. " * 40 + "CC0 1.0 Universal, all rights reserved; all rights reserved"), (None, "all rights reserved"), (7, "all"), (8, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = sorted((tuple(x) for x in scan_licenses(df).collect()), key=repr)
    want = [(1, "Reserved rights", 1.0, 3), (2, "Reserved rights", 1.0, 0), (6, "CC0-1.0 name", 1.0, 40), (6, "Reserved rights", 1.0, 44), (None, "Reserved rights", 1.0, 0)]
    assert got == sorted(want, key=repr)
    got = scan_licenses(df, templates={"one": "all", "four": "x, all rights", "none": ". ."}).collect()
    assert sorted((x.doc_id or 0, x.license) for x in got) == [(0, "one"), (1, "one"), (2, "one"), (3, "one"), (4, "four"), (4, "one"), (6, "one"), (7, "one")]


def test_low_containment_is_exact():
    words = [f"w{i}" for i in range(1000)]
    template = " ".join(words)
    texts = pa.array([" ".join([f"x{k}", *words[5 * k : 5 * k + 9], f"y{k}"]) for k in range(150)] + ["n " * 50])
    for contained in (0.005, 0.0):
        scanner = Scanner({"long": template}, contained)
        assert scanner.bands == {1024: 0} and bands_needed(5 / 2048) > 1024
        found = scanner.scan(*worded(texts))
        assert sorted(found) == [(k, "long") for k in range(150)] and {c for c, _ in found.values()} == {5 / 996}


def test_many_templates_through_the_band_index():
    r = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    templates = {f"t{k}": " ".join(r.choice(words) for _ in range(r.randrange(5, 200))) for k in range(300)}
    templates |= {"twin": templates["t0"], "pair": templates["t1"].replace("w1", "v1")}
    scanner = Scanner(templates)
    assert all(len(i) == scanner.bands[size] for size, i in scanner.index.items())
    texts = []
    for k in r.sample(range(300), 60):
        t = templates[f"t{k}"].split()
        if len(t) > 60:
            t[r.randrange(len(t))] = "other"
        texts.append(" ".join([*r.choices(words, k=50), *t, *r.choices(words, k=50)]))
    texts.append("a " + templates["t0"] + " b")
    found = set(scanner.scan(*worded(pa.array(texts))))
    sets = {n: set(shingled(pa.array([t]))[0].tolist()) for n, t in templates.items()}
    want = {(d, n) for d, t in enumerate(texts) for s in [set(shingled(pa.array([t]))[0].tolist())] for n, m in sets.items() if len(s & m) >= 0.8 * len(m)}
    assert found == want and {(60, "t0"), (60, "twin")} <= found


def test_templates_from_a_folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "One.txt").write_text("do as you like with this")
    (tmp_path / "Two").write_text("ask first")
    assert read_templates(str(tmp_path)) == {"Two": "ask first", "One": "do as you like with this"}


def test_license_line_of_the_driver_table(spark):
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0 notice", "All rights reserved.": "Reserved rights", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0 notice", "Released under the MIT License.": "MIT notice", "Licensed under the Apache License, Version 2.0.": "Apache-2.0 notice"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {(i, lines[last]) for i, t in docs.collect() if (last := (t or "").rstrip().split("\n")[-1]) in lines}
    assert len(want) > 40 and want <= {(x.doc_id, x.license) for x in scan_licenses(docs).collect()}


def test_mixing_cases(spark):
    rows = [(i, "a" if i % 3 else "b", i % 50) for i in range(3000)] + [(5, "c", 10)] * 4 + [(None, None, None), (7, None, 3)]
    df = spark.createDataFrame([(*x, "t") for x in rows], "doc_id long, source string, words int, target string")
    got = mix(df, "words").collect()
    assert len(got) == len(rows) and all(0 <= x.copies <= 3 for x in got)
    total, by = sum(x.size for x in got), defaultdict(lambda: [0, 0, 0.0])
    for x in got:
        by[x.row.source] = [by[x.row.source][0] + x.size, by[x.row.source][1] + x.copies * x.size, x.target]
    assert abs(sum(t for *_, t in by.values()) - total) < 1e-6
    assert by["c"][2] == 120 and by[None][2] == 9
    for size, taken, target in by.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 200
    assert sorted(map(str, mix(df.repartition(7), "words").collect())) == sorted(map(str, got))
    assert mix(df.limit(0), "words").collect() == []
    assert [x.copies for x in mix(df.where("words = 0"), "words").collect()] == [0] * df.where("words = 0").count()

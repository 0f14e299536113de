"""Token counts, packing, token files, WARC packages and MPEG media: exact round trips and brute force."""

import base64
import hashlib
import io
import random
import time
import zipfile
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import mpeg, simple8b, token_files, warc, zipread
from quillstone.llm.media import described, op9_mpeg_media, padded, stored
from quillstone.llm.packing import combinations, packed, solve
from quillstone.llm.token_counts import op2_token_counts, spliced_ids, token_counts
from quillstone.llm.token_files import read_token_files, write_token_files
from quillstone.llm.vocab import PLAIN_LIMIT, ByteBpe, WordBpe, default_path, loaded

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "Häuser und Straßen", "<|endoftext|> inside", "日本語のテキスト", "é" * 3000, "x" * 40_000, " " * 5000, "it's  don't\n\n\tYOU'RE", "a​b \x1c c", "🙂🙃" * 50, "<|startoftext|>hi", "İstanbul ŉ ǰ"]


def library_ids(name, text):
    from tokenizers import Tokenizer

    if name not in _TOKS:
        _TOKS[name] = Tokenizer.from_file(default_path(name))
        _TOKS[name].no_truncation(), _TOKS[name].no_padding()
    return _TOKS[name].encode(text or "", add_special_tokens=False).ids


_TOKS: dict = {}


class Bytes:
    """A source of ranges over bytes."""

    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at : at + n]


def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# Vocabularies and counts.


def test_both_encoders_give_the_library_ids():
    byte_enc, word_enc = loaded(ByteBpe, default_path("byte_bpe_50k.json")), loaded(WordBpe, default_path("word_bpe_49k.json"))
    rng = random.Random(2)
    texts = [t or "" for t in ODD] + [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}2 '{chr(c)}" for c in range(1, PLAIN_LIMIT)]
    texts += ["".join(chr(rng.choice([*range(32, 127), 9, 10, *range(160, 400)])) for _ in range(80)) for _ in range(300)]
    for t in texts:
        assert byte_enc.ids(t).tolist() == library_ids("byte_bpe_50k.json", t), repr(t)
        assert np.frombuffer(word_enc.bytes_of(t), "<u4").tolist() == library_ids("word_bpe_49k.json", t), repr(t)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab  \n\t'.,é日<|>1🙂"), max_size=400), st.integers(5, 40), st.integers(1, 12))
def test_spliced_ids_are_those_of_the_whole_text(text, chunk, overlap):
    enc = loaded(ByteBpe, default_path("byte_bpe_50k.json"))
    assert spliced_ids(enc, text, chunk, overlap).tolist() == enc.ids(text).tolist()


def test_special_strings_across_chunk_ends():
    enc = loaded(ByteBpe, default_path("byte_bpe_50k.json"))
    text = "some words " * 6 + "<|endoftext|>" * 3 + " and more words" * 6
    for chunk in range(8, 90, 5):
        assert spliced_ids(enc, text, chunk, 4).tolist() == enc.ids(text).tolist()


@pytest.mark.parametrize("chars", [1_000_000, 4_000_000])
def test_texts_without_blanks_take_linear_time(chars):
    """A run without any boundary is encoded once: some four times as long for four times the text, and about what the library takes."""
    rng = random.Random(chars)
    text = "".join(rng.choices("abcdefgh", k=chars))
    enc = loaded(ByteBpe, default_path("byte_bpe_50k.json"))
    begin = time.perf_counter()
    ids = spliced_ids(enc, text)
    took = time.perf_counter() - begin
    begin = time.perf_counter()
    want = enc.ids(text)
    assert (ids == want).all() and len(ids) == len(want)
    assert took < 5 * (time.perf_counter() - begin) + 2


def test_token_counts_of_odd_and_all_small_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, None, "x"), (None, "b", "x")]
    out = token_counts(spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string"), chunk_chars=500, overlap_chars=16).collect()
    want = sorted((d or -1, len((t or "").encode()), n := len(library_ids("byte_bpe_50k.json", t)), n > 1024) for d, t, _ in rows)
    assert sorted((-1 if not r.doc_id else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == want
    texts = {r.doc_id: r.text for r in small_docs(spark).collect()}
    for r in op2_token_counts(spark, SMALL).collect():
        assert r.n_tokens == len(library_ids("byte_bpe_50k.json", texts[r.doc_id]))


# Packing.


def check_pieces(rows, texts, window):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = np.array([*library_ids("byte_bpe_50k.json", texts[d]), 0], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    assert sorted(by_seq) == list(range(len(by_seq)))
    total = sum(r.length for r in rows)
    return len(by_seq) * window / total if total else 1.0


@pytest.mark.parametrize("window", [1024, 64])
def test_packing_keeps_every_id_once(spark, window):
    docs = small_docs(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packed(docs, window=window).collect()
    assert check_pieces(rows, texts, window) < 1 + 2 * window / sum(r.length for r in rows) + 0.01


def test_packing_of_odd_texts_and_of_none(spark):
    texts = dict(enumerate(ODD))
    rows = packed(spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id bigint, text string, start int"), window=32).collect()
    check_pieces(rows, texts, 32)
    assert packed(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_solution_never_overdraws_a_length():
    rng = np.random.default_rng(1)
    histogram = np.concatenate([[0], rng.integers(0, 30, 63)])
    combos = combinations(64, histogram)
    counts = solve(combos, histogram)
    spent = np.zeros(64, int)
    for c, n in zip(combos, counts, strict=True):
        for x in c:
            spent[x] += n * (x > 0)
    assert (combos.sum(axis=1) == 64).all() and (counts >= 0).all() and (spent <= histogram).all() and counts.sum() > 0


# Simple-8b.


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1), st.just(0)), max_size=400), st.sampled_from([1, 7, 64, 1024]))
def test_simple8b_round_trip(ids, block):
    x = np.array(ids, np.uint64)
    words, blocks = simple8b.encode(x, block)
    assert simple8b.decode(words, blocks, len(x), block).tolist() == ids


def test_runs_of_zeros_take_one_word_and_ranges_decode():
    assert len(simple8b.encode(np.zeros(120, np.uint64))[0]) == 1
    out = io.BytesIO()
    writer = simple8b.Writer(out, flush_ids=2048)
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 49_408, n).astype("<u4") for n in (0, 1, 5000, 3, 1024, 2048, 700)]
    for i, d in enumerate(docs):
        writer.add(i if i != 3 else None, d.tobytes())
    writer.close()
    reader, every = simple8b.Reader(Bytes(out.getvalue())), np.concatenate(docs)
    assert reader.ids == len(every) and reader.docs[3, 1] == 1
    for a, n in ((0, 0), (0, len(every)), (1, 1), (1023, 2), (4999, 3000), (len(every) - 1, 1)):
        assert reader.read(a, n).tolist() == every[a : a + n].tolist()
    with pytest.raises(ValueError):
        simple8b.Reader(Bytes(b"not a file, but long enough to have a tail of forty bytes"))


@pytest.mark.parametrize("docs,n_bytes,files", [(100_000, 16 << 20, 1), (4, 16 << 20, 6), (100_000, 9000, 7)])
def test_token_files_round_trip(spark, tmp_path, monkeypatch, docs, n_bytes, files):
    """In as many files as the texts or the documents take, with a column of the operator's own name beside."""
    monkeypatch.setattr(token_files, "FILE_DOCS", docs)
    monkeypatch.setattr(token_files, "FILE_BYTES", n_bytes)
    rows = [(i * 3 % 17, t) for i, t in enumerate(ODD)] + [(None, "null id"), (100, "same"), (100, "same")]
    data = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, part string")
    manifest = write_token_files(data, f"file://{tmp_path}/ids", default_path("word_bpe_49k.json"), 2)
    assert files - 2 <= manifest.count() <= files + 2
    found = read_token_files(manifest, run_ids=64).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for d, t in order:
        ids = np.array([*library_ids("word_bpe_49k.json", t), 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(found, key=lambda r: r.start) == sorted(want, key=lambda r: r[1])
    assert read_token_files(write_token_files(spark.createDataFrame([], "doc_id bigint, text string"), f"file://{tmp_path}/none", default_path("word_bpe_49k.json"), 2)).count() == 0


# WARC in ZIP.


def test_warc_packages_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>x"), (2, "http://b", "<p>x"), (3, None, None), (4, "", ""), (5, "http://ü", "日本"), (6, "u", "z" * 300_000), (7, "u", "\r\n\r\nWARC/1.1"), (None, "n", "<p>x")]
    found = {r.page_id: r for r in warc.read_packages(warc.write_packages(spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, best int"), f"file://{tmp_path}/w")).collect()}
    assert len(found) == len(rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        assert found[page].payload_bytes == len(raw) and found[page].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    kind = {p: (r.record_type, r.refers_to) for p, r in found.items()}
    assert kind == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), None: ("revisit", 2)}


def test_warc_packages_end_at_their_bound(spark, tmp_path):
    """A task of many pages, equal ones among them, writes several packages; one page beyond the bound has one of its own."""
    rows = [(i, "u", "same page" if i % 2 else f"page {i} " * 50) for i in range(200)] + [(900, "u", "long " * 2000)]
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    manifest = warc.write_packages(docs, f"file://{tmp_path}/w", package_bytes=4000)
    assert manifest.count() > 10 and manifest.agg({"n_records": "sum"}).first()[0] == 201
    found = {r.page_id: r for r in warc.read_packages(manifest).collect()}
    assert len(found) == 201 and found[900].payload_bytes == 10_000
    assert all(found[i].refers_to == (199 if i != 199 else None) for i in range(1, 200, 2))


def test_warc_payloads_below_the_bound_are_responses(spark, tmp_path):
    rows = [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")]
    found = {r.page_id: r.record_type for r in warc.read_packages(warc.write_packages(spark.createDataFrame(rows, "page_id bigint, url string, html string"), f"file://{tmp_path}/w", least_bytes=5)).collect()}
    assert found == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_zip_directory_reads_comments_and_zip64_and_refuses_what_it_cannot():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.txt", b"alpha")
        with z.open(zipfile.ZipInfo("büro.txt"), "w", force_zip64=True) as f:
            f.write(b"beta")
        z.writestr("c.txt", b"c" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 in it and more than twenty-two bytes after that"
    source = Bytes(raw.getvalue())
    members = zipread.directory(source)
    assert set(members) == {"a.txt", "büro.txt", "c.txt"}
    for name, want in (("a.txt", b"alpha"), ("büro.txt", b"beta")):
        at, n = zipread.place(source, members[name])
        assert source.read_at(n, at) == want
    with pytest.raises(ValueError):
        zipread.place(source, members["c.txt"])
    with pytest.raises(ValueError):
        zipread.directory(Bytes(b"PK nothing here" * 3))


def test_zip64_end_record():
    import struct

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a", b"alpha")
    whole = raw.getvalue()
    end = whole.rindex(b"PK\x05\x06")
    n, size, at = struct.unpack_from("<HII", whole, end + 10)
    record = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    big = whole[:end] + record + locator + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    source = Bytes(big)
    start, length = zipread.place(source, zipread.directory(source)["a"])
    assert source.read_at(length, start) == b"alpha"


# MPEG.


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=6000))
def test_mpeg_round_trip(raw):
    payload = padded(raw)
    stream = mpeg.wrap(payload)
    s = mpeg.scan(stream)
    assert mpeg.unwrap(stream, s) == payload and s.failed == 0 and s.skipped == 0
    assert s.vbr["frames"] == len(s.offsets) and s.duration == Fraction(1152 * len(s.offsets), 32000)
    assert all(mpeg.header(stream[a : a + 4]) is not None for a in s.offsets)


def test_mpeg_finds_its_way_back_and_checks_frames():
    payload = padded(bytes(range(256)) * 60)
    stream = bytearray(mpeg.wrap(payload))
    s = mpeg.scan(bytes(stream))
    damaged = bytes(stream[: s.offsets[2]]) + b"\xff\x00junk\xff\xfb" + bytes(stream[s.offsets[2] :]) + b"TAG" + bytes(125)
    found = mpeg.scan(damaged)
    assert found.skipped == 8 and len(found.offsets) == len(s.offsets)
    with pytest.raises(ValueError):
        mpeg.unwrap(damaged)
    stream[s.offsets[1] + 10] ^= 1  # in the side information
    assert mpeg.scan(bytes(stream)).failed == 1
    assert mpeg.scan(b"").samples == 0 and mpeg.scan(b"no audio at all").offsets == []


def test_a_flipped_payload_byte_is_found():
    stream = bytearray(mpeg.wrap(bytes(range(256)) * 4))
    s = mpeg.scan(bytes(stream))
    stream[s.offsets[0] + 4 + 2 + s.headers[0].side + 10] ^= 1
    assert mpeg.scan(bytes(stream)).failed == 0, "no frame's checksum covers it"
    with pytest.raises(ValueError, match="isn't the one"):
        mpeg.unwrap(bytes(stream))


@pytest.mark.parametrize("head,covered", [("fffe9404", 256), ("fffe94c4", 128), ("fffe9454", 160)])
def test_checksums_of_layer_one(head, covered):
    """Stereo, mono, and joint stereo whose subbands from the ninth on share an allocation of four bits."""
    raw = bytes.fromhex(head)
    h = mpeg.header(raw)
    assert h.layer == 1 and h.protected
    body = bytes(range(1, 40)).ljust(h.length - 6, b"\0")
    crc = mpeg.crc16(raw[2:] + body[: covered // 8])
    frame = raw + crc.to_bytes(2, "big") + body
    assert mpeg.checksum(frame, 0, h) == crc and mpeg.scan(frame * 3).failed == 0
    broken = bytearray(frame * 3)
    broken[8] ^= 4
    assert mpeg.scan(bytes(broken)).failed == 1


def test_checksums_of_layer_two():
    """192 kbit/s stereo at 44.1 kHz: 30 subbands, allocations of 4, 3 and 2 bits for each channel, and two bits more for each that isn't zero."""
    raw = bytes.fromhex("fffca004")
    h = mpeg.header(raw)
    assert h.layer == 2 and [mpeg._allocation(h).count(n) for n in (4, 3, 2)] == [11, 12, 7]
    bits = "".join(format(k % 3, "04b") for k in range(22)) + "000" * 24 + "00" * 14
    used = sum(k % 3 > 0 for k in range(22))
    covered = len(bits) + 2 * used
    body = int((bits + "10" * used).ljust(8 * 60, "1"), 2).to_bytes(60, "big").ljust(h.length - 6, b"\0")
    crc = 0xFFFF
    for bit in format(int.from_bytes(raw[2:] + body, "big"), f"0{8 * (2 + len(body))}b")[: 16 + covered]:
        top = (crc >> 15) ^ int(bit)
        crc = ((crc << 1) ^ (0x8005 if top else 0)) & 0xFFFF
    frame = raw + crc.to_bytes(2, "big") + body
    assert mpeg.checksum(frame, 0, h) == crc and mpeg.scan(frame * 3).failed == 0


def test_frame_lengths_of_known_headers():
    assert mpeg.header(bytes.fromhex("fffb9064")).length == 417  # 128 kbit/s at 44.1 kHz
    assert mpeg.header(bytes.fromhex("fffb9264")).length == 418  # padded
    assert mpeg.header(bytes.fromhex("fff38064"))[:6] == (2, 3, False, 64000, 22050, 208)
    assert mpeg.header(b"\xff\xfb\xf0\x64") is None and mpeg.header(b"\xff\xe9\x90\x64") is None


def test_media_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    out = {r.doc_id: r for r in described(stored(spark.createDataFrame(rows, "doc_id bigint, text string")), ["doc_id", "n_bytes"]).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (out[i].n_bytes, out[i].payload_bytes, out[i].payload_sha256, out[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    media = spark.createDataFrame([(1, None), (2, b"junk")], "doc_id bigint, media binary")
    assert [(r.frames, r.payload_sha256) for r in described(media, ["doc_id"]).collect()] == [(0, None), (0, None)]
    assert op9_mpeg_media(spark, SMALL).count() == 200

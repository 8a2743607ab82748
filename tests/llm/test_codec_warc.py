"""Round trips and damage of the two file formats, and the tokenizer cache."""

import io
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from stitchlake.llm import _text, _tokens, token_codec, warc


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), min_size=1, max_size=700), min_size=1, max_size=4))
def test_blocks_round_trip(parts):
    parts = sorted((np.array(p, dtype=np.uint32) for p in parts), key=len, reverse=True)
    coded, distinct = token_codec.encode_blocks(parts)
    assert distinct == [len(set(p.tolist())) for p in parts]
    for a, b in zip(parts, token_codec.decode_blocks(coded, [len(p) for p in parts], distinct), strict=True):
        assert (a == b).all()


def test_blocks_of_other_kinds_round_trip():
    rng = np.random.default_rng(1)
    parts = [np.arange(6000), rng.integers(0, 2, 6000), np.zeros(6000), rng.permutation(65536)[:6000], np.repeat(rng.integers(0, 9, 60), 100)]
    parts = [p.astype(np.uint32) for p in parts]
    coded, distinct = token_codec.encode_blocks(parts)
    assert all((a == b).all() for a, b in zip(parts, token_codec.decode_blocks(coded, [6000] * 5, distinct), strict=True))
    assert len(coded[2]) < 100 and len(coded[1]) < 6000 / 8 * 1.15


def test_whole_block_of_different_ids():
    ids = np.random.default_rng(2).permutation(65536).astype(np.uint32)
    coded, distinct = token_codec.encode_blocks([ids])
    assert distinct == [65536] and (token_codec.decode_blocks(coded, [65536], distinct)[0] == ids).all()


def test_blocks_do_not_depend_on_neighbours():
    rng = np.random.default_rng(0)
    parts = [rng.zipf(1.3, 3000).clip(0, 60000).astype(np.uint32) for _ in range(3)]
    assert token_codec.encode_blocks(parts)[0][1] == token_codec.encode_blocks(parts[1:2])[0][0]
    assert len(token_codec.encode_blocks([np.tile(parts[0][:50], 60)])[0][0]) < 600  # repeats are learned


def test_ways_of_a_block_share_its_model(monkeypatch):
    """Blocks of all kinds come back, and a block of a small file takes few steps (before: one an id)."""
    rng = np.random.default_rng(3)
    for sizes in ([1], [8191], [8192, 8191], [16001, 16000], [65536, 65535]):
        parts = [rng.zipf(1.2, n).clip(0, 60000).astype(np.uint32) for n in sizes]
        coded, distinct = token_codec.encode_blocks(parts)
        found = token_codec.decode_blocks(coded, sizes, distinct)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(parts, found, strict=True))
    steps, kind = [], token_codec._kind
    monkeypatch.setattr(token_codec, "_kind", lambda *a: steps.append(1) or kind(*a))
    token_codec.decode_blocks(coded, sizes, distinct)
    assert len(steps) <= 1024
    assert 8 * sum(map(len, coded)) / 131071 < 1.03 * 8 * len(token_codec._encode(1, parts[:1])[0][0]) / 65536


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_mixing_beats_the_entropy_of_order_0():
    """Bits an id, all block resets included, against the order-0 entropy of the same ids."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").combine_chunks()
    ids, _ = _tokens.Encoder(_tokens.default_tokenizer()).encode(texts, 1)
    coded, _ = token_codec.encode_blocks(token_codec._cut(ids))
    p = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    entropy, bits = -(p * np.log2(p)).sum(), 8 * sum(map(len, coded)) / len(ids)
    plain = 8 * len(zstandard.ZstdCompressor(level=3).compress(ids.astype("<u2").tobytes())) / len(ids)
    assert bits < entropy - 0.2 and bits < plain


def _file(ids, lengths):
    f = io.BytesIO()
    token_codec.write_file(f, iter([([None, *range(1, len(lengths))], np.array(lengths), ids)]))
    return f.getvalue()


def test_token_file_detects_damage():
    ids = np.arange(20000, dtype=np.uint32) % 997
    raw = _file(ids, [5, 0, 19995])
    docs, lengths, parts = token_codec.read_file(io.BytesIO(raw))
    assert docs == [None, 1, 2] and (np.concatenate(list(parts)) == ids).all() and lengths.tolist() == [5, 0, 19995]
    for at in (3, 40, len(raw) // 2, len(raw) - 5):
        bad = bytearray(raw)
        bad[at] ^= 0x55
        with pytest.raises(Exception):
            list(token_codec.read_file(io.BytesIO(bytes(bad)))[2])
    with pytest.raises(ValueError):
        list(token_codec.read_file(io.BytesIO(raw[:-1]))[2])
    with pytest.raises(ValueError):
        _file(np.array([70000], dtype=np.uint32), [1])


def _archive(records):
    f = io.BytesIO()
    warc.write_archive(f, records)
    return f.getvalue()


def test_archive_round_trip_with_dictionary():
    bodies = [f"<html><title>page {i}</title>{'<p>text and more text</p>' * (i % 40)}{i * 7919}</html>".encode() for i in range(600)]
    raw = _archive([warc.record(i, f"http://x/{i}", b, None, False) for i, b in enumerate(bodies)])
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little") and int.from_bytes(raw[4:8], "little") > 1000
    got = [warc.parse(r) for r in warc.read_archive(io.BytesIO(raw))]
    assert [g["payload"] for g in got] == bodies and [g["record_id"] for g in got] == [f"urn:page:{i}" for i in range(600)]


def test_archive_checks():
    one = warc.record(1, None, b"body", None, False)
    raw = _archive([one, warc.record(2, "u", b"x" * 2000, 1, True)])
    ok = [warc.parse(r) for r in warc.read_archive(io.BytesIO(raw))]
    assert ok[1]["record_type"] == "revisit" and ok[1]["refers_to"] == "urn:page:1" and ok[1]["payload_bytes"] is None
    for bad in (raw[:-3], raw[:6], b"\x00" * 20, raw[:20] + b"\x01" + raw[21:]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(bad)))
    for change in ((b"Content-Length: ", b"Content-Length: 1"), (b"WARC/1.1", b"WARC/9.9"), (b"body\r\n", b"bodi\r\n"), (b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.parse(one.replace(*change))


def _foreign(kind, block, content_type="application/http; msgtype=response", *more):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}-1>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Type: {content_type}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """All record types, ids of any form, hex digests, folded lines, no dictionary, skippable frames anywhere."""
    import hashlib

    body = b"hello" * 9
    records = [
        _foreign("warcinfo", b"software: x\r\n", "application/warc-fields"),
        _foreign("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "application/http; msgtype=request", "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>"),
        _foreign("response", b"HTTP/1.1 200 OK\r\n\r\n" + body, "application/http; msgtype=response", "WARC-Payload-Digest: sha1:" + hashlib.sha1(body).hexdigest().upper(), "X-Note: one", " two"),
        _foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n", "application/http; msgtype=response", "WARC-Payload-Digest: sha1:" + hashlib.sha1(b"hello").hexdigest()),
        _foreign("resource", b"plain text", "text/plain", "WARC-Block-Digest: md5:abc"),
        _foreign("metadata", b"", "application/warc-fields"),
        _foreign("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", "application/http; msgtype=response", "WARC-Payload-Digest: sha1:" + "A" * 32, "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified"),
    ]
    skip = (0x184D2A51).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    pack = zstandard.ZstdCompressor().compress
    raw = b"".join(pack(r) + skip for r in records)
    got = [warc.parse(r) for r in warc.read_archive(io.BytesIO(raw))]
    assert [g["record_type"] for g in got] == ["warcinfo", "request", "response", "response", "resource", "metadata", "revisit"]
    assert got[2]["record_id"] == "urn:uuid:response-1" and got[2]["payload"] == body and got[4]["payload_bytes"] == 10
    assert [warc.parse(r)["payload"] for r in warc.read_archive(io.BytesIO(skip + raw))][2] == body
    sample = [r * 3 + bytes(str(i), "ascii") * 40 for i in range(400) for r in records[:3]]
    trained = zstandard.train_dictionary(4096, sample)
    packed = pack(trained.as_bytes())
    with_dict = zstandard.ZstdCompressor(dict_data=trained).compress
    raw2 = (0x184D2A5D).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + b"".join(map(with_dict, records))
    assert len([warc.parse(r) for r in warc.read_archive(io.BytesIO(raw2))]) == len(records)
    (tmp_path / "a.warc.zst").write_bytes(raw)
    (tmp_path / "b.warc.zst").write_bytes(raw2)
    uris = spark.createDataFrame([(f"file://{tmp_path}/{x}.warc.zst",) for x in "ab"], "uri string")
    assert warc.read_records(uris, with_payload=True).filter("record_type = 'response'").count() == 4
    for bad in (raw[:-4], pack(records[0])[:-1], b"\x01" + raw[1:], skip[:9]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(bad)))


def test_long_payloads_and_lengths_of_revisits(spark):
    long = "é" * 3_000_000
    pages = spark.createDataFrame([(1, "a", long), (2, "b", long), (3, "c", long[:-1])], "page_id long, url string, html string")
    made = warc.write_archives(pages)
    got = sorted((r.page_id, r.record_type, r.payload_bytes, len(r.payload or b"")) for r in warc.read_archives(made, with_payload=True).collect())
    assert got == [(1, "revisit", 6_000_000, 0), (2, "response", 6_000_000, 6_000_000), (3, "response", 5_999_998, 5_999_998)]


def test_revisit_without_its_response_fails(spark, tmp_path):
    (tmp_path / "a").write_bytes(_archive([warc.record(2, "u", b"x" * 2000, 1, True)]))
    with pytest.raises(Exception, match="no response for urn:page:2"):
        warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a", 1)], "uri string, n_records long")).collect()


def test_archives_of_a_table(spark):
    big = "<p>same</p>" * 200
    rows = [(1, "a", big), (2, "b", big), (3, None, big), (4, "c", None), (5, "d", ""), (6, "e", "é" * 499 + "x"), (7, "f", "é" * 499 + "x"), (None, "g", "no id"), (3, None, big), (None, "h", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as body", "3 as refers_to")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(warc.write_archives(pages)).collect()), key=str)
    n = len(big)
    want = [(1, "revisit", 3, n), (2, "revisit", 3, n), (3, "response", None, n), (3, "response", None, n), (4, "response", None, 0), (5, "response", None, 0), (6, "response", None, 999), (7, "response", None, 999), (0, "response", None, 5), (0, "revisit", 3, n)]
    assert got == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "Hello, world... it's 'quoted'!", "a\tb c d\x1ce\x85f", "ÀÉ İstanbul Σας ﬁn é, ño.", "<|endoftext|> x<|startoftext|>y", "日本語。テスト… —dash–", "x_y@z.com $5.00%%% a's b'll", "A" * 3000 + " ."])
def test_cached_ids_are_the_tokenizers(text):
    e = _tokens.Encoder(_tokens.default_tokenizer())
    texts = pa.array([text, None, text + "\n" + text])
    ids, off = e.encode(texts, 7)
    for i, t in enumerate(texts.to_pylist()):
        assert ids[off[i] : off[i + 1]].tolist() == [*e.tok.encode(t or "", add_special_tokens=False).ids, 7]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """One file with cased letters, one with other splits: ids are those of the tokenizer itself."""
    import json

    import public_tokenizers

    cased = json.loads(Path(_tokens.default_tokenizer()).read_text())
    cased["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(cased))
    assert _tokens.cuts_at_blanks(_tokens.default_tokenizer())
    for path in (str(tmp_path / "cased.json"), public_tokenizers.path("byte_bpe_50k.json")):
        assert not _tokens.cuts_at_blanks(path)
        e = _tokens.Encoder(path)
        texts = pa.array(["Hello World  again,\nand\tAGAIN!", None, "", "x  y"])
        ids, off = e.encode(texts, 7)
        for i, t in enumerate(texts.to_pylist()):
            assert ids[off[i] : off[i + 1]].tolist() == [*e.tok.encode(t or "", add_special_tokens=False).ids, 7]


def test_blocks_keep_rows():
    b = pa.record_batch([pa.array(range(50)), pa.array(["é" * (i * 37 % 500) for i in range(49)] + [None])], names=["k", "text"])
    got = list(_text.blocks(iter([b.slice(0, 20), b.slice(20)]), "text", 2000))
    assert [x for g in got for x in g.column(0).to_pylist()] == list(range(50)) and len(got) > 5


def test_pieces_of_any_length(monkeypatch):
    """Long pieces are cut between digits, and a piece may have more ids than 24 bits count."""

    e = _tokens.Encoder(_tokens.default_tokenizer())
    texts = ["a b " + "12" * 300 + "x7" * 90 + "...", "9" * 1000, "z" * 700, "1é2\u03013" * 50, "5" * 100 + " 's5's"]
    want = [[*e.tok.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    monkeypatch.setattr(_tokens, "LONG", 16)
    ids, off = e.encode(pa.array(texts), 7)
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == want
    n = (1 << 24) + 5
    e._keep(["huge", "next"], np.arange(n + 2, dtype=np.uint32), np.array([n, 2]))
    start, length = e._places(["huge", "next"])
    assert length.tolist() == [n, 2] and e._gather(start, length)[-3:].tolist() == [n - 1, n, n + 1]


def test_words_of_latin_letters():
    """Every letter up to U+0250 in words with and without a tail, against the tokenizer itself (before: wrong for a capital I with a dot before a tail)."""
    words = [w for c in map(chr, range(0xA0, 0x250)) for w in (c, f"a{c}B", f"{c}{c}.", f"A{c}!?", f"{c}\u0301,")]
    e = _tokens.Encoder(_tokens.default_tokenizer())
    ids, off = e.encode(pa.array([*words, " ".join(words)]), 1)
    for i, w in enumerate([*words, " ".join(words)]):
        assert ids[off[i] : off[i + 1] - 1].tolist() == e.tok.encode(w, add_special_tokens=False).ids, w


def test_pieces_share_words():
    """A word is encoded once, whatever its case and its tail (before: every piece was encoded and remembered by itself)."""
    e = _tokens.Encoder(_tokens.default_tokenizer())
    texts = ["Straße straße, STRAßE. straße!", "Éclair éclair éclair... (éclair éclair). it's IT'S, x1. İ. İx?", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}z" for i in range(9000))]
    ids, off = e.encode(pa.array(texts[:2]), 1)
    assert {"straße", "éclair"} <= set(e.known) and not {"Straße", "STRAßE", "straße,", "straße!", "Éclair"} & set(e.known)
    ids, off = e.encode(pa.array(texts), 1)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [[*e.tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]

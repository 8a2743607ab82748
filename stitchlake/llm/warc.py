"""Zstandard WARC archives: one frame per record, dictionary in a leading skippable frame.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary its record
frames were compressed with; each WARC record is one frame of its own. The reader loads the
dictionary, decodes frame by frame, and checks every record: version line, header syntax, required
fields, Content-Length against the block, the block and payload digests, and nothing left over.

``read_records`` reads archives of any origin: all record types (a block without HTTP header is its
own payload), ids as strings, archives without a dictionary and further skippable frames between
records. Digests other than SHA-1 are passed on unchecked; so is a payload digest of a transfer-coded
body, where writers differ.

Payloads of pages are UTF-8 bodies (null: empty). Of rows with equal payloads of at least
``MIN_SHARED`` bytes the one with the largest id is a ``response`` record and the others are
``revisit`` records (identical-payload-digest) that refer to it and hold no payload; smaller
payloads are always responses. ``read_archives`` takes the length of a revisit from the response that
it refers to, and fails if there is none with the same digest.

``write_archives`` finds the first of equal payloads by aggregation over digests (map-side combine)
and one equi-join that is split when a digest is hot, and writes each partition as archives of up
to ``ARCHIVE_BYTES`` payload bytes in the shared folder, with a committed manifest. The dictionary
is trained on the first records of an archive, up to ``TRAIN_BYTES``; archives too small to train
carry an empty one.

Defined cases: a null body is empty; a very long body is one record, in memory while it is coded; a
null id is written as no record number and never referred to unless all equal payloads have none,
which then are all responses; rows that repeat id and body (ties) are all responses if their id is the
largest; a null url is an empty target; an empty table gives no archive and an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._files import new_file, open_file
from ._store import materialize, shared_dir
from ._text import blocks, column

MIN_SHARED = 1000
ARCHIVE_BYTES = 64 << 20
#: Bytes of an archive's first records that its dictionary is trained on, and the dictionary's size.
TRAIN_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
LEVEL = 3
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"
_DATE = "1970-01-01T00:00:00Z"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, body: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if revisit else http + body
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", "".join((url or "").split())),
        ("WARC-Payload-Digest", _sha1(body)),
        ("WARC-Block-Digest", _sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_URN}{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and fields (lower-case names) of a header block; folded lines are joined."""
    lines = head.decode("utf-8").split("\r\n")
    fields: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
            continue
        k, colon, v = line.partition(":")
        last = k.lower()
        if not colon or not k or k.strip() != k or (last in fields and last not in _REPEATABLE):
            raise ValueError(f"bad header line {line!r}")
        fields.setdefault(last, v.strip())
    return lines[0], fields


_REPEATABLE = {"warc-concurrent-to", "warc-protocol"}


def _sha1_hex(digest: str) -> str | None:
    """Lower-case hex of a SHA-1 digest field in base 32 or 16; None for other algorithms."""
    name, _, value = digest.partition(":")
    if name.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def parse(raw: bytes) -> dict:
    """Fields of one record of any type, all checked."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    version, fields = _fields(head)
    if not sep or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in fields:
            raise ValueError(f"{k} is missing")
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the block")
    if (want := _sha1_hex(fields.get("warc-block-digest", ""))) and want != hashlib.sha1(block).hexdigest():
        raise ValueError("block digest does not match")
    kind, body, coded = fields["warc-type"].lower(), block, False
    if kind in ("response", "request", "revisit") and block and fields.get("content-type", "").lower().startswith("application/http"):
        http, sep, body = block.partition(b"\r\n\r\n")
        if not sep:
            raise ValueError("no end of the HTTP header")
        coded = b"transfer-encoding:" in http.lower()
    said = fields.get("warc-payload-digest")
    digest = _sha1_hex(said) if said else hashlib.sha1(body).hexdigest()
    if kind == "revisit":
        if body or not said:
            raise ValueError("bad revisit record")
    elif digest and not coded and digest != hashlib.sha1(body).hexdigest():
        raise ValueError("payload digest does not match")
    return {
        "record_id": fields["warc-record-id"].strip("<>"),
        "url": fields.get("warc-target-uri"),
        "date": fields["warc-date"],
        "payload_bytes": None if kind == "revisit" else len(body),
        "payload_digest": digest or said,
        "record_type": kind,
        "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
        "payload": None if kind == "revisit" else body,
    }


def write_archive(f, records: list[bytes]) -> None:
    """One archive to a stream."""
    sample, size = [], 0
    for r in records:
        if size >= TRAIN_BYTES:
            break
        sample.append(r)
        size += len(r)
    trained = zstandard.ZstdCompressionDict(b"")
    if len(sample) >= 16 and size >= 8 * DICTIONARY_BYTES:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
        except zstandard.ZstdError:  # too little variety to train on
            pass
    data = trained.as_bytes()
    f.write(struct.pack("<II", SKIPPABLE, len(data)))
    f.write(data)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained if data else None, write_checksum=True, write_content_size=True)
    for r in records:
        f.write(packer.compress(r))


def read_archive(f) -> Iterator[bytes]:
    """Records of an archive, one decoded frame each; holds one frame at a time besides a read buffer."""
    left, opener = b"", zstandard.ZstdDecompressor()

    def need(n: int) -> bool:
        """Have n bytes in ``left``, unless the archive ends before."""
        nonlocal left
        while len(left) < n and (more := f.read(max(1 << 18, n - len(left)))):
            left += more
        return len(left) >= n

    first = True
    while need(1):
        if not need(4):
            raise ValueError("a frame ends early")
        magic = int.from_bytes(left[:4], "little")
        if magic & 0xFFFFFFF0 == SKIPPABLE & 0xFFFFFFF0:
            if not need(8) or not need(8 + (size := struct.unpack("<I", left[4:8])[0])):
                raise ValueError("a skippable frame ends early")
            data, left = left[8 : 8 + size], left[8 + size :]
            if first and magic == SKIPPABLE and data:
                if data[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
            first = False
            continue
        if magic != zstandard.MAGIC_NUMBER:
            raise ValueError("not a Zstandard frame")
        first = False
        frame, out = opener.decompressobj(), []
        while not frame.eof:
            if not need(1):
                raise ValueError("a frame ends early")
            out.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, records, size = TaskContext.get().partitionId(), [], [], 0

        def flush() -> None:
            nonlocal records, size
            if records:
                with new_file(folder, f"pages-{part:06d}-{len(made):04d}.warc.zst") as (f, uri):
                    write_archive(f, records)
                made.append((uri, len(records), size))
                records, size = [], 0

        for b in blocks(batches, "body"):
            cols = (column(b, c).to_pylist() for c in ("id", "url", "body", "refers_to", "revisit"))
            for page_id, url, body, refers_to, revisit in zip(*cols, strict=True):
                body = (body or "").encode()
                records.append(record(page_id, url, body, refers_to, revisit))
                size += len(body)
                if size >= ARCHIVE_BYTES:
                    flush()
        flush()
        if made:
            uris, n, sizes = zip(*made, strict=True)
            yield pa.record_batch([pa.array(uris), pa.array(n, pa.int64()), pa.array(sizes, pa.int64())], names=["uri", "n_records", "payload_bytes"])

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write all rows; returns the committed manifest (uri, n_records, payload_bytes)."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body")).withColumn(
        "digest", F.unhex(F.sha1(F.col("body").cast("binary")))
    )
    large = F.octet_length("body") >= MIN_SHARED
    shared = rows.filter(large).groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("c")).filter("c > 1 AND refers_to IS NOT NULL")
    joined = rows.join(shared.select("digest", "refers_to"), "digest", "left")
    joined = joined.withColumn("revisit", F.col("refers_to").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers_to")))
    folder = shared_dir(pages.sparkSession, "warc")
    made = joined.select("id", "url", "body", "refers_to", "revisit").mapInArrow(_write(folder), "uri string, n_records long, payload_bytes long")
    return materialize(made, "warc-manifest")


_RECORD = "uri string, record_id string, record_type string, url string, date string, payload_bytes long, payload_digest string, refers_to string"
_TYPES = {"payload_bytes": pa.int64(), "payload": pa.binary()}


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")] + ["payload"] * with_payload

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[c] for r in rows], _TYPES.get(c, pa.string())) for c in names], names=names)

        for b in batches:
            for uri, n in zip(column(b, "uri").to_pylist(), column(b, "n_records").to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with open_file(uri) as f:
                    for raw in read_archive(f):
                        rows.append(parse(raw) | {"uri": uri})
                        seen += 1
                        size += len(raw)
                        if not with_payload:
                            rows[-1].pop("payload")
                        if size > 16 << 20:
                            yield out(rows)
                            rows, size = [], 0
                if n is not None and seen != n:
                    raise ValueError(f"{uri} holds {seen} records, not {n}")
                if rows:
                    yield out(rows)

    return run


def read_records(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of any archives (column ``uri``, and ``n_records`` where it is known), checked
    record by record; ids are the records' own strings."""
    n = F.col("n_records").cast("long") if "n_records" in archives.columns else F.lit(None).cast("long")
    dealt = archives.select("uri", n.alias("n_records")).repartition(max(1, archives.count()))
    return dealt.mapInArrow(_read(with_payload), _RECORD + (", payload binary" if with_payload else ""))


def read_archives(manifest: DataFrame, id_col: str = "page_id", with_payload: bool = False) -> DataFrame:
    """One row per page of the manifest's archives: id_col, url, payload_bytes, payload_digest, record_type,
    refers_to (and payload)."""
    found = read_records(manifest, with_payload)
    if with_payload:
        found = materialize(found, "warc-records")
    first = found.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("of_response"))
    joined = found.join(first, ["refers_to", "payload_digest"], "left")
    revisit = F.col("record_type") == "revisit"
    length = F.when(~revisit, F.col("payload_bytes")).when(F.col("of_response").isNotNull(), F.col("of_response"))
    length = F.when(revisit & F.col("of_response").isNull(), F.raise_error(F.concat(F.lit("no response for "), F.col("record_id"))).cast("long")).otherwise(length)

    def number(c: str) -> Column:
        return F.when(F.col(c).startswith(_URN), F.substring(c, len(_URN) + 1, 20).try_cast("long"))

    return joined.select(
        number("record_id").alias(id_col), "url", length.alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"), *["payload"] * with_payload
    )

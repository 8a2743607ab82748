"""Decoders of array chunks: Blosc frames, LZW, and the horizontal predictor; on numpy where they can be."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the Blosc 1 frame: flags, compressor numbers, and when a block is split by bytes of its items.
_SHUFFLE, _COPIED, _BITS, _WHOLE = 0x1, 0x2, 0x4, 0x10
_INNER = {0: "blosclz", 1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
_MOST_SPLITS, _LEAST_SPLIT = 16, 128


def zstd(raw: bytes, size: int | None = None) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


def _inner(name: str):
    import pyarrow as pa

    if name in ("lz4", "snappy"):
        codec = pa.Codec("lz4_raw" if name == "lz4" else name)
        return lambda raw, size: codec.decompress(raw, size, asbytes=True)
    if name == "zlib":
        return lambda raw, size: zlib.decompress(raw)
    if name == "zstd":
        return zstd
    raise ValueError(f"blosc frames of {name} cannot be read")


def _unshuffled(v: np.ndarray, itemsize: int) -> np.ndarray:
    """Bytes back in order of items; what does not fill an item stays at the end."""
    n = len(v) // itemsize
    return np.concatenate([v[: n * itemsize].reshape(itemsize, n).T.ravel(), v[n * itemsize :]])


def _unshuffled_bits(v: np.ndarray, itemsize: int) -> np.ndarray:
    n = len(v) // itemsize
    if n % 8:
        return v
    bits = np.unpackbits(v[: n * itemsize], bitorder="little").reshape(8 * itemsize, n)
    return np.concatenate([np.packbits(bits.T, axis=1, bitorder="little").ravel(), v[n * itemsize :]])


def blosc(raw: bytes) -> bytes:
    """The content of a Blosc 1 frame (byte or bit shuffle; LZ4, Snappy, Zlib or Zstandard)."""
    if len(raw) < 16:
        raise ValueError("a blosc frame has a header of 16 bytes")
    _, _, flags, itemsize, size, block, whole = struct.unpack_from("<BBBBIII", raw)
    if len(raw) < whole:
        raise ValueError(f"blosc frame ends early: {len(raw)} of {whole} bytes")
    if flags & _COPIED:
        return raw[16 : 16 + size]
    if not size:
        return b""
    unpack, out = _inner(_INNER.get(flags >> 5, str(flags >> 5))), np.empty(size, dtype=np.uint8)
    starts = struct.unpack_from(f"<{-(-size // block)}I", raw, 16)
    for i, at in enumerate(starts):
        lo, n = i * block, min(block, size - i * block)
        split = not flags & _WHOLE and itemsize <= _MOST_SPLITS and block // itemsize >= _LEAST_SPLIT and n == block
        parts = itemsize if split else 1
        found = []
        for _ in range(parts):
            (k,) = struct.unpack_from("<i", raw, at)
            stream, at = raw[at + 4 : at + 4 + k], at + 4 + k
            found.append(stream if k == n // parts else unpack(stream, n // parts))
        v = np.frombuffer(b"".join(found), dtype=np.uint8)
        if len(v) != n:
            raise ValueError(f"blosc block of {len(v)} bytes where {n} are expected")
        if flags & _BITS:
            v = _unshuffled_bits(v, itemsize)
        elif flags & _SHUFFLE and itemsize > 1:
            v = _unshuffled(v, itemsize)
        out[lo : lo + n] = v
    return out.tobytes()


def to_blosc(raw: bytes, itemsize: int) -> bytes:
    """A Blosc 1 frame: one block, bytes shuffled, LZ4."""
    import pyarrow as pa

    v = np.frombuffer(raw, dtype=np.uint8)
    n = len(v) // itemsize
    mixed = np.concatenate([v[: n * itemsize].reshape(n, itemsize).T.ravel(), v[n * itemsize :]]).tobytes()
    packed = pa.Codec("lz4_raw").compress(mixed, asbytes=True)
    body = struct.pack("<Ii", 20, min(len(packed), len(mixed))) + min(packed, mixed, key=len)
    return struct.pack("<BBBBIII", 2, 1, 1 << 5 | _SHUFFLE | _WHOLE, itemsize, len(raw), len(raw), 16 + len(body)) + body


#: Fixed values of TIFF's LZW: codes that clear the table and end the data, and the widest code.
_CLEAR, _END, _WIDEST = 256, 257, 12


def lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first, widths that change one code early."""
    out, table, last = bytearray(), [], b""
    held = n = 0
    width = 9
    for byte in raw:
        held, n = held << 8 | byte, n + 8
        while n >= width:
            n -= width
            code, held = held >> n, held & (1 << n) - 1
            if code == _END:
                return bytes(out)
            if code == _CLEAR:
                table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
                continue
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise ValueError("not LZW data")
            out += entry
            if last:
                table.append(last + entry[:1])
            last = entry
            if len(table) + 1 >= 1 << width and width < _WIDEST:
                width += 1
    return bytes(out)


def undo_differences(v: np.ndarray) -> np.ndarray:
    """Rows of differences of neighbouring samples back to samples, modulo the kind's range."""
    return np.cumsum(v, axis=-1, dtype=v.dtype)

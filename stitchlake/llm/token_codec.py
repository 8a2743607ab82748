"""Token-id files with an adaptive context-mixing range coder.

A file holds the ids of consecutive documents: a magic word, blocks of up to ``BLOCK`` ids, and a
footer with the document index (ids and lengths) and its checksum, so a writer streams. Every block
is coded from a reset model, carries its length and the crc32 of its coded bytes and of its ids, and
can be decoded alone.

A block of ``WAYS_FROM`` ids or more is cut into up to ``WAYS`` equal stretches, its ways, which are coded
side by side, one id of each a step, and share the block's model: it learns a step's ids when the step is
done, so a block has few, wide steps whatever its file's size. Of ways that meet the same context in a step
the last one teaches it. A block's order of time is by step, then by way.

Within a block an id is named by its rank, the order of first appearance in time. Three predictions of the
next rank are mixed as probabilities: order 0, the adaptive counts of the block's ranks, renewed
when some 64, 128, .. 4096 (with ways 8, 16, .. steps) and then every further 4096 ids are known, with a share for ids that they do
not know; order 1, the last ``SLOTS`` ranks that followed the rank before; order 2, the rank that
last followed the hashed pair of ranks before. The probability of a rank is the weighted sum over
the three, and so is its cumulative probability. Weights are kept for each kind of context (how many
slots are filled, how they agree); they follow the share that each order had in the probabilities of
the ids coded so far (online expectation maximization, every ``RENEW`` steps). An id that nothing
knows is an escape and then its number, with a fixed 1 / (id + 256) prior. The probabilities drive a
range coder (64-bit low with carry, 32-bit words, total ``2**24``).

Up to ``ENCODE_LANES`` (``DECODE_LANES``) blocks are coded side by side in numpy; the bytes of a
block do not depend on its neighbours. Ids must be below 65536.

``write_tokens`` sorts documents by id over range partitions of about ``FILE_BYTES`` of text,
tokenizes and codes each partition as one file in the shared folder and commits a manifest;
``read_tokens`` decodes the manifest's files. A lost task writes another file; files no manifest
names are ignored.

Defined cases: null or empty text is the end id alone; null ids sort first; rows that repeat an id
(ties) stand next to each other, ordered by a hash of their text; a very long text is one document
over as many blocks as it needs; an empty table gives no files and an empty result; other columns
are not read.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import exactly, new_file, open_seekable
from ._store import materialize, shared_dir
from ._text import blocks, column, crc32_ids
from ._tokens import default_tokenizer, encoder

BLOCK = 1 << 16
#: Blocks that are coded at once: their tables should fit a processor's cache.
ENCODE_LANES, DECODE_LANES = 128, 128
#: Most ways of a block, least steps of a way, and ids from which a block has several.
WAYS, STEPS, WAYS_FROM = 64, 512, 8192
#: Text bytes of a file; fixes the number of range partitions.
FILE_BYTES = 48 << 20
END_ID = 1
MAGIC, TAIL = b"SLTOKEN3", b"SLINDEX3"
SLOTS = 3
NONE = 0xFFFF  # an empty slot
SCALE = 1 << 15  # total of order 0
SHARES = 512  # total of the three weights; SHARES * SCALE is the coder's total
TOTAL_BITS = 24
RENEW, RENEW_WAYS = 64, 8  # without and with ways
KNOWN = 1 << 14  # most ranks in order 0
_BITS2 = 13
_KEYS = 4 * 4 * 3
_PRIOR = (1 << TOTAL_BITS) // 9
_TAIL = "<qqqI8s"
_BLOCK_HEADER = "<IIIII"
_KEY = np.arange(_KEYS)
_N1, _AGREE, _KIND2 = _KEY // 12, _KEY // 3 % 4, _KEY % 3
_32, _24, _LEAST = np.uint64(32), np.uint64(TOTAL_BITS), np.uint64(1 << 32)
_LOW16, _16 = np.uint32(0xFFFF), np.uint32(16)


def _ways(n: int) -> int:
    """Ways of a block of ``n`` ids."""
    return min(WAYS, n // STEPS) if n >= WAYS_FROM else 1


def _renew(ways: int) -> int:
    return RENEW if ways == 1 else RENEW_WAYS


def _renewals(n: int, ways: int) -> list[int]:
    """Steps at which order 0 is renewed."""
    renew = _renew(ways)
    every = max(renew, 4096 // ways // renew * renew)
    return [p for p in [*(renew << i for i in range(12) if renew << i < every), *range(every, n, every)] if p < n]


def _in_time(ids: np.ndarray, ways: int) -> np.ndarray:
    """A block's ids by step and way."""
    if ways == 1:
        return ids
    out = np.empty_like(ids)
    for k, p in enumerate(np.array_split(ids, ways)):
        out[k::ways] = p
    return out


def _order0(counts: np.ndarray, distinct: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """From counts (lanes, ranks): (cumulative << 16 | share) of each rank and of an empty slot, and where the escape starts."""
    lanes, width = counts.shape
    r = np.minimum(distinct, KNOWN)[:, None]
    escape = np.clip(SCALE * (64 + r) // (4 * (known + 64)), 32, SCALE // 2)
    share = np.where(np.arange(width) < r, 1 + counts * np.maximum(SCALE - escape - r, 0) // max(known, 1), 0)
    upto = np.cumsum(share, axis=1)
    table = np.full((lanes, width + 1), (SCALE - 1) << 16, dtype=np.uint32)
    table[:, :width] = (upto - share) << 16 | share
    return table, upto[:, -1].astype(np.int32)


class _Weights:
    """The weights of the three orders by lane and kind of context."""

    def __init__(self, lanes: int):
        self.lanes, self.steps = lanes, 0
        first = np.array([192 + 0 * _KEY, 64 * (1 + _AGREE), 64 * (1 + 2 * (_KIND2 == 2))])
        self.gained = np.repeat(first[:, None, :], lanes, axis=1).astype(np.int64)
        self._renew()

    def _renew(self) -> None:
        g0, g1, g2 = self.gained[0], self.gained[1] * (_N1 > 0), self.gained[2] * (_KIND2 > 0)
        total = g0 + g1 + g2
        s1, s2 = (SHARES - 32) * g1 // total, (SHARES - 32) * g2 // total
        self.w0 = (SHARES - s1 - s2).astype(np.int32).ravel()
        self.w1 = (s1 * SCALE // np.maximum(_N1, 1)).astype(np.int32).ravel()
        self.w2 = (s2 * SCALE).astype(np.int32).ravel()

    def update(self, key: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> None:
        """``key``: lane and kind of each place; ``r1``, ``r2``: 64 x the shares of orders 1 and 2 in its probability."""
        key, size, shape = key.ravel(), self.lanes * _KEYS, (self.lanes, _KEYS)
        n = np.bincount(key, minlength=size).reshape(shape)
        a = np.bincount(key, r1.ravel(), size).astype(np.int64).reshape(shape)
        b = np.bincount(key, r2.ravel(), size).astype(np.int64).reshape(shape)
        self.gained += np.stack([64 * n - a - b, a, b])
        self.steps += 1
        if self.steps % 32 == 0:
            self.gained >>= 1
            self.gained += 1
        self._renew()


def _kind(c, none: int):
    """Kind of context of slots ``c`` (order 1, then order 2), how many slots of order 1 are filled, and
    the equalities of slots (01, 02, 12, then each with order 2) as small integers."""
    c0, c1, c2, d = c
    e = [(x == y).view(np.uint8) for x, y in ((c0, c1), (c0, c2), (c1, c2), (c0, d), (c1, d), (c2, d))]
    filled = (c0 != none).view(np.uint8) + (c1 != none).view(np.uint8) + (c2 != none).view(np.uint8)
    key = filled * np.uint8(4)
    key += e[0]
    key += e[1]
    key += e[2]
    key *= np.uint8(3)
    two = (d != none).view(np.uint8)
    key += two
    key += two & (e[3] | e[4] | e[5])
    return key, filled, e


class _Encoder:
    """Range coders of many lanes."""

    def __init__(self, lanes: int, words: int):
        self.low = np.zeros(lanes, dtype=np.uint64)
        self.rng = np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
        self.out = np.zeros((lanes, words), dtype=np.uint64)  # carries stand above 32 bits until the end
        self.used = np.zeros(lanes, dtype=np.int64)

    def room(self, words: int) -> None:
        if int(self.used.max()) + words > self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)

    def put(self, cum: np.ndarray, freq: np.ndarray, lanes: int) -> None:
        """Code one place of each of the first ``lanes`` lanes."""
        low, rng = self.low[:lanes], self.rng[:lanes]
        rng >>= _24
        cum *= rng
        low += cum
        carry = low < cum
        rng *= freq
        if carry.any():
            i = np.flatnonzero(carry)
            self.out[i, self.used[i] - 1] += np.uint64(1)
        i = np.flatnonzero(rng < _LEAST)
        if len(i):
            self.word(i)

    def put_some(self, cum: np.ndarray, freq: np.ndarray, i: np.ndarray) -> None:
        """Code one place of each of the lanes ``i``."""
        r = self.rng[i] >> _24
        add = r * cum
        self.low[i] = low = self.low[i] + add
        self.rng[i] = rng = r * freq
        if (low < add).any():
            j = i[low < add]
            self.out[j, self.used[j] - 1] += np.uint64(1)
        if len(j := i[rng < _LEAST]):
            self.word(j)

    def word(self, i: np.ndarray) -> None:
        low = self.low[i]
        self.out[i, self.used[i]] = low >> _32
        self.used[i] += 1
        self.low[i] = low << _32
        self.rng[i] <<= _32

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        self.room(1)
        up = _LEAST - np.uint64(1)  # the range holds a number whose lower word is zero, and zeros follow the end
        self.low += up
        j = np.flatnonzero(self.low < up)
        self.out[j, self.used[j] - 1] += np.uint64(1)
        self.word(every)
        w = self.out
        while (over := w >> _32).any():
            w &= np.uint64((1 << 32) - 1)
            w[:, :-1] += over[:, 1:]
        return [w[i, : self.used[i]].astype("<u4").tobytes() for i in every]


def _ranks(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks by first appearance, and how many there are."""
    first = np.full(1 << 16, len(ids), dtype=np.int64)
    first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
    known = np.flatnonzero(first < len(ids))
    rank = np.zeros(1 << 16, dtype=np.uint16)
    rank[known[np.argsort(first[known])]] = np.arange(len(known))
    return rank[ids], len(known)


def _followers(context: np.ndarray, x: np.ndarray, slots: int, ways: int) -> np.ndarray:
    """What last followed each place's context in steps before it: (slots, n), the latest first. Of ways with one
    context in a step the last counts."""
    order = np.argsort(context, kind="stable")
    by, follows = context[order], x[order]
    new = by[1:] != by[:-1]
    if ways > 1:
        step = order // ways
        new |= step[1:] != step[:-1]
    last = np.flatnonzero(np.append(new, True))  # of each context and step
    which = np.cumsum(np.concatenate([np.zeros(1, dtype=np.int64), new])) if ways > 1 else np.arange(len(x))
    if ways == 1:
        last = which
    by_last, follows_last = by[last], follows[last]
    out = np.full((slots, len(x)), NONE, dtype=np.uint16)
    for j in range(1, slots + 1):
        if j < len(last):
            got = np.full(len(last), NONE, dtype=np.uint16)
            got[j:] = np.where(by_last[j:] == by_last[:-j], follows_last[:-j], np.uint16(NONE))
            out[j - 1][order] = got[which]
    return out


def _hash2(p1, p2):
    """Of two uint16 ranks, in ``_BITS2`` bits."""
    h = p1 * np.uint16(40503)
    h += p2 * np.uint16(30011)
    h >>= np.uint16(16 - _BITS2)
    return h


def _prior(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = ids.astype(np.int64) + 256
    k = np.floor(np.log2(y)).astype(np.int64)
    width = _PRIOR >> k
    return (k - 8) * _PRIOR + (y - (1 << k)) * width, width


def _code_escapes(escapes: list[np.ndarray]) -> list[bytes]:
    """The escaped ids of each lane by the fixed prior."""
    n = np.array([len(e) for e in escapes])
    most = int(n.max())
    if not most:
        return [b""] * len(escapes)
    coder = _Encoder(len(escapes), most // 2 + 16)
    ids = np.zeros((len(escapes), most), dtype=np.uint16)
    for i, e in enumerate(escapes):
        ids[i, : len(e)] = e
    cum, width = (z.astype(np.uint64) for z in _prior(ids))
    for k in range(most):
        i = np.flatnonzero(n > k)
        coder.room(4)
        coder.put_some(cum[i, k], width[i, k], i)
    return coder.finish()


def _read_escapes(coded: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    lanes, most = len(coded), int(counts.max())
    words = np.zeros((lanes, max(map(len, coded)) + 2 + most), dtype=np.uint64)
    for i, c in enumerate(coded):
        words[i, : len(c)] = c
    at = np.full(lanes, 2)
    code = words[:, 0] << _32 | words[:, 1]
    rng = np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    out = np.zeros((lanes, most), dtype=np.uint16)
    for k in range(most):
        i = np.flatnonzero(counts > k)
        r = rng[i] >> _24
        v = np.minimum((code[i] // r).astype(np.int64), 9 * _PRIOR - 1)
        b = v // _PRIOR + 8
        step = _PRIOR >> b
        y = np.minimum((v - (b - 8) * _PRIOR) // step, (1 << b) - 1)
        out[i, k] = np.clip(y + (1 << b) - 256, 0, 0xFFFF)
        code[i] -= r * ((b - 8) * _PRIOR + y * step).astype(np.uint64)
        rng[i] = r * step.astype(np.uint64)
        j = i[rng[i] < _LEAST]
        code[j] = code[j] << _32 | words[j, at[j]]
        at[j] += 1
        rng[j] <<= _32
    return out


def _by_ways(f, sizes: list[int], *columns: list) -> list[list]:
    """The columns of ``f``'s result, one entry a block, where ``f`` takes blocks of equally many ways."""
    out: list = [None] * len(sizes)
    kinds = [_ways(n) for n in sizes]
    for w in sorted(set(kinds)):
        at = [i for i, k in enumerate(kinds) if k == w]
        for i, got in zip(at, f(w, *([c[i] for i in at] for c in columns)), strict=True):
            out[i] = got
    return out


def encode_blocks(parts: list[np.ndarray]) -> tuple[list[bytes], list[int]]:
    """(coded bytes, distinct ids) of each block; lengths are descending and differ by one at most."""
    coded, distinct = zip(*_by_ways(_encode, [len(p) for p in parts], parts), strict=True)
    return list(coded), list(distinct)


def _encode(ways: int, parts: list[np.ndarray]) -> list[tuple[bytes, int]]:
    many, n, renew = len(parts), -(-len(parts[0]) // ways), _renew(ways)
    lanes = many * ways
    x = np.zeros((n, many, ways), dtype=np.uint16)
    slots = np.full((SLOTS + 1, n, many, ways), NONE, dtype=np.uint16)
    distinct, timed = [], [_in_time(p, ways) for p in parts]
    start = np.zeros(ways, np.uint16)
    for i, ids in enumerate(timed):
        m, q = len(ids), len(ids) // ways
        rank, d = _ranks(ids)
        p1 = np.concatenate([start, rank[:-ways]])
        p2 = np.concatenate([start, p1[:-ways]])
        both = np.concatenate([rank[None], _followers(p1, rank, SLOTS, ways), _followers(_hash2(p1, p2), rank, 1, ways)])
        for to, z in zip((x, *slots), both, strict=True):
            to[:q, i] = z[: q * ways].reshape(q, ways)
            if m > q * ways:
                to[q, i, : m - q * ways] = z[q * ways :]
        distinct.append(d)
    x, slots = x.reshape(n, lanes), slots.reshape(SLOTS + 1, n, lanes)
    sizes = np.array([len(p) for p in parts])
    weights, coder = _Weights(many), _Encoder(lanes, n // 2 + 512)
    width = max(distinct)
    counts = np.zeros((many, width), dtype=np.int64)
    top = np.zeros(many, dtype=np.int64)
    block = np.repeat(np.arange(many), ways)
    way = np.tile(np.arange(ways), many)
    base, base_key = block * (width + 1), block * _KEYS
    table, escape = _order0(counts, top, 0)
    marks = set(_renewals(n, ways))
    begun, escaped = 0, []
    ends = np.flatnonzero((n - 1) * ways + way < sizes[block])  # lanes that have a place in the last step
    for t in range(0, n, renew):
        if t in marks:
            add = np.bincount((block * width + x[begun:t]).ravel(), minlength=many * width)
            counts += add.reshape(many, width)
            top, begun = (counts > 0).sum(axis=1), t
            table, escape = _order0(counts, top, t * ways)
        u = min(t + renew, n)
        now, c = x[t:u], slots[:, t:u]
        kind, filled, _ = _kind(c, NONE)
        key = kind + base_key
        w0, w1, w2 = weights.w0.take(key), weights.w1.take(key), weights.w2.take(key)
        got = table.take(now + base)
        f1 = ((c[0] == now).view(np.uint8) + (c[1] == now).view(np.uint8) + (c[2] == now).view(np.uint8)) * w1
        f2 = (c[3] == now) * w2
        less = (c[0] < now).view(np.uint8) + (c[1] < now).view(np.uint8) + (c[2] < now).view(np.uint8)
        cum = w0 * (got >> np.uint32(16)).view(np.int32)
        cum += less * w1
        cum += (c[3] < now) * w2
        freq = w0 * (got & np.uint32(0xFFFF)).view(np.int32)
        freq += f1
        freq += f2
        out = (freq == 0) | (now == NONE)
        at = np.flatnonzero(out.ravel())
        if len(at):
            step, lane = at // lanes, at % lanes
            i = block[lane]
            w = w0.ravel()[at]
            cum.ravel()[at] = w * escape[i] + filled.ravel()[at] * w1.ravel()[at] + w2.ravel()[at]
            freq.ravel()[at] = w * (SCALE - escape[i])
            f1.ravel()[at] = f2.ravel()[at] = 0
            escaped.append((i, (t + step) * ways + way[lane]))
        cums, freqs = cum.astype(np.uint64), freq.astype(np.uint64)
        coder.room(4 * renew)
        for s in range(u - t):
            if t + s < n - 1:
                coder.put(cums[s], freqs[s], lanes)
            else:
                coder.put_some(cums[s, ends], freqs[s, ends], ends)
        weights.update(key, (f1 << 6) // freq, (f2 << 6) // freq)
    i, at = (np.concatenate(z) for z in zip(*escaped, strict=True))
    order = np.argsort(i, kind="stable")
    i, at = i[order], at[order]
    edges = np.searchsorted(i, np.arange(many + 1))
    own = [timed[k][z[z < sizes[k]]] for k in range(many) for z in [at[edges[k] : edges[k + 1]]]]
    few = _escape_ways(ways)
    first, then = _code_escapes([p for e in own for p in np.array_split(e, few)]), coder.finish()
    coded = []
    for k, e in enumerate(own):
        pieces = [*first[k * few : (k + 1) * few], *then[k * ways : (k + 1) * ways]]
        coded.append(struct.pack("<I", len(e)) + np.array([len(p) // 4 for p in pieces], dtype="<u2").tobytes() + b"".join(pieces))
    return list(zip(coded, distinct, strict=True))


def _escape_ways(ways: int) -> int:
    """Parts of a block's escaped ids, coded side by side."""
    return max(1, ways // 4)


def _pieces(coded: bytes, ways: int) -> tuple[int, list[np.ndarray]]:
    """How many ids of a block are escaped, and the words of each of its pieces."""
    k = _escape_ways(ways) + ways
    if len(coded) < 4 + 2 * k:
        raise ValueError("a block is damaged")
    ends = np.cumsum(np.frombuffer(coded, dtype="<u2", count=k, offset=4), dtype=np.int64)
    words = np.frombuffer(coded, dtype=np.uint8, offset=4 + 2 * k)
    if len(words) != 4 * ends[-1]:
        raise ValueError("a block is damaged")
    return struct.unpack("<I", coded[:4])[0], np.split(words.view("<u4"), ends[:-1])


def decode_blocks(coded: list[bytes], sizes: list[int], distinct: list[int]) -> list[np.ndarray]:
    """Ids of each block (sizes descending)."""
    return _by_ways(_decode, sizes, coded, sizes, distinct)


def _decode(ways: int, coded: list[bytes], sizes: list[int], distinct: list[int]) -> list[np.ndarray]:
    many, n, width, renew, few = len(coded), -(-sizes[0] // ways), max(distinct), _renew(ways), _escape_ways(ways)
    lanes = many * ways
    none = width if width < NONE else NONE  # an empty slot, above every rank
    head = [_pieces(c, ways) for c in coded]
    n_escapes = np.array([h[0] for h in head])
    if (n_escapes > np.array(sizes)).any():
        raise ValueError("a block is damaged")
    shares = np.array([[k // few + (j < k % few) for j in range(few)] for k in n_escapes.tolist()])
    read = _read_escapes([p for h in head for p in h[1][:few]], shares.ravel())
    escapes = np.zeros((many, int(n_escapes.max())), dtype=np.uint16)
    for i, k in enumerate(n_escapes):
        escapes[i, :k] = np.concatenate([read[i * few + j, :m] for j, m in enumerate(shares[i])])
    id_of = np.zeros((many, width + 1), dtype=np.uint16)
    rank_at = np.zeros(escapes.shape, dtype=np.uint16)  # an id is first met as an escape, so this gives all ranks
    for i, k in enumerate(n_escapes):
        rank_at[i, :k], d = _ranks(escapes[i, :k])
        if d != distinct[i]:
            raise ValueError("a block is damaged")
        id_of[i, rank_at[i, :k]] = escapes[i, :k]
    rank_at, next_escape = rank_at.ravel(), np.arange(many) * escapes.shape[1]
    last_escape = next_escape + np.maximum(n_escapes, 1) - 1
    streams = [p for h in head for p in h[1][few:]]
    words = np.zeros((lanes, max(map(len, streams)) + 4 * RENEW), dtype=np.uint32)
    for i, p in enumerate(streams):
        words[i, : len(p)] = p
    flat, at = words.ravel(), np.arange(lanes, dtype=np.int64) * words.shape[1]
    rng = np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    code = flat[at].astype(np.uint64) << _32 | flat[at + 1]  # relative to the coder's low end
    at += 2
    last_word = np.arange(1, lanes + 1) * words.shape[1] - 1
    block = np.repeat(np.arange(many, dtype=np.int64), ways)
    table1 = np.full(many * (width + 1), none * 0x0001000100010001, dtype=np.uint64)
    table2 = np.full(many << _BITS2, none, dtype=np.uint16)
    base1, base2, base0, base_key = block * (width + 1), block << _BITS2, block * SCALE, block * _KEYS
    x_all = np.zeros((n, lanes), dtype=np.uint16)
    p1, p2 = np.zeros(lanes, dtype=np.uint16), np.zeros(lanes, dtype=np.uint16)
    weights = _Weights(many)
    counts = np.zeros((many, width), dtype=np.int64)
    marks, begun = {0, *_renewals(n, ways)}, 0
    most = np.uint64((1 << TOTAL_BITS) - 1)
    c = np.empty((4, lanes), dtype=np.uint16)
    times1, times2, below1, below2 = (np.zeros((4, lanes), dtype=np.uint8) for _ in range(4))
    times2[3] = 1
    keys = np.empty((renew, lanes), dtype=np.int64)
    parts1, parts2 = np.empty((renew, lanes), dtype=np.int32), np.empty((renew, lanes), dtype=np.int32)
    for t in range(n):
        if t in marks:
            if t:
                add = np.bincount((block * width + x_all[begun:t]).ravel(), minlength=many * width)
                counts += add.reshape(many, width)
            seen, begun = (counts > 0).sum(axis=1), t
            table, escape = _order0(counts, seen, t * ways)
            # the slots of the unit interval: each rank as often as its share says, then the escape's part
            filler = np.concatenate([table[:, :width] & _LOW16, (SCALE - escape)[:, None]], axis=1).ravel()
            inverse = np.repeat(np.tile(np.arange(width + 1).astype(np.uint16), many), filler)
            table, escape = table.ravel(), escape[block]
            left = SCALE - escape
        row = t % renew
        i1 = p1 + base1
        last = table1.take(i1)
        i2 = _hash2(p1, p2) + base2
        pack = last.view("<u2")
        c[0], c[1], c[2], c[3] = pack[0::4], pack[1::4], pack[2::4], table2.take(i2)
        c0, c1, c2, d = c
        kind, filled, (e01, e02, e12, e0, e1, e2) = _kind(c, none)
        key = np.add(kind, base_key, out=keys[row])
        w0, w1, w2 = weights.w0.take(key), weights.w1.take(key), weights.w2.take(key)
        for j, (x, y) in enumerate(((e01, e02), (e01, e12), (e02, e12))):
            np.add(x, y, out=times1[j])
        times1[:3] += np.uint8(1)
        np.add(e0, e1, out=times1[3])
        times1[3] += e2
        times2[0], times2[1], times2[2] = e0, e1, e2
        np.add(c1 < c0, c2 < c0, out=below1[0], dtype=np.uint8)
        np.add(c0 < c1, c2 < c1, out=below1[1], dtype=np.uint8)
        np.add(c0 < c2, c1 < c2, out=below1[2], dtype=np.uint8)
        np.add(c0 < d, c1 < d, out=below1[3], dtype=np.uint8)
        below1[3] += c2 < d
        np.less(d, c[:3], out=below2[:3].view(bool))
        got = table.take(c + base1)
        cums = (got >> _16).view(np.int32)
        cums *= w0
        cums += below1 * w1
        cums += below2 * w2
        ends = (got & _LOW16).view(np.int32)
        ends *= w0
        ends += times1 * w1
        ends += times2 * w2
        freqs = ends
        rng >>= _24
        v = np.minimum(code // rng, most).astype(np.int32)
        reached = cums <= v
        missed = v - cums
        hit = (missed < freqs) & reached
        below = (reached[0].view(np.uint8) + reached[1].view(np.uint8) + reached[2].view(np.uint8)) * w1
        below += reached[3] * w2
        x = inverse.take(np.minimum(np.maximum(v - below, 0) // w0, SCALE - 1) + base0)
        got = table.take(x + base1)
        cum = (got >> _16).view(np.int32)
        cum *= w0
        cum += below
        freq = (got & _LOW16).view(np.int32)
        freq *= w0
        for j in range(4):
            np.copyto(x, c[j], where=hit[j])
            np.copyto(cum, cums[j], where=hit[j])
            np.copyto(freq, freqs[j], where=hit[j])
        start = w0 * escape
        start += filled * w1
        start += w2
        out = np.flatnonzero(v >= start)
        if len(out):
            cum[out] = start[out]
            freq[out] = w0[out] * left[out]
        code -= rng * cum.astype(np.uint64)
        rng *= freq.astype(np.uint64)
        small = np.flatnonzero(rng < _LEAST)
        if len(small):
            code[small] = code[small] << _32 | flat[at[small]]
            at[small] = np.minimum(at[small] + 1, last_word[small])  # a lane that has ended goes on idly
            rng[small] <<= _32
        if len(out):
            own = block[out]
            new = np.bincount(own, minlength=many)
            k = next_escape[own] + np.arange(len(out)) - (np.cumsum(new) - new)[own]
            x[out] = rank_at[np.minimum(k, last_escape[own])]
            next_escape = np.minimum(next_escape + new, last_escape)
        x_all[t] = x
        one = (c0 == x).view(np.uint8) + (c1 == x).view(np.uint8) + (c2 == x).view(np.uint8)
        np.floor_divide((one * w1) << 6, freq, out=parts1[row])
        np.floor_divide(((d == x) * w2) << 6, freq, out=parts2[row])
        if len(out):
            parts1[row, out] = parts2[row, out] = 0
        last <<= np.uint64(16)
        last |= x
        table1[i1] = last
        table2[i2] = x
        p2, p1 = p1, x
        if row == renew - 1:
            weights.update(keys, parts1, parts2)
    x_all = x_all.reshape(n, many, ways)
    timed = (id_of[i].take(x_all[:, i].ravel()[:k]).astype(np.uint32) for i, k in enumerate(sizes))
    return [z if ways == 1 else np.concatenate([z[k::ways] for k in range(ways)]) for z in timed]


def _cut(flat: np.ndarray) -> list[np.ndarray]:
    """Equal blocks (lengths differ by one at most, longer ones first)."""
    return np.array_split(flat, max(1, -(-len(flat) // BLOCK)))


def write_file(f, docs: Iterator[tuple[list, np.ndarray, np.ndarray]]) -> tuple[int, int, int]:
    """One file from (document ids, their lengths, their ids on end) in order; returns (documents, ids, bytes)."""
    f.write(MAGIC)
    total, held, n = len(MAGIC), [], 0
    names: list = []
    lengths: list[np.ndarray] = []

    def flush(flat: np.ndarray) -> int:
        if int(flat.max()) > 0xFFFF:
            raise ValueError("ids from 65536 on can't be coded")
        cut, wrote = _cut(flat), 0
        for ids, coded, d in zip(cut, *encode_blocks(cut), strict=True):
            f.write(struct.pack(_BLOCK_HEADER, len(ids), len(coded), d, zlib.crc32(coded), crc32_ids(ids)))
            f.write(coded)
            wrote += struct.calcsize(_BLOCK_HEADER) + len(coded)
        return wrote

    for doc_ids, sizes, ids in docs:
        names += doc_ids
        lengths.append(sizes)
        held.append(ids)
        n += len(ids)
        if n >= BLOCK * ENCODE_LANES:
            flat = np.concatenate(held)
            for at in range(0, n - BLOCK * ENCODE_LANES + 1, BLOCK * ENCODE_LANES):
                total += flush(flat[at : at + BLOCK * ENCODE_LANES])
            held = [flat[n - n % (BLOCK * ENCODE_LANES) :]]
            n = len(held[0])
    if n:
        total += flush(np.concatenate(held))
    size = np.concatenate(lengths) if lengths else np.empty(0, dtype=np.int64)
    known = np.array([i is not None for i in names], dtype=np.uint8)
    index = zlib.compress(known.tobytes() + np.array([i or 0 for i in names], dtype="<i8").tobytes() + size.astype("<i8").tobytes(), 1)
    f.write(index)
    f.write(struct.pack(_TAIL, len(names), int(size.sum()), len(index), zlib.crc32(index), TAIL))
    return len(names), int(size.sum()), total + len(index) + struct.calcsize(_TAIL)


def read_file(f) -> tuple[list, np.ndarray, Iterator[np.ndarray]]:
    """(document ids, their lengths, ids block by block), everything checked."""
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    end = f.seek(0, io.SEEK_END)
    tail = struct.calcsize(_TAIL)
    f.seek(max(0, end - tail))
    n_docs, n_ids, size, crc, magic = struct.unpack(_TAIL, exactly(f, tail))
    if magic != TAIL or not 0 <= size <= end - tail - len(MAGIC):
        raise ValueError("the footer is damaged")
    f.seek(end - tail - size)
    index = exactly(f, size)
    if zlib.crc32(index) != crc:
        raise ValueError("document index is damaged")
    raw = zlib.decompress(index)
    known = np.frombuffer(raw[:n_docs], dtype=np.uint8)
    ids = np.frombuffer(raw[n_docs : 9 * n_docs], dtype="<i8").tolist()
    lengths = np.frombuffer(raw[9 * n_docs :], dtype="<i8")
    if int(lengths.sum()) != n_ids:
        raise ValueError("document lengths don't add up")
    f.seek(len(MAGIC))

    def parts() -> Iterator[np.ndarray]:
        left = n_ids
        while left:
            coded, sizes, distinct, crcs = [], [], [], []
            while left and len(coded) < DECODE_LANES:
                n, k, d, crc_coded, crc_ids = struct.unpack(_BLOCK_HEADER, exactly(f, struct.calcsize(_BLOCK_HEADER)))
                if not (0 < d <= n <= min(left, BLOCK) and k <= 8 * BLOCK):
                    raise ValueError("a block is damaged")
                data = exactly(f, k)
                if zlib.crc32(data) != crc_coded:
                    raise ValueError("a block is damaged")
                for held, v in ((coded, data), (sizes, n), (distinct, d), (crcs, crc_ids)):
                    held.append(v)
                left -= n
            by_size = np.argsort([-n for n in sizes], kind="stable").tolist()
            got = dict(zip(by_size, decode_blocks(*([held[i] for i in by_size] for held in (coded, sizes, distinct))), strict=True))
            for i, crc_ids in enumerate(crcs):
                if crc32_ids(got[i]) != crc_ids:
                    raise ValueError("a block decodes to other ids")
                yield got[i]

    return [i if k else None for i, k in zip(ids, known, strict=True)], lengths, parts()


def _write(path: str, end: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def docs(first):
            for b in [first], rest:
                for x in b:
                    ids, off = encoder(path).encode(column(x, "text"), end)
                    yield column(x, "id").to_pylist(), np.diff(off), ids.astype(np.uint16) if len(ids) and ids.max() <= 0xFFFF else ids

        rest = (b for b in blocks(batches, "text", keep=True) if b.num_rows)
        first = next(rest, None)
        if first is not None:
            part = TaskContext.get().partitionId()
            with new_file(folder, f"part-{part:06d}") as (f, uri):
                n_docs, n_ids, size = write_file(f, docs(first))
            yield pa.record_batch(
                [pa.array([part]), pa.array([uri]), pa.array([n_docs]), pa.array([n_ids]), pa.array([size])],
                names=["part", "uri", "n_docs", "n_tokens", "bytes"],
            )

    return run


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents in ascending id order; returns the committed manifest
    (part, uri, n_docs, n_tokens, bytes, start), one row a file, start = ids in earlier files."""
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    folder = shared_dir(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    files = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // FILE_BYTES)
    dealt = rows.repartitionByRange(files, "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    made = dealt.mapInArrow(_write(path, end_id, folder), "part long, uri string, n_docs long, n_tokens long, bytes long")
    manifest = materialize(made, "token-manifest")
    # one row a file of FILE_BYTES: the driver adds up some thousand numbers where there are terabytes
    counts = sorted((r["part"], r["n_tokens"]) for r in manifest.select("part", "n_tokens").toLocalIterator())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    starts = spark.createDataFrame([(p, s) for (p, _), s in zip(counts, before, strict=False)], "part long, start long")
    return manifest.join(F.broadcast(starts), "part")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri, start in zip(column(b, "uri").to_pylist(), column(b, "start").to_pylist(), strict=True):
            with open_seekable(uri) as f:
                doc_ids, lengths, parts = read_file(f)
                crcs, held, have, at = [], [], 0, 0
                for p in parts:
                    held.append(p)
                    have += len(p)
                    if at < len(lengths) and have >= lengths[at]:
                        flat, used = np.concatenate(held), 0
                        while at < len(lengths) and used + lengths[at] <= len(flat):
                            crcs.append(crc32_ids(flat[used : used + lengths[at]]))
                            used += int(lengths[at])
                            at += 1
                        held, have = [flat[used:]], len(flat) - used
                if at != len(lengths) or have:
                    raise ValueError(f"{uri} does not hold its documents")
                first = start + np.cumsum(lengths) - lengths
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(first), pa.array(lengths), pa.array(crcs, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, start, n_tokens, ids_crc32 of every document, decoded from the manifest's files."""
    files = max(1, manifest.count())
    dealt = manifest.select("uri", "start").repartition(files)
    return dealt.mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)

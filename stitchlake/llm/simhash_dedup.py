"""SimHash near-duplicates: exact pairs of fingerprints within a Hamming distance, by vantage-point trees.

A document's words are ``[^ \\t-\\r]+``, A-Z lower-cased; its shingles are all runs of ``WORDS`` words joined
by blanks, repeats included (fewer words: the whole sequence). A fingerprint bit is set if it is set
in over half of the shingles' XXH64 (seed 42). Fingerprints that differ in at most ``RADIUS`` bits link.

* Documents with one fingerprint are one node, so groups of copies are one entry from here on.
* **The upper tree** is built on the driver from a sample of at most ``SAMPLE`` fingerprints: a vantage
  point, and the median of the sample's distances to it, split the space in inside and outside; its
  leaves are shards of about ``SHARD`` fingerprints. The sample decides how even the shards are and
  nothing else: every fingerprint is dealt to its home shard.
* By the **triangle inequality** two fingerprints within the radius differ by no more than it in their
  distances to any point. So a fingerprint is sent also to the shards across those boundaries that it
  lies near: of a pair that a boundary parts, the inside one visits the outside, never the reverse.
* **Each shard** goes on splitting in the same way by points of its own, with the visitors that the bounds
  allow, down to ``LEAF`` fingerprints, which are compared by exclusive or and bit count. A pair is
  compared where one of the two is at home. Links that join nothing new in the shard are not sent.
* Connected components of the links give every document's class.

Defined cases: null text, empty text and text without a word have fingerprint zero, linked like any other;
a very long text is read in pieces; repeated rows and equal texts have equal fingerprints and one class; a
row without an id keeps its row and counts for no smallest id; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import components, discard, materialize
from ._text import blocks, column

WORDS = 3
SEED = 42
#: Differing bits up to which fingerprints link.
RADIUS = 2
#: Fingerprints from which the upper tree is built, at most; those of a shard, about; those of a leaf.
SAMPLE, SHARD, LEAF = 1 << 16, 1 << 13, 256
#: Bytes of one text that are cut into words together.
PIECE_BYTES = 1 << 20
#: Pairs that are compared together.
PAIRS = 1 << 21
_BLANK = b" \t\n\r\x0b\x0c"


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end between words."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < len(text) and text[end] not in _BLANK:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    from xxhash import xxh64_intdigest

    ones, n, held = np.zeros(64, dtype=np.int64), 0, []
    for piece in _pieces((text or "").encode()):
        w = held + piece.lower().split()
        k = len(w) - words + 1
        if k > 0:
            shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
            h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=k)
            ones += _bit_sums(h)
            n += k
        held = w[max(k, 0) :]
    if not n:
        return xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the numbers have each of the 64 bits, lowest bit first."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            found = np.fromiter((fingerprint(t.as_py(), words) for t in column(b, "text")), dtype=np.uint64, count=b.num_rows)
            yield pa.record_batch([column(b, "id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(words), "id long, fp long")


def _split(x: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point among x and the median distance to it; None if the points cannot be split."""
    for v in (x[0], x[len(x) // 2], x[-1]):
        d = np.bitwise_count(x ^ v)
        mu = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        if (d > mu).any():
            return v, mu
        if (d < mu).any():
            return v, mu - 1
    return None


def build_tree(sample: np.ndarray, shards: int) -> list[tuple]:
    """Nodes (vantage point, radius, inside node, outside node), or (None, shard, 0, 0) for a leaf; the first is
    the root. Halves the sample until there are about ``shards`` leaves."""
    nodes: list[tuple] = []

    def grow(x: np.ndarray, left: int) -> int:
        at = len(nodes)
        nodes.append((None, at, 0, 0))
        if left > 1 and len(x) > 1 and (cut := _split(x)):
            v, mu = cut
            d = np.bitwise_count(x ^ v)
            inside = grow(x[d <= mu], left // 2)
            nodes[at] = (v, mu, inside, grow(x[d > mu], left - left // 2))
        return at

    grow(np.random.default_rng(0).permutation(sample), shards)
    return nodes


def _visits(home: np.ndarray, guest: np.ndarray, x: np.ndarray, v, mu: int, radius: int):
    """(home, guest) of the inside and of the outside; both index x."""
    dh, dg = np.bitwise_count(x[home] ^ v).astype(np.int64), np.bitwise_count(x[guest] ^ v).astype(np.int64)
    inside = home[dh <= mu], guest[dg <= mu + radius]
    crossing = home[(dh <= mu) & (dh > mu - radius)]
    return inside, (home[dh > mu], np.concatenate([guest[dg > mu - radius], crossing]))


def _deal(tree, radius: int):
    """Each fingerprint for its home shard and the shards that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = tree.value
        for b in batches:
            x = column(b, "fp").to_numpy(zero_copy_only=False).view(np.uint64)
            todo = [(0, np.arange(len(x)), np.empty(0, dtype=np.int64))]
            while todo:
                at, home, guest = todo.pop()
                if not len(home) and not len(guest):
                    continue
                v, mu, inside, outside = nodes[at]
                if v is None:
                    both = np.concatenate([home, guest])
                    native = np.arange(len(both)) < len(home)
                    yield pa.record_batch([pa.array(np.full(len(both), mu, dtype=np.int32)), pa.array(x[both].view(np.int64)), pa.array(native)], names=["shard", "fp", "home"])
                    continue
                near, far = _visits(home, guest, x, v, mu, radius)
                todo += [(inside, *near), (outside, *far)]

    return run


class _Forest:
    """Union-find: whether a link joins two sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def shard_links(x: np.ndarray, home: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> list[tuple[int, int]]:
    """Links (indices of x) that join what is within the radius and has an end at home; no link that follows from others."""
    forest, links = _Forest(len(x)), []
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        natives, guests = todo.pop()
        cut = _split(x[natives]) if len(natives) > leaf else None
        if cut:
            todo += _visits(natives, guests, x, *cut, radius)
            continue
        if not len(natives):
            continue
        others = np.concatenate([natives, guests])
        step = max(1, PAIRS // len(natives))
        for i in range(0, len(others), step):
            part = others[i : i + step]
            a, b = np.nonzero(np.bitwise_count(x[part][:, None] ^ x[natives][None, :]) <= radius)
            for p, q in zip(part[a].tolist(), natives[b].tolist(), strict=True):
                if p != q and forest.join(p, q):
                    links.append((p, q))
    return links


def _links(radius: int, leaf: int):
    def run(shard: pa.Table) -> pa.Table:
        x = shard["fp"].to_numpy().view(np.uint64)
        found = np.array(shard_links(x, shard["home"].to_numpy(), radius, leaf), dtype=np.int64).reshape(-1, 2)
        fp = x.view(np.int64)
        return pa.table({"a": fp[found[:, 0]], "b": fp[found[:, 1]]})

    return run


def hamming_links(distinct: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """(a, b): links between the fingerprints ``fp`` of a table without repeats, which have the components of all pairs
    within the radius."""
    spark = distinct.sparkSession
    n = distinct.count()
    shards = min(-(-n // shard), max(1, sample // 16))
    got = []
    if shards > 1:
        # by a hash of the value, so that the sample does not depend on partitions
        some = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // (sample // 2)))) == 0).orderBy(F.xxhash64("fp"), "fp").limit(sample)
        got = [r["fp"] for r in some.collect()]
    tree = spark.sparkContext.broadcast(build_tree(np.array(got, dtype=np.int64).view(np.uint64), shards))
    dealt = distinct.select("fp").mapInArrow(_deal(tree, radius), "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(_links(radius, leaf), "a long, b long")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """One row per row of ``docs``: id_col, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    members = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = materialize(members.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    links = materialize(hamming_links(distinct, radius, sample, shard, leaf), "links")
    label = components(links)
    of = distinct.join(label, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    of = materialize(of, "labels")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    known = of.join(least, "component").select("fp", "component_id")
    discard(links, distinct)
    return members.join(known, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

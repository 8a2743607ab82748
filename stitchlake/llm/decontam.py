"""Benchmark decontamination: size-partitioned MinHash containment search.

An item leaks into a document when the document holds at least ``threshold_pct`` percent of the
item's distinct 5-word shingles (words ``[^ \\t-\\r]+``, A-Z lower-cased). An item with one to four
words has its whole word sequence as its one shingle, looked for at every place of a document.

Items are partitioned by set size, doubling from one partition to the next. A partition has its own
parameters: the least number ``r`` of sketch hashes that a candidate must share (more for larger
items, so fewer false candidates) and the length of its bottom-k MinHash sketches,
``n - ceil(t n / 100) + r``. Documents are sketched to each partition's scale: a MinHash of fixed size
of a long document would hide a short item, so a document's sketch holds all its shingle hashes up
to the largest hash that the partition's items have in their sketches (scaled MinHash). A document
that holds t percent of an item misses at most ``n - ceil(t n / 100)`` of its shingles, so it shares
``r`` hashes of the sketch: recall is 1 at any length of document, and each candidate is verified by
the exact count of common shingles.

* Up to ``BLOCK_HASHES`` shingle hashes of items (a fixed bound) are broadcast with their sketches;
  search and verification happen where a document is read, and documents are not shuffled.
* Beyond it, sketches meet by an equi-join: a bitmap of fixed size drops hashes of documents that no
  item sketched, the rest is joined with the items' sketches by hash, and candidates go back to
  the texts by a hash of id and text. Nothing of the items passes through the driver but the bitmap.

Defined cases: null or empty texts, and texts without words, contain nothing and are contained in
nothing; a very long text is searched whole; items or documents that repeat (ties) give a row each;
null ids are kept in the result; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, unused
from ._text import blocks, column, shingle_hashes, split_words, word_hashes

WORDS = 5
THRESHOLD_PCT = 80
#: Most shingle hashes of items that are broadcast at once (32 MB).
BLOCK_HASHES = 1 << 22


#: Bits of the bitmap of sketch hashes: of the one that is broadcast by itself (32 MB) and within a block.
BITMAP_BITS, BLOCK_BITS = 28, 22


def partition_of(n: int) -> int:
    """Largest set size of the partition to which an item of n shingles belongs."""
    return (1 << int(n).bit_length()) - 1


def least_shared(n: int) -> int:
    """Sketch hashes that a candidate must share with an item of n shingles."""
    return 1 + partition_of(n) // 64


def sketch_length(n: int, pct: int = THRESHOLD_PCT) -> int:
    return n - -(-pct * n // 100) + least_shared(n)


def _item_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            vocab, codes, off = split_words(column(b, "text"), lower=True)
            n_words = np.diff(off)
            hashes, start = shingle_hashes(word_hashes(vocab)[codes], off, words)
            sets = [np.unique(hashes[start[i] : start[i + 1]]) for i in range(b.num_rows)]
            yield pa.record_batch(
                [
                    column(b, "id"),
                    pa.array(np.minimum(n_words, words), pa.int32()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()),
                ],
                names=["id", "k", "n", "hashes"],
            )

    return run


class _Index:
    """Sketches of one block of items, by shingle length and size partition."""

    def __init__(self, rows: list[tuple], pct: int):
        self.ids = [r[0] for r in rows]
        self.sets = [np.frombuffer(r[3], dtype="<u8") for r in rows]  # sorted: the smallest hashes come first
        self.least = np.array([least_shared(r[2]) for r in rows])
        self.by_k: dict[int, tuple[np.ndarray, list[tuple]]] = {}
        for k in sorted({r[1] for r in rows}):
            seen, parts = np.zeros(1 << BLOCK_BITS, dtype=bool), []
            for upper in sorted({partition_of(r[2]) for r in rows if r[1] == k}):
                mine = [i for i, r in enumerate(rows) if r[1] == k and partition_of(r[2]) == upper]
                got = [self.sets[i][: sketch_length(len(self.sets[i]), pct)] for i in mine]
                key, owner = np.concatenate(got), np.repeat(mine, [len(x) for x in got])
                order = np.argsort(key, kind="stable")
                parts.append((key[order], owner[order], key.max()))
                seen[(key & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)] = True
            self.by_k[k] = seen, parts


def _common(mine: np.ndarray, item: np.ndarray) -> int:
    """Hashes in both of two sorted sets."""
    return int(np.count_nonzero(mine[np.minimum(np.searchsorted(mine, item), len(mine) - 1)] == item))


def _search(block, words: int, pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(block.value, pct)
        for b in blocks(batches, "text"):
            vocab, codes, off = split_words(column(b, "text"), lower=True)
            hashed = word_hashes(vocab)[codes]
            ids = column(b, "id")
            out: list[tuple] = []
            for k, (seen, parts) in index.by_k.items():
                got, start = _windows(hashed, off, k, words)
                maybe = np.flatnonzero(seen[(got & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)])
                sets: dict[int, np.ndarray] = {}
                for key, owner, largest in parts:
                    sketch = maybe[got[maybe] <= largest]
                    lo = np.searchsorted(key, got[sketch])
                    here = key[np.minimum(lo, len(key) - 1)] == got[sketch]
                    sketch, lo = sketch[here], lo[here]
                    docs, first = np.unique(np.searchsorted(start, sketch, side="right") - 1, return_index=True)
                    ends = np.append(first, len(sketch))[1:]
                    for d, begin, end in zip(docs.tolist(), first.tolist(), ends.tolist(), strict=True):
                        hits = np.unique(got[sketch[begin:end]])
                        lo, hi = np.searchsorted(key, hits), np.searchsorted(key, hits, side="right")
                        items, shared = np.unique(np.concatenate([owner[x:y] for x, y in zip(lo, hi, strict=True)]), return_counts=True)
                        for i in items[shared >= index.least[items]].tolist():
                            if d not in sets:
                                sets[d] = np.unique(got[start[d] : start[d + 1]])
                            common = _common(sets[d], index.sets[i])
                            if 100 * common >= pct * len(index.sets[i]):
                                out.append((d, i, len(index.sets[i]), common))
            rows = np.array([r[0] for r in out], dtype=np.int64)
            yield pa.record_batch(
                [
                    ids.take(pa.array(rows)),
                    pa.array([index.ids[r[1]] for r in out], pa.int64()),
                    pa.array([r[2] for r in out], pa.int64()),
                    pa.array([r[3] for r in out], pa.int64()),
                ],
                names=["id", "item", "n_item", "n_shared"],
            )

    return run


def _item_sketches(pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, k, n, raw in zip(*(column(b, c).to_pylist() for c in ("row", "k", "n", "hashes")), strict=True):
                got = np.frombuffer(raw, dtype="<u8")[: sketch_length(n, pct)]
                m = len(got)
                yield pa.record_batch(
                    [pa.array([row] * m), pa.array([k] * m, pa.int32()), pa.array([partition_of(n)] * m), pa.array([least_shared(n)] * m, pa.int64()), pa.array(got.view(np.int64))],
                    names=["row", "k", "upper", "least", "hash"],
                )

    return run


def _bits(pdf):
    at = pdf["hash"].to_numpy().view(np.uint64) & np.uint64((1 << BITMAP_BITS) - 1)
    seen = np.zeros(1 << (BITMAP_BITS - 10), dtype=bool)
    seen[(at & np.uint64((1 << (BITMAP_BITS - 10)) - 1)).astype(np.int64)] = True
    return pdf.head(1)[["seg"]].assign(bits=[np.packbits(seen).tobytes()])


def _doc_sketches(shared, scales: list[tuple[int, int]], words: int):
    """(key, k, hash): sketch hashes of documents that some item may have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for b in blocks(batches, "text"):
            vocab, codes, off = split_words(column(b, "text"), lower=True)
            hashed = word_hashes(vocab)[codes]
            keys = column(b, "key").to_numpy(zero_copy_only=False)
            for k, largest in scales:
                got, start = _windows(hashed, off, k, words)
                at = (got & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
                here = np.flatnonzero((got <= np.uint64(largest)) & (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))
                doc = np.searchsorted(start, here, side="right") - 1
                pairs = np.unique(np.stack([doc.astype(np.uint64), got[here]]), axis=1)
                n = pairs.shape[1]
                yield pa.record_batch(
                    [pa.array(keys[pairs[0].astype(np.int64)]), pa.array([k] * n, pa.int32()), pa.array(pairs[1].copy().view(np.int64))], names=["key", "k", "hash"]
                )

    return run


def _verify(words: int, pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, last, mine = [], None, None
            cols = (column(b, c).to_pylist() for c in ("id", "item", "n", "k", "hashes"))
            for at, (i, item, n, k, raw) in enumerate(zip(*cols, strict=True)):
                text = column(b, "text")[at]
                if last != (k, text):
                    last = k, text
                    vocab, codes, off = split_words(pa.array([text.as_py()], pa.string()), lower=True)
                    mine = np.unique(_windows(word_hashes(vocab)[codes], off, k, words)[0])
                common = _common(mine, np.frombuffer(raw, dtype="<u8")) if len(mine) else 0
                if 100 * common >= pct * n:
                    out.append((i, item, n, common))
            names = ["id", "item", "n_item", "n_shared"]
            yield pa.record_batch([pa.array([r[j] for r in out], pa.int64()) for j in range(4)], names=names)

    return run


def _by_join(texts: DataFrame, sets: DataFrame, words: int, pct: int) -> DataFrame:
    """The search by an equi-join of sketches, for any number of items."""
    spark = texts.sparkSession
    sets = materialize(sets.withColumn("row", F.monotonically_increasing_id()), "items")
    sketches = materialize(sets.mapInArrow(_item_sketches(pct), "row long, k int, upper long, least long, hash long"), "item-sketches")
    order = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))  # hashes are unsigned
    scales = [(r["k"], (r["m"] ^ -(1 << 63)) & (1 << 64) - 1) for r in sketches.groupBy("k").agg(F.max(order).alias("m")).collect()]
    seg = F.shiftrightunsigned("hash", BITMAP_BITS - 10).bitwiseAND(1023).cast("int")
    parts = sketches.select(seg.alias("seg"), "hash").distinct().groupBy("seg").applyInPandas(_bits, "seg int, bits binary")
    bitmap = np.zeros((1024, 1 << (BITMAP_BITS - 13)), dtype=np.uint8)
    for r in parts.toLocalIterator():
        bitmap[r["seg"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    keyed = texts.withColumn("key", F.xxhash64("id", "text"))
    hits = keyed.mapInArrow(_doc_sketches(spark.sparkContext.broadcast(bitmap.ravel()), scales, words), "key long, k int, hash long")
    found = hits.join(sketches, ["k", "hash"]).groupBy("key", "row").agg(F.count_distinct("hash").alias("shared"), F.first("least").alias("least"))
    pairs = materialize(found.filter("shared >= least").select("key", "row"), "candidates")
    rows = pairs.join(sets.select("row", F.col("id").alias("item"), "k", "n", "hashes"), "row").join(keyed, "key")
    return rows.sortWithinPartitions("key", "k").select("id", "text", "item", "k", "n", "hashes").mapInArrow(_verify(words, pct), "id long, item long, n_item long, n_shared long")


def _windows(hashed: np.ndarray, off: np.ndarray, k: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows; for k below ``words`` as a short item's whole sequence."""
    if k == words:
        return shingle_hashes(hashed, off, k, short=False)
    n = np.maximum(np.diff(off) - k + 1, 0)
    start = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=start[1:])
    # every window as a row of its own
    rows = np.repeat(off[:-1] - start[:-1], n) + np.arange(int(n.sum()))
    flat = hashed[(rows[:, None] + np.arange(k)[None, :]).ravel()]
    got, _ = shingle_hashes(flat, np.arange(0, k * len(rows) + 1, k), words)
    return got, start


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = WORDS,
    threshold_pct: int = THRESHOLD_PCT,
) -> DataFrame:
    """One row per document and item in it: id_col, item_col, n_item, n_shared, containment."""
    spark = docs.sparkSession
    named = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    sets = materialize(named.mapInArrow(_item_sets(words), "id long, k int, n long, hashes binary").filter("n > 0"), "items")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = sets.agg(F.sum("n")).first()[0] or 0
    if not size:
        found = spark.createDataFrame([], "id long, item long, n_item long, n_shared long")
    elif size <= BLOCK_HASHES:
        block = spark.sparkContext.broadcast([tuple(r) for r in sets.toLocalIterator()])
        found = texts.mapInArrow(_search(block, words, threshold_pct), "id long, item long, n_item long, n_shared long")
    else:
        found = _by_join(texts, sets, words, threshold_pct)
    return found.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        "n_item",
        "n_shared",
        (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the documents into which an item leaks; rows with a null id stay."""
    name = unused(docs, "leak")
    bad = leaks(docs, items, id_col, text_col, **kw).select(F.col(id_col).alias(name)).distinct()
    return docs.join(bad, docs[id_col] == bad[name], "left_anti")

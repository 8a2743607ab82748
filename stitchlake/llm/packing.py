"""Lexical retrieval packing: fills training windows with documents that BM25 finds alike.

Documents are tokenized (``end_id`` after each) and dealt to index shards of about ``shard_tokens``
tokens by content: documents are range partitioned and sorted by their most frequent id, which tells
languages and styles apart, then by the MinHash of their ``TOPIC_TERMS`` heaviest terms, then by a hash
of the id, so that a topic of any size can be split; consecutive ones share a shard. A shard is an inverted index over token ids with
BM25 weights; the document frequencies and the mean length behind the weights are counted over all
documents. A window starts from a seed document; all its terms query the shard, and the unused
neighbours fill the window from the best down. Where none is left, the next unused document is the
next seed. The document that reaches a window's end is cut there and its rest seeds the following
window, so windows are full. What a task has left at its end is cut into sequences whose lengths are
powers of two, which need no padding. Each id lies in exactly one piece.

Shards steer neighbours only, never which ids are packed: a neighbour in another shard is not found
(README gives the share). The token table is written once to the shared folder and shuffled once by
topic; a lost task is repeated from both with the same result.

Defined cases: a null or empty text is the end id alone; repeated rows and null ids are packed as
rows of their own; equal BM25 scores (ties) go in the order of the shard; a very long text fills
windows of its own from start to end; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import materialize, sum_vectors
from ._text import blocks, column, crc32_ids
from ._tokens import default_tokenizer, encoder

WINDOW = 4096
END_ID = 2
K1, B = 1.2, 0.75
#: Heaviest terms that query a shard (None: all), and those that a topic is hashed from.
QUERY_TERMS, TOPIC_TERMS = None, 8
#: Tokens of a range partition.
PART_TOKENS = 1 << 24
SHARD_TOKENS = 1 << 21
_SEGMENT = 1 << 13
SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _terms(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, times) of documents given on end, by term and document."""
    key = ids.astype(np.uint64) << np.uint64(32)
    key |= np.repeat(np.arange(len(size), dtype=np.uint64), size)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    times, key = np.diff(first, append=len(key)), key[first]
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), times


def _by_document(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of terms by document, where each of the ``n`` documents ends)."""
    order = np.argsort(owner.astype(np.uint16 if n <= 1 << 16 else np.uint32), kind="stable")
    return order, np.cumsum(np.bincount(owner, minlength=n))


def _topics(ids: np.ndarray, size: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of documents: in how many each term is; each one's most frequent id (the smallest on ties); the
    smallest hash of its heaviest terms, weighed within the block."""
    terms, owner, times = _terms(ids, size)
    df = np.bincount(terms, minlength=vocab)
    order, ends = _by_document(owner, len(size))
    terms, times = terms[order], times[order]
    most = np.maximum.reduceat(times << 32 | 0xFFFFFFFF - terms, np.append(0, ends[:-1])) if len(size) else times
    less = -(times / (times + K1) * np.log1p(len(size) / df[terms]))
    hashed = (terms.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)
    topic, a = np.empty(len(size), dtype=np.int64), 0
    for d, b in enumerate(ends.tolist()):
        h = hashed[a:b]
        if b - a > TOPIC_TERMS:
            h = h[less[a:b].argpartition(TOPIC_TERMS)[:TOPIC_TERMS]]
        topic[d] = h.min()
        a = b
    return df, 0xFFFFFFFF - (most & 0xFFFFFFFF), topic


def _tokenize(path: str, end: int, vocab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        df = np.zeros(vocab, dtype=np.uint64)
        names = ["id", "n", "lead", "topic", "ids", "seg", "part", "counts"]
        for b in blocks(batches, "text", keep=True):
            ids, off = encoder(path).encode(column(b, "text"), end)
            here, lead, topic = _topics(ids, np.diff(off), vocab)
            df += here.astype(np.uint64)
            raw = ids.astype("<u4" if vocab > 1 << 16 else "<u2")
            k = b.num_rows
            yield pa.record_batch(
                [
                    column(b, "id"),
                    pa.array(np.diff(off)),
                    pa.array(lead), pa.array(topic),
                    pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer((off * raw.itemsize).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())]),
                    pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()),
                ],
                names=names,
            )
        rows = vocab // _SEGMENT
        yield pa.record_batch(
            [
                *(pa.nulls(rows, pa.int64()) for _ in range(4)), pa.nulls(rows, pa.binary()),
                pa.array(range(rows), pa.int32()),
                pa.array([TaskContext.get().partitionId()] * rows, pa.int32()),
                pa.array([x.tobytes() for x in df.astype("<u8").reshape(rows, _SEGMENT)], pa.binary()),
            ],
            names=names,
        )

    return run


class Shard:
    """BM25 over the documents of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float, query_terms: int | None):
        self.n = len(docs)
        size = np.fromiter(map(len, docs), dtype=np.int64, count=self.n)
        term, owner, tf = _terms(np.concatenate(docs), size)  # the order of the lists
        weight = idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / mean_length)))
        by_doc, ends = _by_document(owner, self.n)
        self.query = np.split(term[by_doc], ends[:-1])
        if query_terms:
            heavy = [np.argpartition(-w, query_terms)[:query_terms] if query_terms < len(w) else slice(None) for w in np.split(weight[by_doc], ends[:-1])]
            self.query = [t[h] for t, h in zip(self.query, heavy, strict=True)]
        self.first = np.zeros(len(idf) + 1, dtype=np.int64)
        np.cumsum(np.bincount(term, minlength=len(idf)), out=self.first[1:])
        self.owner, self.weight = owner, weight.astype(np.float64)  # the types that bincount works with, so that a query converts nothing
        self.used, self.dropped = np.zeros(self.n, dtype=bool), 0
        self._tabulate()

    def _tabulate(self) -> None:
        """Lists of a quarter of the documents and more become rows of a table over the documents in the lists, which are
        added up faster."""
        self.docs = np.flatnonzero(~self.used)
        column = np.zeros(self.n, dtype=np.int64)
        column[self.docs] = np.arange(len(self.docs))
        size = np.diff(self.first)
        common = np.flatnonzero((4 * size >= len(self.docs)) & (size > 0))
        self.row = np.full(len(size), -1, dtype=np.int64)
        self.row[common] = np.arange(len(common))
        self.table = np.zeros((len(common), len(self.docs)), dtype=np.float32)
        for k, t in enumerate(common.tolist()):
            span = slice(self.first[t], self.first[t + 1])
            self.table[k, column[self.owner[span]]] = self.weight[span]

    def drop_used(self) -> None:
        """Leave used documents out of the lists."""
        keep = ~self.used[self.owner]
        self.owner, self.weight = self.owner[keep], self.weight[keep]
        before = np.zeros(len(keep) + 1, dtype=np.int64)
        np.cumsum(keep, out=before[1:])
        self.first = before[self.first]
        self.dropped = int(self.used.sum())
        self._tabulate()

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a query term with ``seed``, best first."""
        if 4 * int(self.used.sum()) > self.n + 3 * self.dropped:  # a quarter of those in the lists are used
            self.drop_used()
        terms = self.query[seed]
        row = self.row[terms]
        rare = terms[row < 0]
        spans = [slice(a, b) for a, b in zip(self.first[rare].tolist(), self.first[rare + 1].tolist(), strict=True)]
        score = np.zeros(self.n)
        if spans:
            score += np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), minlength=self.n)
        score[self.docs] += self.table.take(row[row >= 0], axis=0).sum(axis=0)
        score[self.used] = 0
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


class _Packer:
    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.open: list[tuple] = []  # pieces of the window being filled
        self.filled = 0
        self.rows: list[tuple] = []

    def put(self, doc, ids: np.ndarray, start: int) -> int:
        """Place ids from ``start`` on; returns where the window ended, len(ids) if it did not."""
        take = min(self.window - self.filled, len(ids) - start)
        self.open.append((doc, ids, start, take))
        self.filled += take
        if self.filled == self.window:
            self._close(self.open)
            self.open, self.filled = [], 0
        return start + take

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, ids, start, n in pieces:
            self.rows.append((doc, start, n, crc32_ids(ids[start : start + n]), len(ids), self.sequence, at))
            at += n
        self.sequence += 1

    def rest(self) -> None:
        """Close the last window as sequences of power-of-two lengths."""
        pieces, self.open = self.open, []
        for bit in reversed(range(self.filled.bit_length())):
            want = self.filled & 1 << bit
            mine = []
            while want:
                doc, ids, start, n = pieces.pop(0)
                take = min(n, want)
                mine.append((doc, ids, start, take))
                want -= take
                if take < n:
                    pieces.insert(0, (doc, ids, start + take, n - take))
            if mine:
                self._close(mine)
        self.filled = 0

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows, strict=True)) or [()] * 7
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _pack_shard(packer: _Packer, ids_of: list, docs: list[np.ndarray], shard: Shard) -> None:
    ahead, seed, found, at_found = 0, -1, np.empty(0, dtype=np.int64), 0
    while True:
        pick = -1
        while at_found < len(found):
            if not shard.used[found[at_found]]:
                pick = int(found[at_found])
                break
            at_found += 1
        if pick < 0:
            while ahead < shard.n and shard.used[ahead]:
                ahead += 1
            if ahead == shard.n:
                return
            pick = ahead
            found = None
        shard.used[pick] = True
        at, new = 0, False
        while at < len(docs[pick]):
            at = packer.put(ids_of[pick], docs[pick], at)
            new = new or packer.filled == 0 or at < len(docs[pick])
        if found is None or new:  # a first seed, or this document's rest has begun a window
            found, at_found = shard.neighbours(pick), 0


def _pack(idf, mean_length: float, window: int, query_terms: int | None, shard_tokens: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer(window, TaskContext.get().partitionId() << 32)
        ids_of: list = []
        docs: list[np.ndarray] = []
        held = 0

        def flush():
            _pack_shard(packer, ids_of, docs, Shard(docs, idf.value, mean_length, query_terms))
            return packer.drain()

        for b in batches:
            for i, raw in zip(column(b, "id").to_pylist(), column(b, "ids"), strict=True):
                ids = np.frombuffer(raw.as_py(), dtype=f"<u{width}")
                ids_of.append(i)
                docs.append(ids)
                held += len(ids)
                if held >= shard_tokens:
                    yield flush()
                    ids_of, docs, held = [], [], 0
        if docs:
            _pack_shard(packer, ids_of, docs, Shard(docs, idf.value, mean_length, query_terms))
        packer.rest()
        yield packer.drain()

    return run


def _vocab_size(spark: SparkSession, path: str) -> int:
    """The number of ids of a tokenizer, which a task loads: it takes 40 MB that the driver need not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        for b in batches:
            yield pa.record_batch([pa.array([Tokenizer.from_file(path).get_vocab_size()] * b.num_rows, pa.int64())], names=["n"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "n long").first()["n"]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    query_terms: int | None = QUERY_TERMS,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    vocab = -(-_vocab_size(docs.sparkSession, path) // _SEGMENT) * _SEGMENT
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = materialize(
        rows.mapInArrow(_tokenize(path, end_id, vocab), "id long, n long, lead long, topic long, ids binary, seg int, part int, counts binary"), "tokens"
    )
    df = sum_vectors(made.filter("seg is not null").select("seg", "part", "counts"), _SEGMENT, vocab // _SEGMENT).astype(np.float64)
    tokens = made.filter("seg is null")
    n, total = tokens.agg(F.count("*"), F.sum("n")).first()
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean_length = (total or 0) / max(n, 1) or 1.0
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    width = 4 if vocab > 1 << 16 else 2
    parts = max(-(-(total or 1) // PART_TOKENS), min(8, -(-(total or 1) // shard_tokens)))
    by = ["lead", "topic", F.xxhash64("id")]
    dealt = tokens.select("id", "ids", "lead", "topic").repartitionByRange(parts, *by).sortWithinPartitions(*by)
    found = dealt.select("id", "ids").mapInArrow(_pack(shared, mean_length, window, query_terms, shard_tokens, width), SCHEMA)
    return found.withColumnRenamed("id", id_col)

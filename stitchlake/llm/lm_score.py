"""Masked pseudo-likelihood scores from a bidirectional window network, trained in numpy.

The network predicts a word from ``SIDE`` words on either side: their embeddings are scaled by
gains of their positions, summed and squashed, and a two-level softmax (64 classes of 64 ids)
gives the word's probability. A document's score is the sum of the conditional log-probabilities of
all its words, each predicted with itself masked.

* Vocabulary: words (``[^ \\t-\\r]+``) are counted over all documents; the most frequent have ids of
  their own in order of frequency. Every other word has the id of its ending (last two characters,
  hashed), which the network predicts as it does a word, and within it the share of its count in the
  count of all words of that id (a join with all counts, so the table grows with the corpus). Every
  word has a probability of its own and they sum to one. One id stands outside a text.
* Training: documents are dealt by a hash of id and words to chunks of about ``CHUNK_WORDS`` words,
  and chunks to rounds: up to ``ROUNDS`` of them one chunk each, and one more each time their number doubles
  after that, so that the successive steps grow with the corpus. In a round each chunk runs mini-batch Adagrad (an accumulator
  a row) from the common parameters with every word as a target once; parameters and accumulators
  of the chunks are averaged with their numbers of words as weights, in a tree of fixed fan-in.
  What is trained between two averages depends on neither partitions nor cluster. What is broadcast
  or returned to the driver is one set of parameters (1 MB), whatever the input.
* Scoring: one pass over the coded documents.

Defined cases: null text and text without words have 0 words, score 0 and a null mean; null ids
and repeated rows are scored row by row; words of equal frequency (ties) get ids by their hash; a
very long text is scored whole, in batches; an empty table gives an empty result; other columns are
not read. Seeds are fixed, so equal tables give equal scores up to the rounding of sums, however
they are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, sum_vectors
from ._text import blocks, column, split_words, word_hashes

CLASSES, PER_CLASS = 64, 64
VOCAB = CLASSES * PER_CLASS
#: Ids of endings, for the words beyond the most frequent ones.
ENDINGS = 512
OUTSIDE = VOCAB - 1
KNOWN = VOCAB - ENDINGS - 1
SIDE, DIM = 2, 24
ROUNDS, CHUNK_WORDS = 6, 1 << 21
BATCH, SCORE_BATCH = 8192, 1 << 15
#: Rows whose scores of ``CLASSES`` fit a core's cache.
PIECE = 1 << 12
RATE = 0.1
SEED = 7
_SHAPES = {
    "E": (VOCAB, DIM),
    "P": (2 * SIDE, DIM),
    "b": (DIM,),
    "C": (DIM, CLASSES),
    "cb": (CLASSES,),
    "W": (CLASSES, DIM, PER_CLASS),
    "wb": (CLASSES, PER_CLASS),
}
#: Shapes of Adagrad's accumulators: one for each row of weights.
_ROWS = {"E": (VOCAB, 1), "P": (2 * SIDE, 1), "b": (DIM,), "C": (1, CLASSES), "cb": (CLASSES,), "W": (CLASSES, 1, PER_CLASS), "wb": (CLASSES, PER_CLASS)}
_ALL = {**_SHAPES, **{k + "2": v for k, v in _ROWS.items()}}
_SIZE = sum(int(np.prod(s)) for s in _ALL.values())
_SEGMENT = 1 << 15
_SEGMENTS = -(-(_SIZE + 1) // _SEGMENT)


def initial(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; biases start at the corpus frequencies of the ids."""
    rng = np.random.default_rng(SEED)
    p = {k: np.zeros(s, dtype=np.float32) for k, s in _SHAPES.items()}
    p["E"][:] = rng.normal(0, 0.1, _SHAPES["E"])
    p["P"][:] = 1
    p["C"][:] = rng.normal(0, 0.1, _SHAPES["C"])
    p["W"][:] = rng.normal(0, 0.1, _SHAPES["W"])
    f = (counts + 1.0).reshape(CLASSES, PER_CLASS)
    p["cb"][:] = np.log(f.sum(axis=1) / f.sum())
    p["wb"][:] = np.log(f / f.sum(axis=1, keepdims=True))
    return p | {k + "2": np.full(v, 0.1, dtype=np.float32) for k, v in _ROWS.items()}


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _ALL])


def unflatten(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _ALL.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def padded(ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents on end with ``SIDE`` ids OUTSIDE before, between and after them, and where their words stand."""
    n = np.diff(off)
    real = np.arange(len(ids)) + SIDE * (1 + np.repeat(np.arange(len(n)), n))
    line = np.full(len(ids) + SIDE * (len(n) + 1), OUTSIDE, dtype=np.uint16)
    line[real] = ids
    return line, real


def stretches(line: np.ndarray, real: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of a padded line with up to ``words`` words, each with ``SIDE`` neighbours on both sides,
    and the places of the words, counted from the first that has neighbours."""
    for lo in range(0, len(real), words):
        at = real[lo : lo + words]
        yield line[at[0] - SIDE : at[-1] + SIDE + 1], at - at[0]


_ONES = np.ones(SCORE_BATCH, dtype=np.float32)


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ _ONES[: x.shape[1]]


def _column_sums(x: np.ndarray) -> np.ndarray:
    return (_ONES if len(x) <= len(_ONES) else np.ones(len(x), dtype=np.float32))[: len(x)] @ x


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exponentials of the rows. Squashed values keep scores of a row within a
    range that one shift for all rows serves."""
    most = x.max()
    x -= most
    return np.log(_row_sums(np.exp(x, out=x))) + most


#: Where the neighbours of a place stand, counted from SIDE before it.
_SHIFTS = [*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1)]


def hidden(p: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    """Of every place but the first and last ``SIDE``, from the embeddings ``around``."""
    n = len(around) - 2 * SIDE
    z = around[:n] * p["P"][0]
    for j, at in enumerate(_SHIFTS[1:], 1):
        z += around[at : at + n] * p["P"][j]
    z += p["b"]
    return np.tanh(z, out=z)


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Order of places by class, ids within the classes in that order, and (class, from, to) of each class met."""
    order = np.argsort((target // PER_CLASS).astype(np.uint8 if CLASSES <= 256 else np.int64), kind="stable")
    cls = target[order] // PER_CLASS
    edges = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    return order, target[order] % PER_CLASS, [(c, edges[c], edges[c + 1]) for c in range(CLASSES) if edges[c] < edges[c + 1]]


def _pieces(lo: int, hi: int) -> Iterator[tuple[int, int]]:
    return ((at, min(at + PIECE, hi)) for at in range(lo, hi, PIECE))


def _picked(h: np.ndarray, w: np.ndarray, b: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each row's target."""
    x = h @ w
    x += b
    return x[np.arange(len(x)), target] - _log_sum(x)


def log_probs(p: dict[str, np.ndarray], line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of the words at the places ``at`` of a stretch, each given its neighbours."""
    h, target = hidden(p, p["E"].take(line, axis=0)).take(at, axis=0), line[at + SIDE].astype(np.int64)
    out, mine = np.empty((2, len(target)), dtype=np.float32)
    for lo, hi in _pieces(0, len(target)):
        out[lo:hi] = _picked(h[lo:hi], p["C"], p["cb"], target[lo:hi] // PER_CLASS)
    order, within, met = _by_class(target)
    h = h.take(order, axis=0)
    for c, first, end in met:
        for lo, hi in _pieces(first, end):
            mine[lo:hi] = _picked(h[lo:hi], p["W"][c], p["wb"][c], within[lo:hi])
    out[order] += mine
    return out


def _slopes(x: np.ndarray, target: np.ndarray, scale: np.float32) -> np.ndarray:
    """Softmax of the rows less one at each row's target, scaled; in place."""
    x -= x.max()
    np.exp(x, out=x)
    x *= (scale / _row_sums(x))[:, None]
    x[np.arange(len(x)), target] -= scale
    return x


class Trainer:
    """Adagrad on mini-batches, in place on a copy of the parameters."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: v.copy() for k, v in p.items()}

    def _step(self, k: str, g: np.ndarray, at=..., axis: int | None = None) -> None:
        rows = self.p[k + "2"]
        rows[at] += g * g if axis is None else (g * g).mean(axis=axis, keepdims=True)
        g *= RATE
        g /= np.sqrt(rows[at])
        self.p[k][at] -= g

    def batch(self, line: np.ndarray, at: np.ndarray) -> None:
        """One step on the words at the places ``at`` of a stretch."""
        p, n, target = self.p, len(at), line[at + SIDE].astype(np.int64)
        around = p["E"].take(line, axis=0)
        whole = hidden(p, around)
        h = whole.take(at, axis=0)
        scale = np.float32(1 / np.sqrt(n))
        d = h @ p["C"]
        d += p["cb"]
        d = _slopes(d, target // PER_CLASS, scale)
        dh = d @ p["C"].T
        gc, gcb = h.T @ d, _column_sums(d)
        order, within, met = _by_class(target)
        place = np.empty_like(order)
        place[order] = np.arange(n)
        hs, back = h.take(order, axis=0), np.empty_like(h)
        gw, gwb = np.zeros_like(p["W"]), np.zeros_like(p["wb"])
        for c, lo, hi in met:
            x = hs[lo:hi] @ p["W"][c]
            x += p["wb"][c]
            d = _slopes(x, within[lo:hi], scale)
            np.matmul(d, p["W"][c].T, out=back[lo:hi])
            np.matmul(hs[lo:hi].T, d, out=gw[c])
            gwb[c] = _column_sums(d)
        dh += back.take(place, axis=0)
        h *= h
        dh *= 1 - h
        dz = np.zeros_like(whole)
        dz[at] = dh
        gp, ge, m = np.zeros_like(p["P"]), np.zeros_like(around), len(whole)
        for j, shift in enumerate(_SHIFTS):
            gp[j] = _column_sums(dz * around[shift : shift + m])
            ge[shift : shift + m] += dz * p["P"][j]
        by = np.argsort(line, kind="stable")
        ids = line[by]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        self._step("W", gw, axis=1)
        self._step("wb", gwb)
        self._step("C", gc, axis=0)
        self._step("cb", gcb)
        self._step("b", dz.sum(axis=0))
        self._step("E", np.add.reduceat(ge.take(by, axis=0), first, axis=0), ids[first], 1)
        self._step("P", gp, axis=1)


def _endings(vocab: pa.Array) -> np.ndarray:
    """The number of each word's ending."""
    last = pc.utf8_slice_codeunits(vocab, -2, None).dictionary_encode()
    of = word_hashes(last.dictionary) % np.uint64(ENDINGS)
    return of.astype(np.int32)[last.indices.to_numpy(zero_copy_only=False)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "text"):
        vocab, codes, _ = split_words(column(b, "text"), lower=False)
        n = np.bincount(codes, minlength=len(vocab))
        yield pa.record_batch([pa.array(word_hashes(vocab).view(np.int64)), pa.array(_endings(vocab)), pa.array(n.astype(np.int64))], names=["word", "ending", "c"])


def _code(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, ids = table.value
        row = TaskContext.get().partitionId() << 33
        for b in blocks(batches, "text"):
            vocab, codes, off = split_words(column(b, "text"), lower=False)
            h = word_hashes(vocab)
            of = (KNOWN + _endings(vocab)).astype(np.uint16)
            if len(known):
                at = np.minimum(np.searchsorted(known, h.view(np.int64)), len(known) - 1)
                of = np.where(known[at] == h.view(np.int64), ids[at], of)
            coded = of.astype("<u2")[codes]
            raw = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((off * 2).astype(np.int32).tobytes()), pa.py_buffer(coded.tobytes())])
            at = np.flatnonzero((of >= KNOWN)[codes])
            doc = np.repeat(np.arange(b.num_rows), np.diff(off))[at]
            pair, n = np.unique(doc * len(vocab) + codes[at], return_counts=True)
            doc, word = np.divmod(pair, max(len(vocab), 1))
            first = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            rare, times = pa.array(h.view(np.int64)[word]), pa.array(n.astype(np.int32))
            keys = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            yield pa.record_batch(
                [keys, column(b, "id"), raw, pa.ListArray.from_arrays(first, rare), pa.ListArray.from_arrays(first, times)],
                names=["key", "id", "ids", "rare", "times"],
            )

    return run


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, their word ids, offsets) of about ``most`` words at a time; documents stay whole."""
    held, docs, n = [], [], 0
    for b in batches:
        for i, raw in zip(column(b, "id").to_pylist(), column(b, "ids"), strict=True):
            held.append(np.frombuffer(raw.as_py(), dtype="<u2"))
            docs.append(i)
            n += len(held[-1])
            if n >= most:
                yield docs, np.concatenate(held), np.cumsum([0, *map(len, held)])
                held, docs, n = [], [], 0
    if docs:
        yield docs, np.concatenate(held), np.cumsum([0, *map(len, held)])


def _train(shared):
    """One chunk, in the order of its documents' hashes."""

    def run(pdf):
        pdf = pdf.sort_values(["h", "ids"], kind="stable")
        trainer, places = Trainer(unflatten(shared.value)), 0
        held, n = [], 0

        def learn() -> None:
            for stretch in stretches(*padded(np.concatenate(held), np.cumsum([0, *map(len, held)])), BATCH):
                trainer.batch(*stretch)

        for raw in pdf["ids"]:
            held.append(np.frombuffer(raw, dtype="<u2"))
            n += len(held[-1])
            places += len(held[-1])
            if n >= 8 * BATCH:
                learn()
                held, n = [], 0
        if n:
            learn()
        v = np.zeros(_SEGMENTS * _SEGMENT, dtype=np.float32)
        v[:_SIZE] = flatten(trainer.p) * np.float32(places / CHUNK_WORDS)
        v[_SIZE] = places / CHUNK_WORDS
        part = pdf["chunk"].iloc[0] if len(pdf) else 0
        return pd.DataFrame({"seg": np.arange(_SEGMENTS), "part": part, "counts": [x.tobytes() for x in v.astype("<f4").reshape(_SEGMENTS, _SEGMENT)]})

    return run


def _score(shared, shares: np.ndarray):
    """Scores without the counts of words within the hashed ids: ``shares`` are the logarithms of the
    ids' own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unflatten(shared.value)
        for docs, ids, off in _texts(batches, SCORE_BATCH):
            got = np.concatenate([np.zeros(0), *(log_probs(p, *x).astype(np.float64) for x in stretches(*padded(ids, off), SCORE_BATCH))])
            got -= shares[ids]
            total = np.bincount(np.repeat(np.arange(len(docs)), np.diff(off)), weights=got, minlength=len(docs))
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(np.diff(off)), pa.array(total)], names=["key", "n_words", "log_prob"])

    return run


def rounds_of(chunks: int, least: int = ROUNDS) -> int:
    """How many rounds ``chunks`` chunks are dealt to: ``least`` (at most one a chunk), and one more a doubling beyond."""
    return min(least, chunks) + (max(0, (chunks // least).bit_length() - 1) if least else 0)


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, chunk_words: int = CHUNK_WORDS, held_out: int | None = None) -> DataFrame:
    """id_col, n_words, log_prob (sum over all words), mean_log_prob of every row. With ``held_out`` = m the network
    does not learn from rows whose crc32 of the id (as text) is 0 modulo m; they are counted and scored."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count, "word long, ending int, c long").groupBy("word").agg(F.first("ending").alias("ending"), F.sum("c").alias("c"))
    counts = materialize(counted, "counts")
    top = counts.orderBy(F.desc("c"), "word").limit(KNOWN).collect()
    freq = np.zeros(VOCAB)
    freq[: len(top)] = [r["c"] for r in top]
    for r in counts.groupBy("ending").agg(F.sum("c").alias("c")).collect():
        freq[KNOWN + r["ending"]] += r["c"]
    total = int(freq.sum())
    for r in top:
        freq[KNOWN + r["ending"]] -= r["c"]
    total -= sum(r["c"] for r in top)
    shares = np.zeros(VOCAB)
    shares[KNOWN : KNOWN + ENDINGS] = np.log(np.maximum(freq[KNOWN : KNOWN + ENDINGS], 1))
    hashes = np.array([r["word"] for r in top], dtype=np.int64)
    order = np.argsort(hashes)
    table = sc.broadcast((hashes[order], order.astype(np.uint16)))
    chunks = max(1, -(-total // chunk_words))
    h = F.xxhash64("id", "ids", F.when(F.col("id").isNull(), F.col("key")))
    made = rows.mapInArrow(_code(table), "key long, id long, ids binary, rare array<long>, times array<int>")
    coded = materialize(made.withColumn("h", h).withColumn("chunk", F.pmod(F.xxhash64("h"), F.lit(chunks)).cast("int")), "coded")
    params = flatten(initial(freq))
    rounds = rounds_of(chunks, rounds)
    for k in range(rounds):
        part = coded.filter((F.col("chunk") % rounds == k) & (F.octet_length("ids") > 0))
        if held_out:
            part = part.filter(F.coalesce(F.crc32(F.col("id").cast("string")) % held_out, F.lit(1)) != 0)
        part = part.select("chunk", "h", "ids")
        trained = part.repartition(3 * -(-chunks // rounds), "chunk").groupBy("chunk").applyInPandas(_train(sc.broadcast(params)), "seg int, part int, counts binary")
        got = sum_vectors(materialize(trained, "parameters"), _SEGMENT, _SEGMENTS, "<f4")
        if got[_SIZE]:
            params = (got[:_SIZE] / got[_SIZE]).astype(np.float32)
    found = coded.select(F.col("key").alias("id"), "ids").mapInArrow(_score(sc.broadcast(params), shares), "key long, n_words long, log_prob double")
    rare = coded.select("key", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("key", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    own = rare.join(counts, "word").groupBy("key").agg(F.sum(F.col("times") * F.log("c")).alias("log_prob"))
    parts = found.unionByName(own, allowMissingColumns=True).unionByName(coded.select("key", "id"), allowMissingColumns=True)
    found = parts.groupBy("key").agg(F.max("id").alias("id"), F.sum("n_words").alias("n_words"), F.sum("log_prob").alias("log_prob")).drop("key")
    return found.withColumn("mean_log_prob", F.expr("log_prob / nullif(n_words, 0)")).withColumnRenamed("id", id_col)

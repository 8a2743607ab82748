"""N-gram Jaccard self-join of documents: a size-aware heavy-light join.

A document's set holds its distinct 5-word shingles (words ``[^ \\t-\\r]+``, A-Z lower-cased; with
one to four words the whole sequence is the one shingle; none without words). Two documents link
when ``100 * |intersection| >= threshold_pct * |union|``. For set sizes n and m this asks for an
overlap of at least ``o(n, m) = ceil(t (n + m) / (100 + t))``.

* **Light sets** (size up to a boundary) list all their subsets of the sizes ``o(n, m)`` that a
  partner of size m could ask for; two light sets that link share such a subset.
* **Heavy sets** put their first ``n - ceil(t n / 100) + 1`` shingles, rare ones first, in
  inverted lists; so do light sets near the boundary. Sets that link share a list. The order is
  by a count sketch over the shingles of all documents and then by hash, so widely shared
  passages come last. Rarity steers cost only: any fixed order gives the same links.
* **The boundary** has the least cost: for every size up to ``LARGEST_LIGHT`` the rows that its sets
  would list as subsets are compared with the entries of their prefixes and the lengths of the lists
  they would be put in, as the sketch counts them for these very shingles. (Beyond that size a set
  lists over ten thousand subsets.) Cost alone moves it: links are exact at any boundary.

Lists with one node are found by an aggregation with map-side combine; what remains is joined by
element, so a hot list can be split. Documents with equal sets are one node throughout, and a worker sends an entry of a node once a
block of text, so groups of copies neither form long lists nor pairs. Lists are read in
rounds: members are verified against a few pivots of their lists, changing from round to round,
and the links found become components; lists within one component are done. At last the pairs of
a list that still lie in different components are all verified, where their sizes, places and
parity bits allow a link: pairs meet by list and size band. Pairs inside a component are
never formed. No pair that could link is dropped: sizes, places in the lists and, in the last
round, parity bits of the sets only exclude pairs that they prove apart (the bits in which two sets
differ are no more than the shingles in which they differ). So components are exact.
Sets are compared by 64-bit hashes of shingles.

Defined cases: null text, empty text and text without words give an empty set, linked with
nothing (component: its own id). A very long text is one set, whole. Documents with equal sets (ties) are
one node; of equally rare shingles the smaller hash comes first. Rows that share an id are one document. A null id keeps its row;
it counts for no smallest id. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import components, discard, materialize, sum_vectors
from ._text import blocks, column, shingle_hashes, split_words, word_hashes

WORDS = 5
THRESHOLD_PCT = 80
#: Counters of the sketch (8 MB in all, fixed) and of one row of it.
SKETCH, SEGMENT = 1 << 21, 1 << 15
#: Largest size for which listing subsets is weighed against lists.
LARGEST_LIGHT = 24
#: Most (node, id) rows that are broadcast to pick texts where they are read; beyond it both sides shuffle.
BROADCAST_ROWS = 1 << 19
#: Rounds in which lists are compared with pivots, and kinds of pivots of a round.
PIVOT_ROUNDS, PIVOTS = 3, 3
#: Longs of a set's parity bits.
BIT_WORDS = 8
BITS = [f"b{i}" for i in range(BIT_WORDS)]


def overlap_needed(n: int, m: int, pct: int = THRESHOLD_PCT) -> int:
    return -(-pct * (n + m) // (100 + pct))


def prefix_length(n, pct: int = THRESHOLD_PCT):
    return n - -(-pct * n // 100) + 1


def partner_sizes(n: int, pct: int = THRESHOLD_PCT) -> range:
    return range(-(-pct * n // 100), 100 * n // pct + 1)


def subset_sizes(n: int, most: int, pct: int = THRESHOLD_PCT) -> list[int]:
    """Sizes of the subsets that a set of size n lists for partners of at most ``most``."""
    return sorted({overlap_needed(n, m, pct) for m in partner_sizes(n, pct) if m <= most})


def light_boundary(cost: dict[int, tuple[int, int]], pct: int = THRESHOLD_PCT) -> int:
    """The boundary of least cost. ``cost``: by size, the number of sets and the rows of their prefixes
    and of the lists that these are put in."""

    def total(most: int) -> int:
        """Rows if sets up to ``most`` list subsets; those with larger partners need their prefixes as well."""
        rows = 0
        for n, (sets, lists) in cost.items():
            if n <= most:
                rows += sets * sum(math.comb(n, o) for o in subset_sizes(n, most, pct))
            if n > most or partner_sizes(n, pct)[-1] > most:
                rows += lists
        return rows

    return min(range(LARGEST_LIGHT, -1, -1), key=total)


def _list_costs(sketch, pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for b in batches:
            found = []
            for raw in column(b, "small"):
                s = np.frombuffer(raw.as_py(), dtype="<u8")
                lengths = np.sort(counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)])[: prefix_length(len(s), pct)]
                found.append(int(lengths.sum(dtype=np.int64)) + len(lengths))
            yield pa.record_batch([column(b, "n"), pa.array(found, pa.int64())], names=["n", "rows"])

    return run


def _sets(batch: pa.RecordBatch, text_col: str, words: int) -> Iterator[np.ndarray]:
    vocab, codes, off = split_words(column(batch, text_col), lower=True)
    hashes, start = shingle_hashes(word_hashes(vocab)[codes], off, words)
    for i in range(batch.num_rows):
        yield np.unique(hashes[start[i] : start[i + 1]])


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _parity(s: np.ndarray) -> np.ndarray:
    """512 bits, as eight longs: whether an odd number of the set's hashes falls on each bit."""
    odd = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=64 * BIT_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _pack(s: np.ndarray) -> bytes:
    return s.astype("<u8").tobytes()


def _first_pass(text_col: str, id_col: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, any_rows = np.zeros(SKETCH, dtype=np.uint32), False
        for b in blocks(batches, text_col):
            nodes, sizes, bits, small = [], [], [], []
            seen: set[int] = set()
            for s in _sets(b, text_col, words):
                sizes.append(len(s))
                bits.append(_parity(s))
                nodes.append(node := _node(s) if len(s) else 0)
                small.append(_pack(s) if 0 < len(s) <= LARGEST_LIGHT else None)
                if len(s) and node not in seen:
                    seen.add(node)
                    np.add.at(counts, (s & np.uint64(SKETCH - 1)).astype(np.int64), 1)
                    any_rows = True
            k = len(nodes)
            by_word = np.array(bits, dtype=np.int64).reshape(k, BIT_WORDS)
            yield pa.record_batch(
                [column(b, id_col), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(by_word[:, i]) for i in range(BIT_WORDS)), pa.array(small, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                names=["id", "node", "n", *BITS, "small", "seg", "part", "counts"],
            )
        if any_rows:
            part = TaskContext.get().partitionId()
            rows = SKETCH // SEGMENT
            cut = counts.astype("<u4").reshape(rows, SEGMENT)
            yield pa.record_batch(
                [*(pa.nulls(rows, pa.int64()) for _ in range(3 + BIT_WORDS)), pa.nulls(rows, pa.binary()), pa.array(range(rows), pa.int32()), pa.array([part] * rows, pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())],
                names=["id", "node", "n", *BITS, "small", "seg", "part", "counts"],
            )

    return run


def _entries(text_col: str, words: int, pct: int, boundary: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for b in blocks(batches, text_col):
            elems, nodes, sizes, places = [], [], [], []
            seen: set[int] = set()
            for s in _sets(b, text_col, words):
                n = len(s)
                if not n or (node := _node(s)) in seen:
                    continue
                seen.add(node)
                keys = np.empty(0, dtype=np.uint64)
                place = np.empty(0, dtype=np.int32)
                if n <= boundary:
                    got = [_subset_key(c) for o in subset_sizes(n, boundary, pct) for c in itertools.combinations(s.tolist(), o)]
                    keys = np.array(got, dtype=np.uint64)
                    place = np.full(len(got), -1, dtype=np.int32)
                if partner_sizes(n, pct)[-1] > boundary:
                    rank = counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                    p = prefix_length(n, pct)
                    first = np.lexsort((s, rank))[:p] if p < n else np.lexsort((s, rank))
                    keys = np.concatenate([keys, s[first]])
                    place = np.concatenate([place, np.arange(len(first), dtype=np.int32)])
                elems.append(keys)
                places.append(place)
                nodes.append(np.full(len(keys), node, dtype=np.int64))
                sizes.append(np.full(len(keys), n, dtype=np.int32))
            if elems:
                yield pa.record_batch(
                    [pa.array(np.concatenate(elems).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))],
                    names=["elem", "node", "n", "place"],
                )

    return run


def _subset_key(c: tuple[int, ...]) -> int:
    return int.from_bytes(hashlib.blake2b(np.array(c, dtype="<u8").tobytes(), digest_size=8, person=b"subset").digest(), "little")


def _hashed(text_col: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_col):
            got = list(_sets(b, text_col, words))
            yield pa.record_batch([column(b, "node"), pa.array([_pack(s) for s in got], pa.binary())], names=["node", "hashes"])

    return run


def _verify(pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = column(batch, "ha"), column(batch, "hb")
            linked = np.zeros(batch.num_rows, dtype=bool)
            last, x = None, None
            for i in range(batch.num_rows):
                if (pb := b[i].as_py()) != last:
                    last, x = pb, np.frombuffer(pb, dtype="<u8")
                y = np.frombuffer(a[i].as_py(), dtype="<u8")
                at = np.searchsorted(x, y)
                common = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))
                linked[i] = 100 * common >= pct * (len(x) + len(y) - common)
            yield pa.record_batch([column(batch, "a"), column(batch, "b"), pa.array(linked)], names=["a", "b", "linked"])

    return run


def _possible(pct: int):
    """Size and position filters of entries x and y of one list."""
    need = F.ceil(F.lit(float(pct)) * (F.col("xn") + F.col("yn")) / F.lit(100.0 + pct) - F.lit(1e-9))
    left = F.least(F.col("xn") - F.col("xp"), F.col("yn") - F.col("yp"))
    sizes = F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * pct
    return sizes & ((F.col("xp") < 0) | (F.col("yp") < 0) | (left >= need))


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold_pct: int = THRESHOLD_PCT
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id (the smallest id reachable)."""
    spark = docs.sparkSession
    pct = threshold_pct
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first = materialize(
        rows.mapInArrow(_first_pass("text", "id", words), "id long, node long, n long, " + "".join(f"{c} long, " for c in BITS) + "small binary, seg int, part int, counts binary"), "sets"
    )
    sketch = sum_vectors(first.filter("seg is not null").select("seg", "part", "counts"), SEGMENT, SKETCH // SEGMENT, "<u4").astype(np.uint32)
    members = first.filter("seg is null").select("id", "node", "n")
    order = spark.sparkContext.broadcast(sketch)
    cost = first.filter("small is not null").dropDuplicates(["node"]).select("n", "small").mapInArrow(_list_costs(order, pct), "n long, rows long")
    boundary = light_boundary({r["n"]: (r["sets"], r["rows"]) for r in cost.groupBy("n").agg(F.count("*").alias("sets"), F.sum("rows").alias("rows")).collect()}, pct)

    entry = materialize(rows.mapInArrow(_entries("text", words, pct, boundary, order), "elem long, node long, n int, place int"), "entries")
    shared = entry.groupBy("elem").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("elem")
    lists = materialize(entry.join(shared, "elem", "left_semi").dropDuplicates(["elem", "node"]), "lists")
    discard(entry)

    one = lists.select("elem", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("place").alias("xp"))
    # one row a node, by an aggregation that combines copies before they meet
    nodes = materialize(members.filter("n > 0").groupBy("node").agg(F.min("id").alias("least")), "nodes")
    verify = _Verifier(rows, members, nodes, words, pct)
    for seed in range(PIVOT_ROUNDS):
        rest = verify.apart(one)
        pivot = rest.groupBy("elem").agg(F.min(F.struct(F.xxhash64("x", F.col("elem") % PIVOTS, F.lit(seed)).alias("r"), "x", "xn", "xp", "xc")).alias("p"))
        pivot = pivot.select("elem", F.col("p.x").alias("y"), F.col("p.xn").alias("yn"), F.col("p.xp").alias("yp"), F.col("p.xc").alias("yc"))
        if not verify(rest.join(pivot, "elem").filter((F.col("xc") != F.col("yc")) & _possible(pct))):
            break
        discard(rest)
    parity = first.filter("n > 0").groupBy(F.col("node").alias("x")).agg(*[F.first(c).alias(c) for c in BITS])
    rest = materialize(verify.apart(one).join(parity, "x"), "rest")
    # the smaller of two sets that link has at least pct percent of the other's size: its band or the one below
    band = F.floor(F.log(F.col("xn")) / math.log(100 / pct) + F.lit(1e-9)).cast("int")
    rest = rest.withColumn("band", band)
    other = rest.select("elem", "band", *[F.col(f"x{c}").alias(f"y{c}") for c in "npc"], F.col("x").alias("y"), *[F.col(c).alias(f"y{c}") for c in BITS])
    less = rest.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"y{c}"))) for c in BITS), F.lit(0))
    near = (100 + pct) * apart <= (100 - pct) * (F.col("xn") + F.col("yn"))
    smaller = (F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("x") < F.col("y")))
    verify(less.join(other, ["elem", "band"]).filter(smaller & (F.col("xc") != F.col("yc")) & _possible(pct) & near))
    label = verify.label

    of = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    known = of.join(least, "component").select("node", "component_id")
    return members.join(known, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def _ids_repeat(members: DataFrame) -> bool:
    """Whether an id is null or not unique, and so does not say which text a node has."""
    return bool(members.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1 or id is null").limit(1).count())


class _Verifier:
    """Exact comparison of candidate pairs; keeps what was tried, the links and their components."""

    def __init__(self, rows: DataFrame, members: DataFrame, nodes: DataFrame, words: int, pct: int):
        self.rows, self.nodes, self.words, self.pct = rows, nodes, words, pct
        self.repeated = _ids_repeat(members)
        spark = rows.sparkSession
        self.tried = self.links = spark.createDataFrame([], "a long, b long")
        self.hashes = spark.createDataFrame([], "node long, hashes binary")
        self.label = spark.createDataFrame([], "node long, component long")

    def apart(self, entries: DataFrame) -> DataFrame:
        """Entries, with component ``xc``, of the lists that hold several components."""
        of = entries.join(self.label.select(F.col("node").alias("x"), F.col("component").alias("xc")), "x", "left").withColumn("xc", F.coalesce("xc", "x"))
        lists = of.groupBy("elem").agg(F.min("xc").alias("lo"), F.max("xc").alias("hi")).filter("lo <> hi").select("elem")
        return materialize(of.join(lists, "elem"), "rest")

    def __call__(self, found: DataFrame) -> bool:
        """Verify the pairs of entries; whether any links."""
        pairs = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = materialize(pairs.join(self.tried, ["a", "b"], "left_anti"), "pairs")
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        self.hashes = self.hashes.unionByName(self._hashed(wanted.join(self.hashes, "node", "left_anti")))
        self.tried = self.tried.unionByName(pairs)
        links = materialize(_verified(pairs, self.hashes, self.pct), "links")
        self.links = self.links.unionByName(links)
        linked = bool(links.limit(1).count())
        if linked:
            self.label = components(self.links)
        return linked

    def _hashed(self, wanted: DataFrame) -> DataFrame:
        """(node, hashes) of the wanted nodes, each from one of its documents."""
        if self.repeated:
            made = self.rows.mapInArrow(_hashed_all("text", self.words), "node long, hashes binary")
            return materialize(made.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "hashes")
        source = materialize(self.nodes.join(wanted, "node").select("node", F.col("least").alias("id")), "source")
        n = source.count()
        if not n:
            return self.hashes.limit(0)
        if n <= BROADCAST_ROWS:
            source = F.broadcast(source)
        return materialize(self.rows.join(source, "id").select("node", "text").mapInArrow(_hashed("text", self.words), "node long, hashes binary"), "hashes")


def _hashed_all(text_col: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_col):
            got = [s for s in _sets(b, text_col, words) if len(s)]
            yield pa.record_batch([pa.array([_node(s) for s in got], pa.int64()), pa.array([_pack(s) for s in got], pa.binary())], names=["node", "hashes"])

    return run


def _verified(pairs: DataFrame, hashes: DataFrame, pct: int) -> DataFrame:
    ha = hashes.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    hb = hashes.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(ha, "a").join(hb, "b").select("a", "b", "ha", "hb")
    return both.mapInArrow(_verify(pct), "a long, b long, linked boolean").filter("linked").select("a", "b")

"""Prefix trie of conversations: leaf-peeling message passing over DataFrames.

A conversation is its turns in order (null turn first; equal turns by the MD5 of role and text). It
may be rebuilt before: the first ``h`` turns come from another conversation (``rebuilt``). Each
distinct sequence of first ``d`` turns (role, text) is a node at depth ``d`` below a textless root.

* **Places** in a conversation come from one sort by range, whose tasks count their own rows; what
  earlier tasks hold of a conversation is added from a table of one row a task and conversation. So
  a conversation may span any number of tasks.
* **Node keys** are the exclusive or of 128-bit hashes of (place, role, text) over the turns so far,
  by blocks of ``BLOCK`` turns; the parent's key is a node's own less its last turn's hash.
* **Peeling.** Every node waits for its children; a completed node sends its subtree's totals to its
  parent. Nodes in a row that have the same owner (the member with the smallest hash of its id, which
  is the owner of all nodes from some depth on to its end) are one path and are passed in one
  message: a path counts the paths that hang below it, adds up what they send, and reports to the
  path above when none is left, until only the root's remains. An owner changes along a branch some
  ``ln(members)`` times, so this is the number of rounds, however deep the trie. Every round is
  written to the shared folder. Then each node adds what stands below it on its path, in blocks.
* **Digests** of members' ids are a chain over bytes by nature: ids are sorted by range and joined to
  pieces of ``PIECE`` bytes by all tasks, and a node's pieces then stream through one hash.

Defined cases: a null role or text is empty; a row without a conversation's id belongs to none and is
left out; repeated rows are turns of their own; very long texts are hashed whole; a conversation
without turns after rebuilding is a member of the root alone; an empty table has no node; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import discard, materialize
from ._text import column

#: Turns whose hashes, and nodes of a path whose totals, are added up in one group.
BLOCK = 4096
#: Bytes of joined ids in one row.
PIECE = 8192
#: A conversation takes its head from the one whose id is the next lower multiple; heads are shorter than ``HEADS``.
FAMILY, HEADS = 5, 9


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a turn: c (conversation), place (from 1), m (digest of role and text), bytes (of the text)."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    digest = F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text))
    rows = conversations.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), digest.alias("m"), F.octet_length(text).cast("long").alias("bytes")).filter("c is not null")
    order = ["c", F.asc_nulls_first("t"), "m"]
    # equal rows may fall on either side of a cut: a number of no meaning splits them
    cut = rows.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*order, "any").sortWithinPartitions(*order)
    cut = materialize(cut.select("c", "m", "bytes", F.monotonically_increasing_id().alias("at")), "turns")
    task = F.shiftright("at", 33)
    spans = cut.groupBy("c", task.alias("task")).agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("c", "task", (F.col("lo") - before).alias("zero"))
    return materialize(cut.withColumn("task", task).join(spans, ["c", "task"]).select("c", (F.col("at") - F.col("zero") + 1).alias("place"), "m", "bytes"), "places")


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("long")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations: c, d, m, bytes, n; conversations: c, n turns after rebuilding).

    A conversation c has the first h turns of the conversation ``c - c % FAMILY``, as many as there are, and
    then its own from the one after its h-th.
    """
    sizes = materialize(own.groupBy("c").agg(F.count("*").alias("own")).withColumn("h", head_length(F.col("c"))), "sizes")
    base = sizes.select(F.col("c").alias("b"), F.col("own").alias("of_base"))
    convs = sizes.withColumn("b", F.col("c") - F.col("c") % FAMILY).join(base, "b", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("of_base", F.lit(0))))
    convs = materialize(convs.select("c", "b", "h", "head", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    tails = own.join(convs, "c").filter("place > h").select("c", (F.col("place") - F.col("h") + F.col("head")).alias("d"), "m", "bytes", "n")
    heads = own.filter(F.col("place") < HEADS).withColumnRenamed("c", "b").join(convs, "b").filter("place <= h").select("c", F.col("place").alias("d"), "m", "bytes", "n")
    discard(sizes)
    return heads.unionByName(tails), convs


def _long(hexes: Column, at: int) -> Column:
    return F.conv(F.substring(hexes, at, 16), 16, -10).cast("long")


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the node's key (a, b) after each turn, and the hash (x, y) of the turn at its depth."""
    tag = rows.withColumn("tag", F.md5(F.concat_ws(":", F.col("d").cast("string"), "m"))).drop("m")
    tag = tag.select("*", _long(F.col("tag"), 1).alias("x"), _long(F.col("tag"), 17).alias("y"), F.floor((F.col("d") - 1) / BLOCK).alias("block")).drop("tag")
    upper = tag.filter(F.col("n") > BLOCK).groupBy("c", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"))
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select("c", "block", F.bit_xor("bx").over(earlier).alias("bx"), F.bit_xor("by").over(earlier).alias("by"))
    within = Window.partitionBy("c", "block").orderBy("d")
    run = tag.select("*", F.bit_xor("x").over(within).alias("a"), F.bit_xor("y").over(within).alias("b")).join(upper, ["c", "block"], "left")
    plus = lambda v, w: F.col(v).bitwiseXOR(F.coalesce(w, F.lit(0))).alias(v)
    return run.select("c", "d", "n", "bytes", "x", "y", plus("a", "bx"), plus("b", "by"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a node that follow one another, joined by commas, in pieces; numbered in order."""
    from pyspark import TaskContext

    task, seq = TaskContext.get().partitionId(), 0
    node, held, size = None, [], 0
    out: list[tuple] = []

    def close() -> None:
        nonlocal held, size, seq
        if held:
            out.append((*node, task, seq, ",".join(held)))
            seq += 1
            held, size = [], 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        made = pa.record_batch([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=["d", "a", "b", "task", "seq", "ids"])
        out.clear()
        return made

    for rows in batches:
        for *at, c in zip(*(column(rows, x).to_pylist() for x in "dabc"), strict=True):
            if at != node or size >= PIECE:
                close()
                node = at
            held.append(text := str(c))
            size += len(text) + 1
        if len(out) >= 1000:
            yield batch()
    close()
    if out:
        yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, joined by commas; rows come sorted by node, task and number."""
    node, digest = None, None

    def done(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True))
        return pa.record_batch([*(pa.array(v, pa.int64()) for v in cols[:3]), pa.array(cols[3], pa.string())], names=["d", "a", "b", "ends"])

    for rows in batches:
        found = []
        for *at, ids in zip(*(column(rows, x).to_pylist() for x in ("d", "a", "b", "ids")), strict=True):
            if at == node:
                digest.update(b",")
            else:
                if node:
                    found.append((*node, digest.hexdigest()))
                node, digest = at, hashlib.sha256()
            digest.update(ids.encode())
        if found:
            yield done(found)
    if node:
        yield done([(*node, digest.hexdigest())])


def _ends(last: DataFrame) -> DataFrame:
    """(d, a, b, ends): the digest of the ids of the members that end at a node. ``last``: d, a, b, c."""
    by_id = last.repartitionByRange("d", "a", "b", "c").sortWithinPartitions("d", "a", "b", "c")
    pieces = by_id.mapInArrow(_pieces, "d long, a long, b long, task int, seq long, ids string")
    return pieces.repartition("d", "a", "b").sortWithinPartitions("d", "a", "b", "task", "seq").mapInArrow(_hashed, "d long, a long, b long, ends string")


def _peel(paths: DataFrame) -> DataFrame:
    """What paths send to the nodes they hang from: (owner, d, leaves, saved), in one row a node.

    ``paths``: owner, up and hook (the path above and the depth of the node there, null for the root's path),
    leaves and saved (of the path's own nodes).
    """
    hanging = paths.filter("up is not null").groupBy(F.col("up").alias("owner")).agg(F.count("*").alias("waits"))
    state = materialize(paths.join(hanging, "owner", "left").withColumn("waits", F.coalesce("waits", F.lit(0))), "paths")
    sent = None
    while True:
        complete = state.filter("waits = 0 and up is not null")
        message = materialize(complete.groupBy("up", "hook").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("n")), "messages")
        if not message.limit(1).count():
            discard(message, state)
            break
        sent = message if sent is None else sent.unionByName(message)
        got = message.groupBy(F.col("up").alias("owner")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.sum("n").alias("n"))
        left = state.filter("waits > 0").join(got, "owner", "left")
        add = lambda v, w: F.col(v) + F.coalesce(w, F.lit(0))
        held, state = state, materialize(
            left.select("owner", "up", "hook", add("leaves", "more_leaves").alias("leaves"), add("saved", "more_saved").alias("saved"), (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits")), "paths"
        )
        discard(held)
    if sent is None:
        return paths.limit(0).select("owner", F.col("hook").alias("d"), "leaves", "saved")
    return sent.groupBy(F.col("up").alias("owner"), F.col("hook").alias("d")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _totals(nodes: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Adds n_leaves and saved_tokens of the whole subtree: on a path, what stands at a node or below it."""
    rows = nodes.join(arrivals, ["owner", "d"], "left").withColumn("block", F.floor(F.col("d") / BLOCK))
    rows = rows.withColumns({"leaves": F.coalesce("leaves", F.lit(0)) + F.col("leaf"), "saved": F.coalesce("saved", F.lit(0)) + F.col("own_saved")})
    below = rows.groupBy("owner", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    later = Window.partitionBy("owner").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    below = below.select("owner", "block", F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(later), F.lit(0)).alias("s"))
    within = Window.partitionBy("owner", "block").orderBy(F.desc("d"))
    rows = rows.withColumns({"leaves": F.sum("leaves").over(within), "saved": F.sum("saved").over(within)}).join(below, ["owner", "block"])
    return rows.withColumns({"n_leaves": F.col("leaves") + F.col("l"), "saved_tokens": F.col("saved") + F.col("s")})


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild: bool = True) -> DataFrame:
    """The nodes: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members),
    n_children, n_leaves (of the subtree), saved_tokens (bytes of last texts that all but one member share,
    over the subtree) and ends_sha256 (of the ids that end here, ascending and comma-joined)."""
    own = turns(conversations, conv_col, turn_col, role_col, text_col)
    if rebuild:
        rows, convs = rebuilt(own)
    else:
        convs = own.groupBy("c").agg(F.count("*").alias("n"))
        rows = own.withColumnRenamed("place", "d").join(convs, "c")
    keyed = materialize(_keyed(rows), "prefixes")
    zero = F.lit(0).cast("long")
    owner = F.min(F.struct(F.xxhash64("c").alias("r"), "c")).alias("owner")
    nodes = keyed.groupBy("d", "a", "b").agg(F.min("c").alias("conv"), F.count("*").alias("n_convs"), owner, F.min("x").alias("x"), F.min("y").alias("y"), F.min("bytes").alias("bytes"))
    nodes = nodes.withColumn("owner", F.col("owner.c"))
    top = convs.agg(F.min("c").alias("conv"), F.count("*").alias("n_convs"), owner).filter("n_convs > 0")
    top = top.select(*(zero.alias(x) for x in "dab"), "conv", "n_convs", F.col("owner.c").alias("owner"), *(zero.alias(x) for x in ("x", "y", "bytes")))
    nodes = materialize(nodes.unionByName(top), "nodes")

    up = nodes.filter("d > 0").select("*", (F.col("d") - 1).alias("pd"), F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"))
    children = up.groupBy(F.col("pd").alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("d").alias("pd"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv"), F.col("owner").alias("up"))
    # the root's children know it without a join: they may be most of the nodes
    root = top.select(F.col("conv").alias("parent_conv"), F.col("owner").alias("up"))
    linked = up.filter("pd = 0").join(F.broadcast(root)).unionByName(up.filter("pd > 0").join(above.filter("pd > 0"), ["pd", "pa", "pb"]), allowMissingColumns=True)
    linked = linked.drop("pd", "pa", "pb").unionByName(top, allowMissingColumns=True).join(children, ["d", "a", "b"], "left")
    count = F.coalesce("n_children", F.lit(0))
    linked = linked.select(
        "d", "a", "b", "conv", "owner", "n_convs", "parent_conv", "up", count.alias("n_children"),
        (count == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own_saved"),
    )
    linked = materialize(linked, "trie")
    discard(nodes)

    first = F.min(F.struct("d", "up")).alias("first")  # a path begins below another owner's node
    paths = linked.groupBy("owner").agg(F.sum("leaf").alias("leaves"), F.sum("own_saved").alias("saved"), first)
    paths = paths.select("owner", F.col("first.up").alias("up"), (F.col("first.d") - 1).alias("hook"), "leaves", "saved")
    found = _totals(linked, _peel(paths))

    last = keyed.filter("d = n").select("d", "a", "b", "c").unionByName(convs.filter("n = 0").select(*(zero.alias(x) for x in "dab"), "c"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return found.join(_ends(last), ["d", "a", "b"], "left").select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", nothing).alias("ends_sha256")
    )

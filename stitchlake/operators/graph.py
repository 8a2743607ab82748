"""Match graphs: direction, components, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, written
from . import ordered


def both_ways(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Every row and its mirror image with the named columns exchanged."""
    swap = {a: b for a, b in pairs} | {b: a for a, b in pairs}
    return df.unionByName(df.select(*[F.col(swap.get(c, c)).alias(c) for c in df.columns]))


#: Rows of a block of a group; a task of ``pairs_in_groups`` pairs a few blocks at most.
BLOCK_ROWS = 4096
#: Rows of a piece of a block with smaller keys and of one with larger keys. The latter are repeated for each row of the
#: former: short runs of which columnar files need few bytes. A piece's pairs with a block are held at once.
PIECE_ROWS, RUN_ROWS = 16, 256
#: The most tasks that ``pairs_in_groups`` asks for.
MOST_TASKS = 10_000


def pairs_in_groups(rows: DataFrame, group: str, key: str, block: int = BLOCK_ROWS) -> DataFrame:
    """The pairs of rows of a group whose keys differ, each once: every column as ``a_`` of the smaller key and as
    ``b_`` of the larger one. Rows without a group or a key have none.

    The result is quadratic in a group's size, so no group is joined in one task: a group is cut into blocks of
    ``block`` rows in the order of the key, and each pair of blocks is joined by itself, the rows of both in
    pieces. A row is sent once for each block of its group, and a task holds few blocks, however large the
    group is. Pairs come in runs that repeat each other, so they take few bytes in columnar files."""
    rows = rows.dropna(subset=[group, key])
    at = F.col("rank_") - 1
    dealt = written(ordered.ranks(rows, [group], [key], "rank_").withColumn("block_", F.floor(at / block)), "dealt")
    sizes = dealt.groupBy(group).agg((F.max("block_") + 1).alias("blocks_"))
    n = F.col("blocks_")
    tasks = sizes.agg(F.sum(n * (n + 1) / 2)).first()[0] or 1
    keys, row = [group, "i_", "j_"], F.struct(*[c for c in rows.columns if c != group])

    def side(name: str, piece: int, i, j):
        pieces = dealt.groupBy(group, "block_", F.floor(F.pmod(at, F.lit(block)) / piece).alias("piece_")).agg(F.collect_list(row).alias(name))
        return pieces.join(sizes, group).select(group, i.alias("i_"), j.alias("j_"), name).repartition(min(int(tasks), MOST_TASKS), *keys)

    left = side("x_", PIECE_ROWS, F.col("block_"), F.explode(F.sequence("block_", n - 1)))
    right = side("y_", RUN_ROWS, F.explode(F.sequence(F.lit(0).cast("long"), "block_")), F.col("block_"))
    met = left.join(right.hint("shuffle_hash"), keys).select(group, F.explode("x_").alias("x_"), "y_").select(group, "x_", F.explode("y_").alias("y_"))
    met = met.filter(F.col(f"x_.{key}") < F.col(f"y_.{key}"))
    of = lambda p, c: F.col(group) if c == group else F.col(f"{p}.{c}")
    return met.select(*[of("x_", c).alias(f"a_{c}") for c in rows.columns], *[of("y_", c).alias(f"b_{c}") for c in rows.columns])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of an undirected edge table (a, b); the smallest node names a
    component. Labels take the neighbourhood's minimum and jump to their label's label, so the
    number of rounds grows with the logarithm of the diameter. Every round is a table in the shared folder,
    which goes when the next one is there.
    """
    both = written(both_ways(edges.select("a", "b"), [("a", "b")]).distinct(), "edges")
    held = label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        up = label.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = written(
            label.join(near, "node").join(up, "component", "left").select("node", F.col("component").alias("old"), F.least("component", "near", "root").alias("component")), "labels"
        )
        discard(held)
        held, label = new, new.select("node", "component")
        if not new.filter("old <> component").limit(1).count():
            discard(both)
            return label


def coloured(edges: DataFrame) -> DataFrame:
    """(node, colour) of the nodes of an undirected edge table (a, b): nodes that share an edge differ in colour.
    Luby's rounds: of the nodes without a colour those whose random number (a hash, so repeated tasks agree)
    is the largest among such neighbours take the colour of the round."""
    both = written(both_ways(edges.select("a", "b").filter("a <> b"), [("a", "b")]).distinct(), "edges")
    todo = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    done, colour = None, 0
    links = both
    while todo.limit(1).count():
        # within a colour: rounds until every node has a neighbour of that colour or has it
        free, here = todo, links
        while free.limit(1).count():
            rank = lambda c: F.struct(F.xxhash64(c, F.lit(colour)), F.col(c))  # noqa: E731, B023
            beaten = here.groupBy(F.col("a").alias("node")).agg(F.max(rank("b")).alias("best"))
            chosen = written(free.join(beaten, "node", "left").filter(F.col("best").isNull() | (rank("node") > F.col("best"))).select("node", F.lit(colour).alias("colour")), "colour")
            done = chosen if done is None else done.unionByName(chosen)
            mine = chosen.select("node")
            beside = here.join(mine.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).distinct()
            rest = written(free.join(mine, "node", "left_anti").join(beside, "node", "left_anti"), "free")
            inside = lambda c, of: of.select(F.col("node").alias(c))
            next_links = written(here.join(inside("a", rest), "a", "left_semi").join(inside("b", rest), "b", "left_semi"), "links")
            discard(*([free] if free is not todo else []), *([here] if here is not links else []))
            free, here = rest, next_links
        discard(free, here)
        left = written(todo.join(done.select("node"), "node", "left_anti"), "nodes")
        kept = written(links.join(inside("a", left), "a", "left_semi").join(inside("b", left), "b", "left_semi"), "links")
        discard(todo, *([links] if links is not both else []))
        todo, links, colour = left, kept, colour + 1
    discard(todo, both, links)
    return done if done is not None else todo.select("node", F.lit(0).alias("colour"))

"""Source divergence audit: term frequencies of sources against each other and against their language.

Terms are runs of letters and characters beyond ASCII, A-Z lower-cased. A language keeps the ``V``
terms that stand in at least ``MIN_DOCS`` of its documents. A group (a source of a language, or the
language) gives a kept term that it has ``count`` times ``p = 1 + floor(SCALE (count + 1) / (N + V))``,
N its count over all kept terms; ``f(p, q) = floor((p - q)^2 / q)``. Part ``pair`` sums f over all kept
terms for every two sources of a language; part ``term`` ranks a source's terms that are more frequent
than in the language.

* Tasks count the terms of the texts they read; rows (lang, source, term, count, documents) go to
  **shards by the hash of language and term**, about ``SHARD_ROWS`` each, so a term's rows meet.
* In each shard **DuckDB** adds them up in SQL and drops the terms in too few documents. Spark sums the
  shards' totals (N, V, and how many terms a source has how often).
* In a second pass over the shards DuckDB computes every p and, for each pair of sources, the sum over
  the terms that *both* have of ``f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)``, 0 marking the p of a term
  that is absent; and each source's ``TOP`` terms of the shard. The rest of a pair's sum needs no terms:
  ``f(p, q0)`` and ``f(p0, q)`` depend on a source's counts alone, so Spark takes them from the
  number of terms per count. Nothing is ever made dense.
* Spark merges the partial sums and ranks. The top terms of all are among the top terms of the shards.

Integers are exact throughout: 128 bits in DuckDB, decimals in Spark.

Defined cases: null text, language or source is the empty text, and so groups of their own; a language
without kept terms has pairs of value 0 and no terms; every row is a document, repeated rows and rows
without an id too; a very long text is read whole; ties rank by the item's UTF-8 bytes; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import discard, materialize
from ._text import blocks, column, split_words

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Rows of counts in a shard, about; bounds what a task holds.
SHARD_ROWS = 1 << 19
#: Rows of counts in one batch.
BATCH_ROWS = 400_000
_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")

_COUNTS = "lang string, source string, term string, c long, docs long"
_KEPT = "lang string, source string, term string, c long, n_all long, first long"
_FOUND = "part string, lang string, source string, item string, s decimal(38,0)"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences, and documents, of each term in each group, for the texts of a block."""
    for b in blocks(batches, "text"):
        vocab, codes, off = split_words(column(b, "text"), lower=True)
        found = [_TERM.findall(w) for w in vocab.to_pylist()]
        terms = pa.array([t for f in found for t in f], pa.string()).dictionary_encode()
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        per = sizes[codes]  # a word may hold several terms
        row = np.repeat(np.repeat(np.arange(b.num_rows), np.diff(off)), per)
        within = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        term = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.repeat(begin[codes], per) + within]
        groups: dict[tuple, int] = {}
        names = zip(column(b, "lang").to_pylist(), column(b, "source").to_pylist(), strict=True)
        group = np.array([groups.setdefault(g, len(groups)) for g in names], dtype=np.int64)
        n = max(len(terms.dictionary), 1)
        each, times = np.unique(row * n + term, return_counts=True)  # a document's terms
        key, at = np.unique(group[each // n] * n + each % n, return_inverse=True)
        c = np.bincount(at, weights=times, minlength=len(key)).astype(np.int64)
        docs = np.bincount(at, minlength=len(key)).astype(np.int64)
        langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
        of = pa.array(key // n)
        for i in range(0, len(key), BATCH_ROWS):
            cut = slice(i, i + BATCH_ROWS)
            g = of[cut]
            yield pa.record_batch(
                [langs.take(g), sources.take(g), terms.dictionary.take(pa.array(key[cut] % n)), pa.array(c[cut]), pa.array(docs[cut])],
                names=["lang", "source", "term", "c", "docs"],
            )


def _sql(table: pa.Table, query: str) -> pa.Table:
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": "1GB"}) as db:
        db.register("shard", table)
        return db.sql(query).to_arrow_table()


def _kept(least: int):
    query = f"""
        WITH s AS (SELECT lang, source, term, sum(c) AS c, sum(docs) AS docs FROM shard GROUP BY ALL),
        w AS (SELECT *, sum(docs) OVER t AS in_docs, sum(c) OVER t AS n_all, source = min(source) OVER t AS first FROM s WINDOW t AS (PARTITION BY lang, term))
        SELECT lang, source, term, c::BIGINT AS c, n_all::BIGINT AS n_all, first::BIGINT AS first FROM w WHERE in_docs >= {least}
    """

    def run(shard: pa.Table) -> pa.Table:
        return _sql(shard, query)

    return run


def _found(top: int):
    """Partial sums of pairs, and the shard's top terms; ``part`` tells them apart."""
    p = lambda c, n: f"(1 + {SCALE}::HUGEINT * ({c} + 1) // ({n} + v))::BIGINT"
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q}) // {q})"
    query = f"""
        WITH r AS MATERIALIZED (SELECT lang, source, term, {p("c", "n")} AS p, {p("0", "n")} AS p0, {p("n_all", "n_lang")} AS q FROM shard),
        t AS (SELECT lang, source, term AS item, {f("p", "q")} AS s FROM r WHERE p > q
              QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {f("p", "q")} DESC, term) <= {top}),
        x AS (SELECT a.lang, a.source, b.source AS item, sum({f("a.p", "b.p")} - {f("a.p", "b.p0")} - {f("a.p0", "b.p")} + {f("a.p0", "b.p0")}) AS s
              FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL)
        SELECT 'term' AS part, lang, source, item, s::DECIMAL(38, 0) AS s FROM t
        UNION ALL SELECT 'pair', lang, source, item, s::DECIMAL(38, 0) FROM x
    """

    def run(shard: pa.Table) -> pa.Table:
        return _sql(shard, query)

    return run


def _p(c: str, n: str) -> str:
    """p of a term that stands c times in a group of n, exactly; v > 0."""
    return f"(1L + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({c} + 1 AS DECIMAL(19,0))) div CAST({n} + v AS DECIMAL(19,0)))"


def _f(p: str, q: str, times: str) -> Column:
    return F.expr(f"CAST((({p} - {q}) * ({p} - {q})) div {q} AS DECIMAL(19,0)) * CAST({times} AS DECIMAL(18,0))").cast("decimal(38,0)").alias("s")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value long, rank int, for every source of every language."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = materialize(rows.mapInArrow(_count, _COUNTS), "term-counts")
    shards = max(1, -(-counts.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).alias("shard")
    kept = materialize(counts.groupBy(shard).applyInArrow(_kept(min_docs), _KEPT), "kept-terms")
    discard(counts)

    times = materialize(kept.groupBy("lang", "source", "c").agg(F.count("*").alias("terms"), F.sum("first").alias("first")), "times")
    of_source = times.groupBy("lang", "source").agg(F.sum(F.col("c") * F.col("terms")).alias("n"), F.sum("terms").alias("k"))
    of_lang = times.groupBy("lang").agg(F.sum("first").alias("v"), F.sum(F.col("c") * F.col("terms")).alias("n_lang"))
    groups = rows.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = materialize(groups.select("lang", "source", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n", "k", "v", "n_lang"))), "groups")

    given = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "c", "n_all", "n", "v", "n_lang", shard)
    found = materialize(given.groupBy("shard").applyInArrow(_found(top), _FOUND), "found")
    discard(kept)

    other = groups.select("lang", F.col("source").alias("item"), F.col("n").alias("m"), F.col("k").alias("j"))
    pairs = groups.join(other, "lang").filter("source <> item")
    neither = pairs.select("lang", "source", "item", F.when(F.col("v") > 0, _f(_p("0", "n"), _p("0", "m"), "(v - k - j)")).otherwise(F.lit(0)).cast("decimal(38,0)").alias("s"))
    one = times.join(groups, ["lang", "source"]).join(other, "lang").filter("source <> item")
    mine = one.select("lang", "source", "item", _f(_p("c", "n"), _p("0", "m"), "terms"))
    theirs = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), _f(_p("0", "m"), _p("c", "n"), "terms"))
    both = found.filter("part = 'pair'").drop("part")
    sums = both.unionByName(neither).unionByName(mine).unionByName(theirs).groupBy("lang", "source", "item").agg(F.sum("s").cast("long").alias("value"))

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by).alias("rank")
    terms = found.filter("part = 'term'").select("lang", "source", "item", F.col("s").cast("long").alias("value")).select("*", rank).filter(F.col("rank") <= top)
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(sums.select("*", rank), "pair").unionByName(out(terms, "term"))

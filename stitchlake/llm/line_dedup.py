"""Removal of repeated line runs by winnowing (DataFrame operations only).

A document's sequence holds its lines that have a word (``[^ \\t-\\r]+``); other lines are kept
and never matched. A run is deleted when it has at least ``min_words`` words and the same lines
stand in the same order at an earlier place of the corpus, the same document included; places are
ordered by id, text hash and line number. The longest such runs are taken, so every line of a
later copy goes and the first copy stays.

1. Winnow: each line opens a window, the shortest stretch of lines with ``min_words`` words. The
   smallest line hash in it (the last one on ties) is its fingerprint; windows that overlap mostly
   select the same line, so a document has few distinct fingerprint positions. A shared run of
   ``min_words`` words holds a whole window, so both copies select the same line of it.
2. Join positions: a fingerprint that stands at one position only drops all its windows. The others
   are joined by content with the first place of the same window.
3. Extend both ways from the windows that matched: to the left every window of the run is one of
   them; to the right the match grows line by line, as long as the ``min_words`` words that end with
   the line, and begin with a matched window, stand at an earlier place as well.
4. Lines of later windows and extensions are deleted.

No pairs of copies are made: each window meets only the first place of its content, through an
aggregation with map-side combine and an equi-join against one row a key, which adaptive
execution splits when a key is hot.

Defined cases: null text stays null and takes no part; empty text stays empty; a very long text is
lines as any other; rows that repeat both id and text are one document and are treated alike (ties
between places of equal id and text are none, then); a null id sorts first; an empty table gives an
empty result; extra columns pass through, whatever their names: a row travels as one struct
(``with_counts`` adds the columns ``n_lines`` and ``n_removed`` and replaces columns of these names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_WORDS = 50
WORD = r"[^ \t-\r]+"
_LOWEST = -(2**63)


def _place(prefix: str) -> Column:
    return F.struct("did", "th", F.col(prefix).alias("at"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole rows as one struct ``row``, with their text and the keys (did, th) of their document."""
    text = docs[text_col]
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"), F.coalesce(docs[id_col].cast("long"), F.lit(_LOWEST)).alias("did"), F.xxhash64(text).alias("th")
    )


def line_windows(keyed: DataFrame, min_words: int) -> DataFrame:
    """(did, th, lo, hi, k1, k2, a1, a2, f, at, grown) of every document: its windows, with the hashes
    k1, k2 of their content and the fingerprint f at line ``at``; and, as ``grown``, the stretches of
    ``min_words`` words that end at a line (where they are no window), with the hashes a1, a2 and
    the fingerprint of the window that begins where they do."""
    parts = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h"), F.crc32(x.cast("binary")).alias("c"), F.regexp_count(x, F.lit(WORD)).alias("nw")),
    )
    lines = (
        keyed.filter("text is not null")
        .select("did", "th", F.explode(F.filter(parts, lambda s: s["nw"] > 0)).alias("s"))
        .select("did", "th", "s.pos", "s.h", "s.c", "s.nw")
        .repartition("did", "th")
        .dropDuplicates(["did", "th", "pos"])
    )
    doc = Window.partitionBy("did", "th")
    lines = lines.withColumn("ce", F.sum("nw").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("cb", F.col("ce") - F.col("nw"))
    fw = doc.orderBy("cb").rangeBetween(0, min_words - 1)
    lines = (
        lines.withColumn("total", F.max("ce").over(doc))
        .withColumn("least", F.min(F.struct(F.col("h"), (-F.col("pos")).alias("minus"))).over(fw))
        .withColumn("fhi", F.max("pos").over(fw))
        .withColumn("fk1", F.xxhash64(F.collect_list("h").over(fw)))
        .withColumn("fk2", F.hash(F.collect_list("c").over(fw)))
    )
    bw = doc.orderBy("ce").rangeBetween(-(min_words - 1), 0)
    lines = (
        lines.withColumn("begin", F.first(F.struct("pos", "fk1", "fk2", "fhi", "least")).over(bw))
        .withColumn("bk1", F.xxhash64(F.collect_list("h").over(bw)))
        .withColumn("bk2", F.hash(F.collect_list("c").over(bw)))
    )

    def row(lo, hi, k1, k2, a1, a2, least, grown: bool) -> Column:
        named = dict(lo=lo, hi=hi, k1=k1, k2=k2, a1=a1, a2=a2, f=least["h"], at=-least["minus"], grown=F.lit(grown))
        return F.struct(*[v.alias(k) for k, v in named.items()])

    col, begin = F.col, F.col("begin")
    window = F.when(col("total") - col("cb") >= min_words, row(col("pos"), col("fhi"), col("fk1"), col("fk2"), col("fk1"), col("fk2"), col("least"), False))
    grown = F.when(
        (col("ce") >= min_words) & (col("pos") > begin["fhi"]),
        row(begin["pos"], col("pos"), col("bk1"), col("bk2"), begin["fk1"], begin["fk2"], begin["least"], True),
    )
    return lines.select("did", "th", F.explode(F.array_compact(F.array(window, grown))).alias("w")).select("did", "th", "w.*")


def shared_fingerprints(windows: DataFrame) -> DataFrame:
    """(f): the fingerprints that stand at two positions or more."""
    places = windows.filter("not grown").groupBy("f").agg(F.min(_place("at")).alias("first"), F.max(_place("at")).alias("last"))
    return places.filter(F.col("first") != F.col("last")).select("f")


def repeated_runs(keyed: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(did, th, dead): the line numbers, from 0, that belong to later copies."""
    windows = line_windows(keyed, min_words)
    found = windows.join(shared_fingerprints(windows), "f").drop("f", "at")

    def first(df: DataFrame) -> DataFrame:
        """The first place of each content that has two places or more."""
        places = df.groupBy("k1", "k2").agg(F.min(_place("lo")).alias("first"), F.max(_place("lo")).alias("last"))
        return places.filter(F.col("first") != F.col("last")).select("k1", "k2", "first")

    matched = first(found.filter("not grown"))
    anchored = found.join(matched.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("first").alias("of_window")), ["a1", "a2"])
    later = anchored.filter(~F.col("grown") & (_place("lo") > F.col("of_window")))
    grown = anchored.filter("grown")
    further = grown.join(first(grown), ["k1", "k2"]).filter(_place("lo") > F.col("first"))
    span = [F.col(c) for c in ("did", "th", "lo", "hi")]
    return (
        later.select(*span)
        .unionByName(further.select(*span))
        .groupBy("did", "th")
        .agg(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("lo"), F.col("hi"))))).alias("dead"))
    )


def line_dedup(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", with_counts: bool = False
) -> DataFrame:
    """``docs`` with the later copies of repeated runs deleted from ``text_col``."""
    keyed = _keyed(docs, id_col, text_col)
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dead"))
    clean = F.when(F.col("dead").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    found = keyed.join(repeated_runs(keyed, min_words), ["did", "th"], "left")
    counts = {
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.when(F.col("dead").isNull(), F.lit(0)).otherwise(F.size("dead")).cast("long"),
    }
    added = counts if with_counts else {}
    return found.select(
        *[clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in added],
        *[v.alias(k) for k, v in added.items()],
    )

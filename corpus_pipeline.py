"""From raw documents to packed training sequences, in five stages.

``STAGES`` holds (name, function) pairs; each function takes (spark, docs, sf_dir) and works on
all rows that its predecessor kept. ``run`` writes every stage's result as Parquet into the shared
folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchlake.llm._store import discard, materialize, unused
from stitchlake.llm.decontam import decontaminate
from stitchlake.llm.jaccard_join import jaccard_classes
from stitchlake.llm.language_id import UNKNOWN, held_out, train, with_language
from stitchlake.llm.line_dedup import WORD, line_dedup
from stitchlake.llm.packing import pack

#: A document whose best language has a lower share of the posterior is rejected.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognized language go: no letters (null, empty and blank texts too), or no
    language with half the score. Without labelled rows all go. Very long texts are read whole; of languages
    with equal scores the alphabetically first is taken, with a share of no more than half unless they are one.
    Repeated rows are judged one by one; rows without an id are judged and train as others do."""
    model = train(docs.filter(~held_out("doc_id")))
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    found = with_language(docs, model, names=(lang, score))
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words and more go; a document left without a word goes (a null text
    too). ``n_chars`` follows the text. Very long texts are read whole. Of equal runs the one in the document with
    the smallest id, and there the first, stays. Repeated rows are one document and both stay."""
    clean = line_dedup(docs).filter(F.col("text").rlike(WORD))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of the n-gram Jaccard join the document with the smallest id stays. Rows that share an
    id are one document and stay together; rows without an id stay. Null and empty texts and those without a
    word are near nothing and stay; very long ones are one set of shingles, whole."""
    copy = unused(docs, "copy")
    others = jaccard_classes(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias(copy)).distinct()
    return docs.join(others, docs["doc_id"] == others[copy], "left_anti")


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % of a benchmark item's shingles go; an empty benchmark removes nothing; rows
    without an id stay. Null and empty texts hold nothing and stay; very long ones are searched whole. Repeated rows
    share their text's fate, and a document with several items goes as one with one."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is its end id, a very long one many
    pieces. Repeated rows are packed one by one, each with pieces of its own; documents without an id too."""
    return pack(docs)


STAGES = [
    ("language", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", remove_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Learned languages, tokenizer ids and packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted once the next stage has been written; the last one
    that is read lazily stays. Columns of any name besides those of documents pass through."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

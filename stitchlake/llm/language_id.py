"""Language identification by words first, with backoff to character n-grams.

Words are the maximal runs of letters (Unicode categories L*), lower-cased. Training counts every word of every labelled
training document by language; the model keeps the ``words_per_lang`` most frequent words of each
language with their log frequencies, and, from the distinct words of the corpus, the
``grams_per_lang`` most frequent character n-grams of each length 1 to 4 (words padded with a
blank on both sides). A known word scores its log frequency in each language. An unseen word
walks over its characters; each place takes the longest known n-gram that starts there, falling
back to shorter ones, and the word scores the mean log frequency of these. A document sums its
words; its score is the softmax of the mean, sharpened with the number of words up to
``SHARPEN``.

Counting is one aggregation with partial sums in the workers and in Spark; the model has a fixed
bound (languages x parameters) and is broadcast; prediction reads each text where it lies.

Defined cases: null text, empty text and text without a letter are ``und`` with score 0, and so is
everything if no labelled text was given; a very long text is read whole; ties go to the alphabetically first language; a null id
belongs to no held-out part; repeated rows are counted and answered row by row; empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import materialize
from ._text import blocks, column, give_back, split_words

WORDS_PER_LANG = 20_000
GRAMS_PER_LANG = 20_000
LONGEST = 4
SHARPEN = 10
UNKNOWN = "und"
_RUNS = re.compile(r"[^\W\d_]+")
_SMOOTH = 0.5


def letter_runs(word: str) -> list[str]:
    """Maximal runs of letters (Unicode categories L*); ``[^\\W\\d_]`` alone takes superscripts, fractions,
    circled and Roman numerals too."""
    runs = _RUNS.findall(word)
    if all(map(str.isalpha, runs)):
        return runs
    return [x for r in runs for x in "".join(c if c.isalpha() else " " for c in r).split()]


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "text"):
        vocab, codes, off = split_words(column(b, "text"), lower=False)
        langs = column(b, "lang").dictionary_encode()
        by_word = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(off))
        parts = [letter_runs(w.lower()) for w in vocab.to_pylist()]
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            times = np.bincount(codes[by_word == k], minlength=len(vocab))
            total: Counter[str] = Counter()
            for i in np.flatnonzero(times).tolist():
                for w in parts[i]:
                    total[w] += int(times[i])
            yield pa.record_batch([pa.array([lang] * len(total), pa.string()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "word", "c"])


def _grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter[str]] = {}

    def out():
        for lang, c in held.items():
            yield pa.record_batch([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "c"])
        held.clear()

    for b in batches:
        langs = column(b, "lang").to_pylist()
        for lang, w in zip(langs, column(b, "word").to_pylist(), strict=True):
            c = held.setdefault(lang, Counter())
            p = f" {w} "
            m = len(p)
            for n in range(1, LONGEST + 1):
                c.update([p[i : i + n] for i in range(m - n + 1)])
        if sum(map(len, held.values())) > 500_000:
            yield from out()
    yield from out()


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", words_per_lang: int = WORDS_PER_LANG, grams_per_lang: int = GRAMS_PER_LANG) -> dict:
    """The model from all rows with a label: languages, word and n-gram log frequencies."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    words = materialize(rows.mapInArrow(_count, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c")), "words")
    grams = words.mapInArrow(_count_grams, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))

    def top(df: DataFrame, key: str, by: list[str], most: int) -> DataFrame:
        """The ``most`` largest counts of each group. A histogram of logarithmic classes of counts,
        bounded in size, shows below which class nothing can be among them; only the few rows above
        meet in one task, however many tasks there are."""
        classed = df.withColumn("__k", F.floor(F.log2(F.col("c").cast("double")) * 16))
        larger = Window.partitionBy(*by).orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, -1)
        sizes = classed.groupBy(*by, "__k").agg(F.count("*").alias("__n"))
        wanted = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(larger), F.lit(0))).filter(F.col("__before") < most)
        few = classed.join(F.broadcast(wanted.select(*by, "__k")), [*by, "__k"])
        w = Window.partitionBy(*by).orderBy(F.desc("c"), key)
        return few.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("__k")

    grams = materialize(grams.withColumn("n", F.length("gram")), "gram-counts")
    totals = {r["lang"]: r["c"] for r in words.groupBy("lang").agg(F.sum("c").alias("c")).collect()}
    langs = sorted(totals)
    at = {x: i for i, x in enumerate(langs)}

    def table(found: DataFrame, key: str, whole) -> tuple[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for r in found.toLocalIterator():
            if r[key] not in out:
                out[r[key]] = np.full(len(langs), -1.0)
            out[r[key]][at[r["lang"]]] = r["c"]
        rows = [np.log(np.where(v < 0, _SMOOTH, v + _SMOOTH) / whole(k)) for k, v in out.items()]
        return "\n".join(out), np.array(rows, dtype=np.float32).reshape(len(rows), len(langs))

    size = np.array([totals[x] + _SMOOTH * words_per_lang for x in langs], dtype=np.float64)
    sums: dict[int, np.ndarray] = {n: np.full(len(langs), _SMOOTH * grams_per_lang) for n in range(1, LONGEST + 1)}
    kept = materialize(top(grams, "gram", ["lang", "n"], grams_per_lang), "grams")
    for r in kept.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect():
        sums[r["n"]][at[r["lang"]]] += r["c"]
    model = {"langs": langs, "words": table(top(words, "word", ["lang"], words_per_lang), "word", lambda k: size), "grams": table(kept, "gram", lambda k: sums[len(k)])}
    give_back()  # what the driver held for the tables of counts
    return model


def _lookup(table: tuple[str, np.ndarray]) -> tuple[dict[str, int], np.ndarray]:
    """Row number by key, and the rows; the keys of a model travel as one text."""
    keys, rows = table
    return ({k: i for i, k in enumerate(keys.split("\n"))} if keys else {}), rows


def word_vectors(vocab: list[str], words: tuple[dict[str, int], np.ndarray], grams: tuple[dict[str, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each text word: summed log frequencies of its letter runs in each language, and their number."""
    known, gram = words[0], grams[0]
    n = np.zeros(len(vocab), dtype=np.int64)
    at_known, rows_known, at_unseen, found, lengths = [], [], [], [], []
    for i, w in enumerate(vocab):
        for part in letter_runs(w.lower()):
            n[i] += 1
            k = known.get(part)
            if k is not None:
                at_known.append(i)
                rows_known.append(k)
                continue
            padded, before = f" {part} ", len(found)
            m = len(padded)
            for a in range(m):
                for b in range(min(a + LONGEST, m), a, -1):
                    g = gram.get(padded[a:b])
                    if g is not None:
                        found.append(g)
                        break
            if len(found) > before:
                at_unseen.append(i)
                lengths.append(len(found) - before)
    langs = words[1].shape[1]
    out = np.zeros((len(vocab), langs))
    if at_known:
        rows = words[1][rows_known]
        for k in range(langs):
            out[:, k] += np.bincount(at_known, weights=rows[:, k], minlength=len(vocab))
    if at_unseen:
        size = np.array(lengths)
        mean = np.add.reduceat(grams[1][found], np.cumsum(size) - size, axis=0) / size[:, None]
        for k in range(langs):
            out[:, k] += np.bincount(at_unseen, weights=mean[:, k], minlength=len(vocab))
    return out, n


def _predict(shared, text_col: str, carry: list[str], names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = model["langs"]
        words, grams = _lookup(model["words"]), _lookup(model["grams"])
        for b in blocks(batches, text_col):
            vocab, codes, off = split_words(column(b, text_col), lower=False)
            vectors, parts = word_vectors(vocab.to_pylist(), words, grams)
            doc = np.repeat(np.arange(b.num_rows), np.diff(off))
            n = np.bincount(doc, weights=parts[codes], minlength=b.num_rows)
            total = np.zeros((b.num_rows, len(langs)))
            for k in range(len(langs)):
                total[:, k] = np.bincount(doc, weights=vectors[codes, k], minlength=b.num_rows)
            pred = [UNKNOWN] * b.num_rows
            score = np.zeros(b.num_rows)
            if langs:
                mean = total / np.maximum(n, 1)[:, None] * np.minimum(n, SHARPEN)[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = mean.argmax(axis=1)
                for i in np.flatnonzero(n > 0):
                    pred[i] = langs[best[i]]
                    score[i] = p[i, best[i]]
            rest = [column(b, c) for c in carry]
            yield pa.record_batch([*rest, pa.array(pred, pa.string()), pa.array(score)], names=[*carry, *names])

    return run


def with_language(docs: DataFrame, model: dict, text_col: str = "text", carry: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``carry`` (all if not given) of every row, with the predicted language and its score,
    named ``names``."""
    carry = docs.columns if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in carry]).add(names[0], "string").add(names[1], "double")
    return docs.select(*dict.fromkeys([*carry, text_col])).mapInArrow(_predict(shared, text_col, carry, names), schema)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred, score for every row."""
    return with_language(docs, model, text_col, [id_col]).select(
        id_col, held_out(id_col).alias("held_out"), "lang_pred", "score"
    )


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows that are not held out, predict all rows."""
    return predict(docs, train(docs.filter(~held_out(id_col)), text_col, lang_col), id_col, text_col)

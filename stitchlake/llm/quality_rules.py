"""Quality rules as a bitmask ledger.

Every text is measured once and every rule is evaluated once; the ledger keeps the measurements and
one bit for each rule that fails. A policy is a named, versioned mask over those bits: applying
one, or another version of it, is a bitwise AND on the ledger, and ``ablation`` counts, in one
aggregation over the distinct masks, what each rule of a policy removes alone and what would be
kept without it. Texts are not read again for either.

Words are ``[^ \\t-\\r]+``. Measurements: n_words; word_chars (code points in words); n_symbols
(characters of ``#*$%&|<>``); n_lines (lines with a word), n_dup_lines (those equal to an earlier
line); n_repeat_words (words inside 5-word windows found twice or more in the text, the first
included); n_letters, n_upper (ASCII letters, upper-case ones); n_exclaim; n_alpha_words (words
with a letter); n_echo_words (words equal to the word before them). Whole texts are measured where they are read; nothing is shuffled.

Defined cases: null, empty and blank texts have no words and fail ``few_words``; null ids and
repeated rows are judged row by row; a very long text is measured whole; measures that equal a limit
(ties) do not fail the rule; an empty table gives an empty ledger; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import blocks, column, shingle_hashes, split_words

WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_exclaim", "n_alpha_words", "n_echo_words"]

#: (name, SQL condition of failure); a rule's bit is its place, so rules are only ever appended.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("shouting", "n_letters >= 20 AND 100 * n_upper > 40 * n_letters"),
    ("exclaiming", "100 * n_exclaim > 20 * n_words"),
    ("few_letters", "100 * n_alpha_words < 60 * n_words"),
    ("echoing", "100 * n_echo_words > 20 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Versioned policies; a version is never changed once it has been applied.
POLICIES = {
    "base/1": mask("few_words", "repeated_words"),
    "web/1": mask("few_words", "repeated_words", "symbols", "repeated_lines"),
    "web/2": mask(*BIT),
}
DEFAULT_POLICY = "web/2"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "text"):
        texts = column(b, "text").fill_null("")
        vocab, codes, off = split_words(texts, lower=False)
        k, n_words = b.num_rows, np.diff(off)
        doc = np.repeat(np.arange(k), n_words)

        def total(by_word: pa.Array) -> np.ndarray:
            w = by_word.to_numpy(zero_copy_only=False).astype(np.float64)
            return np.bincount(doc, weights=w[codes], minlength=k).astype(np.int64)

        count = lambda pattern: total(pc.count_substring_regex(vocab, pattern))
        lines, dup_lines = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        for i, text in enumerate(texts.to_pylist()):
            full = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
            lines[i] = len(full)
            dup_lines[i] = len(full) - len(set(full))
        with np.errstate(over="ignore"):
            mixed = (np.arange(len(vocab), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
        grams, start = shingle_hashes(mixed[codes], off, WINDOW, short=False)
        repeat = np.array([_covered(grams[start[i] : start[i + 1]]) for i in range(k)], dtype=np.int64)
        found = {
            "n_words": n_words,
            "word_chars": total(pc.utf8_length(vocab)),
            "n_symbols": count(r"[#*$%&|<>]"),
            "n_lines": lines,
            "n_dup_lines": dup_lines,
            "n_repeat_words": repeat,
            "n_letters": count("[A-Za-z]"),
            "n_upper": count("[A-Z]"),
            "n_exclaim": count("!"),
            "n_echo_words": np.bincount(doc[1:], weights=(codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1]), minlength=k).astype(np.int64),
            "n_alpha_words": total(pc.match_substring_regex(vocab, r"\pL").cast(pa.int8())),
        }
        yield pa.record_batch([column(b, "id"), *(pa.array(found[m], pa.int64()) for m in MEASURES)], names=["id", *MEASURES])


def _covered(grams: np.ndarray) -> int:
    """Words inside windows whose hash is there twice or more."""
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    step = np.zeros(len(grams) + WINDOW, dtype=np.int64)
    step[at] += 1
    step[at + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(step) > 0))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the measurements and ``fail_bits`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    measured = rows.mapInArrow(_measure, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " | ".join(f"IF({condition}, {BIT[name]}L, 0L)" for name, condition in RULES)
    return measured.withColumn("fail_bits", F.expr(bits)).withColumnRenamed("id", id_col)


def passes(policy: str = DEFAULT_POLICY) -> Column:
    """Whether a ledger row meets a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(found: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail it alone, and that would be kept without it."""
    m = POLICIES[policy]
    by_mask = found.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).count()
    rules = [(name, bit) for name, bit in BIT.items() if bit & m]
    sums = [F.sum(F.when(F.col("bits") == 0, F.col("count")).otherwise(0)).alias("kept")]
    for name, bit in rules:
        sums.append(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("count")).otherwise(0)).alias(f"f_{name}"))
        sums.append(F.sum(F.when(F.col("bits") == bit, F.col("count")).otherwise(0)).alias(f"a_{name}"))
    one = by_mask.agg(*sums)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(f"f_{n}", F.lit(0)).alias("failed"), F.coalesce(f"a_{n}", F.lit(0)).alias("failed_alone"), (F.coalesce("kept", F.lit(0)) + F.coalesce(f"a_{n}", F.lit(0))).alias("kept_without")) for n, _ in rules])
    return one.select(F.explode(rows).alias("r")).select("r.*")

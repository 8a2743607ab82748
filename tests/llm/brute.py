"""Plain Python versions of the operators, and a table of odd documents."""

import re
from collections import defaultdict

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))


def words(n, salt):
    return " ".join(f"w{(i * 7919 + salt * 104729) % 5003}" for i in range(n))


def odd_documents():
    """Rows with nulls, empties, repeats, near copies, shared passages and a very long text."""
    passage = words(70, 1)
    base = words(200, 2)
    near = base.split()
    near[100] = "changed"
    rows = [
        (1, base),
        (2, " ".join(near)),
        (3, base),
        (4, f"{words(60, 3)}\n{passage}\n{words(20, 4)}"),
        (5, f"{words(15, 5)}\n\n{passage}\n{words(55, 6)}"),
        (6, None),
        (7, ""),
        (8, " \n\t\n "),
        (9, "One two three"),
        (10, "ONE two three"),
        (11, LONG),
        (12, "tiny\n" * 200),
        (13, "The licence: CC BY-NC 4.0. All rights reserved.\nÉtat général ß <|endoftext|> 'tis O'Neil's... x_y"),
        (14, f"{words(30, 7)}\n{words(25, 8)}\n{words(30, 9)}"),
        (15, f"{words(5, 10)}\n{words(30, 7)}\n{words(25, 8)}\n{words(40, 11)}"),
        (16, "### $$$ %%% ||| &&& *** <<< >>> ### $$$ %%% ||| &&&"),
        (17, "１２３ 45 ... !!"),
    ]
    return [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", None if t is None else len(t)) for i, t in rows]


def with_repeats(rows):
    """Also a row given twice and a row without an id."""
    return [*rows, rows[0], (None, "a text without an id " + words(12, 20), None, None, None)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def jaccard_classes(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def line_dedup(texts, least=50):
    """A line goes if it lies in a run of ``least`` words that stands identically at an earlier place."""
    seqs = {}
    for i, t in sorted(texts.items()):
        seqs[i] = [(n, x, len(WORD.findall(x))) for n, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    first, runs = {}, []
    for i, s in seqs.items():
        for a in range(len(s)):
            total = 0
            for b in range(a, len(s)):
                total += s[b][2]
                if total >= least:
                    key = tuple(x for _, x, _ in s[a : b + 1])
                    runs.append((key, i, a, b))
                    first[key] = min(first.get(key, (i, a)), (i, a))
                    if total - s[a][2] >= least:  # longer runs are unions of such windows
                        break
    dead = defaultdict(set)
    for key, i, a, b in runs:
        if (i, a) > first[key]:
            dead[i] |= {seqs[i][k][0] for k in range(a, b + 1)}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in dead[i]) for i, t in texts.items()}

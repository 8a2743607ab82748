"""License scan by ordered signature rules.

Hundreds of hand-written regular expressions (``license_rules.py``: header blocks, clauses, SPDX
expressions, notices) and the names of license families with their versions. Texts are lower-cased
(A-Z). One combined search for the rules' keywords decides which texts are looked at at all; in
these, a keyword automaton names the keywords that occur and only the rules gated by them run.
Detections are taken in order of priority, then length, then place; one that lies inside the interval
of a detection taken before it is suppressed, so "CC BY-NC 4.0" does not also count as CC BY. Taken
intervals are held in a tree of largest ends, so a text with many notices costs n log n. The score is
the largest confidence of a detection taken, 0 without any.

Base phrases are found apart from the rules: places where their words
(``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) stand consecutively. Their labels always stay.

Whole texts are scanned where they are read; nothing is shuffled.

Defined cases: null text counts as empty; a text without detections has empty labels, score 0 and
null places; a very long text is scanned whole; of detections alike in priority and place (ties) the
alphabetically first label comes first, and one with the same interval is suppressed by it; null ids and
repeated rows are answered row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import blocks, column
from .license_rules import signatures

#: Base phrases (words) and their labels.
BASE = [(("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved")]

_IN = r"[a-z0-9\u0080-\U0010ffff]"
_WORD = re.compile(_IN + "+")
_GAP = r"[^a-z0-9\u0080-\U0010ffff]+"
_S = r"[\s,()\"'*/_-]{1,6}"

#: Families: label, names (regular expressions), versions ("" for none), keywords of which a name holds one.
FAMILIES = [
    ("apache", [r"apache(?:{s}software)?"], ["1.0", "1.1", "2.0", ""], ["apache"]),
    ("mit", [r"mit", r"expat"], [""], ["mit", "expat"]),
    ("bsd", [r"bsd", r"berkeley{s}software{s}distribution"], ["2-clause", "3-clause", "4-clause", ""], ["bsd", "berkeley"]),
    ("gpl", [r"gpl", r"(?:gnu{s})?general{s}public"], ["1", "2", "3", ""], ["gpl", "general"]),
    ("lgpl", [r"lgpl", r"(?:gnu{s})?(?:lesser|library){s}general{s}public"], ["2", "2.1", "3", ""], ["lgpl", "lesser", "library"]),
    ("agpl", [r"agpl", r"(?:gnu{s})?affero{s}general{s}public"], ["1", "3", ""], ["agpl", "affero"]),
    ("gfdl", [r"gfdl", r"(?:gnu{s})?free{s}documentation"], ["1.1", "1.2", "1.3", ""], ["gfdl", "documentation"]),
    ("mpl", [r"mpl", r"mozilla{s}public"], ["1.0", "1.1", "2.0", ""], ["mpl", "mozilla"]),
    ("epl", [r"epl", r"eclipse{s}public"], ["1.0", "2.0", ""], ["epl", "eclipse"]),
    ("cddl", [r"cddl", r"common{s}development{s}and{s}distribution"], ["1.0", "1.1", ""], ["cddl", "development"]),
    ("eupl", [r"eupl", r"european{s}union{s}public"], ["1.1", "1.2", ""], ["eupl", "european"]),
    ("isc", [r"isc"], [""], ["isc"]),
    ("zlib", [r"zlib"], [""], ["zlib"]),
    ("boost", [r"bsl", r"boost{s}software"], ["1.0", ""], ["bsl", "boost"]),
    ("artistic", [r"artistic"], ["1.0", "2.0", ""], ["artistic"]),
    ("unlicense", [r"unlicense", r"the{s}unlicense"], [""], ["unlicense"]),
    ("wtfpl", [r"wtfpl"], ["2", ""], ["wtfpl"]),
    ("cc0", [r"cc0", r"cc{s}zero", r"creative{s}commons{s}zero"], ["1.0", ""], ["cc0", "zero"]),
    ("ofl", [r"ofl", r"open{s}font"], ["1.0", "1.1", ""], ["ofl", "font"]),
    ("odbl", [r"odbl", r"open{s}(?:data{s})?(?:commons{s})?(?:open{s})?database"], ["1.0", ""], ["odbl", "database"]),
]
#: Creative Commons: conditions after "by", and versions.
CC_KINDS = ["", "sa", "nc", "nd", "nc-sa", "nc-nd"]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0", ""]
#: Templates around a family's name N and version V: pattern, confidence.
TEMPLATES = [
    (r"\b(?:licen[sc]ed|released|distributed|available|published){s}(?:under|according{s}to){s}(?:the{s})?(?:terms{s}of{s})?(?:the{s})?N(?:{s}licen[sc]e)?V\b", 1.0),
    (r"\bN{s}licen[sc]eV\b", 0.9),
    (r"\bspdx-license-identifier\s*:\s*NV", 1.0),
]
def _version(v: str) -> str:
    if not v:
        return ""
    number = re.escape(v) + (r"(?:\.0)?" if v.isdigit() else "")
    return r"(?:,?{s}(?:version{s}|v\.?\s?)?|-v?)" + number + r"(?:-only|-or-later|\+)?"


def build_rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, pattern, keyword, confidence), the most specific first."""
    rules = []
    for label, names, versions, keywords in FAMILIES:
        for v in versions:
            full = f"{label}-{v}" if v else label
            for name, keyword in ((n, k) for n in names for k in keywords if k in n):
                for pattern, sure in TEMPLATES:
                    rules.append((30 if v else 20, full, pattern.replace("V", _version(v)).replace("N", name), keyword, sure))
    for kind in CC_KINDS:
        for v in CC_VERSIONS:
            full = "-".join(x for x in ("cc-by", kind, v) if x)
            tail = "".join("{s}" + x for x in kind.split("-") if x)
            rules.append((30 + len(kind) + (2 if v else 0), full, r"\bcc{s}by" + tail + _version(v) + r"\b", "cc", 1.0))
            long = {"sa": "share{s}?alike", "nc": "non{s}?commercial", "nd": "no{s}?deriv(?:ative)?s?"}
            tail = "".join("{s}" + long[x] for x in kind.split("-") if x)
            rules.append((30 + len(kind) + (2 if v else 0), full, r"\bcreative{s}commons{s}attribution" + tail + r"(?:{s}licen[sc]e)?" + _version(v) + r"\b", "creative", 1.0))
            if v:
                rules.append((40 + len(kind), full, r"creativecommons\.org/licenses/by" + ("-" + kind if kind else "") + "/" + re.escape(v), "creativecommons", 1.0))
    rules = [(p, label, pattern.replace("{s}", _S), k, sure) for p, label, pattern, k, sure in rules]
    rules += signatures()
    return sorted(set(rules), key=lambda r: (-r[0], r[1], r[2]))


def _scanner():
    import ahocorasick

    rules = build_rules()
    by_keyword: dict[str, list] = {}
    for p, label, pattern, keyword, sure in rules:
        by_keyword.setdefault(keyword, []).append((p, label, re.compile(pattern), sure))
    words = ahocorasick.Automaton()
    for k in by_keyword:
        words.add_word(k, k)
    words.make_automaton()
    return by_keyword, words


def base_places(text: str) -> tuple[list[int], set[str]]:
    """Start words of all base phrases in lower-cased text, and the labels found."""
    starts = [m.start() for m in _WORD.finditer(text)]
    at, labels = [], set()
    for words, label in BASE:
        pattern = f"(?<!{_IN})" + _GAP.join(words) + f"(?!{_IN})"
        for m in re.finditer(pattern, text):
            at.append(bisect.bisect_left(starts, m.start()))
            labels.add(label)
    return at, labels


def detections(text: str, by_keyword: dict, words) -> list[tuple[int, int, str, float]]:
    """(start, end, label, confidence) after suppression, in order of taking."""
    found = []
    for k in {k for _, k in words.iter(text)}:
        for p, label, rule, sure in by_keyword[k]:
            found += [(-p, m.start() - m.end(), m.start(), m.end(), label, sure) for m in rule.finditer(text)]
    found.sort()
    starts = sorted({f[2] for f in found})
    ends, taken = [0] * (len(starts) + 1), []  # ends: Fenwick tree of the largest end by start
    for _, _, lo, hi, label, sure in found:
        place = i = bisect.bisect_right(starts, lo)
        while i and ends[i] < hi:
            i &= i - 1
        if i:  # an interval taken before begins at or before this one and ends at or after it
            continue
        taken.append((lo, hi, label, sure))
        while place < len(ends):
            ends[place] = max(ends[place], hi)
            place += place & -place
    return taken


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_keyword, words = _scanner()
    keys = sorted({*by_keyword, "general", "rights", "cc"})
    gate = "|".join(map(re.escape, keys))
    for b in blocks(batches, "text"):
        texts = pc.ascii_lower(column(b, "text").fill_null(""))
        k = b.num_rows
        n_words = pc.count_substring_regex(texts, r"[a-z0-9\x{80}-\x{10FFFF}]+").cast(pa.int64())
        hit = np.flatnonzero(pc.match_substring_regex(texts, gate).to_numpy(zero_copy_only=False))
        n_base, score = np.zeros(k, dtype=np.int64), np.zeros(k)
        first, last = [None] * k, [None] * k
        base, labels = [""] * k, [""] * k
        for i in hit.tolist():
            text = texts[i].as_py()
            at, mine = base_places(text)
            if at:
                n_base[i], first[i], last[i] = len(at), min(at), max(at)
                base[i] = ",".join(sorted(mine))
            got = detections(text, by_keyword, words)
            labels[i] = ",".join(sorted(mine | {x[2] for x in got}))
            score[i] = max([1.0 if at else 0.0, *(x[3] for x in got)])
        yield pa.record_batch(
            [column(b, "id"), n_words, pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base), pa.array(labels), pa.array(score)],
            names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        _scan, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    ).withColumnRenamed("id", id_col)

"""SimHash classes, source divergence and the prefix trie against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from stitchlake.llm import prefix_trie as pt
from stitchlake.llm import simhash_dedup as sd
from stitchlake.llm.source_divergence import source_divergence

from . import brute


def plain_fingerprint(text):
    w = brute.WORD.findall(brute.lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(values, radius=2):
    """Smallest member of each value's class."""
    ids, up = sorted(values), {i: i for i in values}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    a = np.array([values[i] for i in ids], dtype=np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= radius):
            x, y = find(i), find(ids[k + 1 + j])
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_on_odd_documents(spark):
    rows = brute.odd_documents()
    df = spark.createDataFrame(brute.with_repeats(rows), brute.SCHEMA)
    prints = {i: plain_fingerprint(t) for i, t, *_ in rows}
    want = {i: (f"{prints[i]:016x}", c) for i, c in linked(prints).items()}
    got = sd.simhash_classes(df).collect()
    assert len(got) == len(rows) + 2 and {r[0]: (r[1], r[2]) for r in got if r[0] is not None} == want
    assert want[6] == want[7] == want[8] == ("0" * 16, 6)
    lone = [r for r in got if r[0] is None]
    assert len(lone) == 1 and lone[0].component_id is None
    assert sd.simhash_classes(df.limit(0)).collect() == []


def test_simhash_reads_long_texts_in_pieces(monkeypatch):
    text = brute.words(3000, 5) + "　\t" + "x" * 500 + "  Ünï\n"
    whole = sd.fingerprint(text)
    monkeypatch.setattr(sd, "PIECE_BYTES", 64)
    assert sd.fingerprint(text) == whole == plain_fingerprint(text)
    assert [sd.fingerprint(t) for t in ("a", "A b", "", None)] == [plain_fingerprint(t) for t in ("a", "a b", "", None)]


@pytest.mark.parametrize("sizes", [{}, {"shard": 60, "leaf": 8, "sample": 1000}, {"shard": 300, "leaf": 20, "sample": 8000}])
def test_links_of_random_and_dense_fingerprints(spark, sizes):
    rng, x = np.random.default_rng(1), [0]
    for b in rng.integers(0, 1 << 63, 200, dtype=np.uint64).tolist():
        for _ in range(int(rng.integers(1, 20))):
            y = b
            for _ in range(int(rng.integers(0, 5))):
                y ^= 1 << int(rng.integers(0, 64))
            x.append(y)
    x = np.unique(np.array(x, dtype=np.uint64))
    found = sd.hamming_links(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long"), **sizes).collect()
    up = {int(v): int(v) for v in x}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in found:
        a, b = r.a & (1 << 64) - 1, r.b & (1 << 64) - 1
        assert (a ^ b).bit_count() <= 2
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert {i: find(i) for i in up} == linked({int(v): int(v) for v in x})


def test_bounds_prune(monkeypatch):
    """Most pairs of random fingerprints are never compared."""
    x = np.random.default_rng(2).integers(0, 1 << 63, 6000, dtype=np.uint64)
    seen = []
    nonzero = np.nonzero
    monkeypatch.setattr(sd.np, "nonzero", lambda m: seen.append(m.size) or nonzero(m))
    assert sd.shard_links(x, np.ones(len(x), dtype=bool)) == []
    assert sum(seen) < len(x) ** 2 / 2


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(brute.lower(text))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= 3}

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(p[s][t], whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            out += [(lang, s, "pair", i, -v, k + 1) for k, (v, _, i) in enumerate(sorted(pair))]
            out += [(lang, s, "term", i, -v, k + 1) for k, (v, _, i) in enumerate(sorted(term)[:200])]
    return sorted(out)


def test_source_divergence_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(" ".join(f"W{chr(97 + i % 26)}é{'x' * (i // 26)}" for i in rng.zipf(1.3, 60) if i < 400), lang, source) for lang in ("en", "de", None) for source in ("a", "b", None, "é") for _ in range(4)]
    rows += [(None, "en", "empty"), ("", None, "z"), ("1 2 _", "xx", "one"), ("only here", "xx", "two"), ("A1b2C3d a1B a", "en", "a"), (brute.LONG, "en", "a"), ("naïve_naïve", "en", "a")] * 2
    rows += [(" ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)), "de", "wide")] * 3
    df = spark.createDataFrame([(i, t, a, b, "clash") for i, (t, a, b) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string")
    got = sorted(map(tuple, source_divergence(df).collect()))
    want = plain_divergence(rows)
    assert got == want
    assert max(r[5] for r in want if r[2] == "term") == 200
    assert source_divergence(df.limit(0)).collect() == []


def test_source_divergence_by_many_shards(spark, monkeypatch):
    from stitchlake.llm import source_divergence as module

    monkeypatch.setattr(module, "SHARD_ROWS", 50)
    rows = [(brute.words(300, i % 5), "en", f"s{i % 3}") for i in range(12)] + [("rare", "en", "s0")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, module.source_divergence(df).collect())) == plain_divergence(rows)


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    full = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(convs.get(c - c % 5, [])[:h] + convs[c][h:])
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not kids[k]
    ends = lambda k, m: hashlib.sha256(",".join(str(c) for c in m if full[c] == k).encode()).hexdigest()
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items())


def odd_conversations():
    say = lambda c, n, salt=0: [(c, t, ["user", "assistant"][t % 2], f"é{t} {salt}") for t in range(n)]
    rows = [x for c in range(40) for x in say(c, c % 12, c % 3)]
    rows += [(7, None, None, None), (7, None, "user", ""), (8, 3, "user", "a tie"), (8, 3, "user", "another"), (None, 1, "user", "nobody's"), (123, 0, "user", brute.LONG)]
    return rows + say(60, 300) + say(61, 250) + say(77, 1)


CONVERSATION = "conv_id long, turn long, role string, text string"


def trie_rows(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


@pytest.mark.parametrize("block", [4096, 7])
def test_prefix_trie_on_odd_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(pt, "BLOCK", block)
    monkeypatch.setattr(pt, "PIECE", 4)
    rows = odd_conversations()
    rows += rows[20:23]  # repeated rows
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], CONVERSATION + ", c long, d long")
    assert trie_rows(pt.prefix_trie(df)) == plain_trie(rows)


def test_prefix_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", "same") for c in range(300) for t in range(4)]
    df = spark.createDataFrame(rows, CONVERSATION)
    got = trie_rows(pt.prefix_trie(df.repartition(13)))
    assert got == plain_trie(rows)
    assert pt.prefix_trie(df.limit(0)).collect() == []

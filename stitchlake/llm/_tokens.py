"""Fast use of a public tokenizer on whole texts.

Where a tokenizer's own steps (normalize, split, merge) never look across white space and lower-case
letters, as those of ``word_bpe_49k.json`` (recognized by these steps in its file; any other tokenizer
encodes whole texts), a text's ids are the ids of its space-separated pieces, and every distinct piece
is encoded once a worker. A
piece that ends in a letter and a tail of ASCII punctuation is the ids of what stands before the tail and
the tail's, and words of Latin letters are remembered in lower case, so a block has far fewer words to
encode than pieces; they are given to the tokenizer's model many at a time. Texts with
``<|``, which may name special tokens, are encoded whole.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces, and ids of them, that a worker remembers before it starts anew; bounds its memory.
REMEMBERED, REMEMBERED_IDS = 600_000, 1 << 25
#: Characters beyond which a piece is cut between digits and encoded part by part.
LONG = 1 << 16
#: Each digit is a token of its own, so a piece may be cut between two of them.
_DIGITS = re.compile(r"(?<=[0-9])(?=[0-9])")
#: Punctuation that can be cut off a piece's end (no apostrophe: the tokenizer has rules for it).
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that normalization leaves as they are but for lower case, letter by letter (not so U+0130), so that the model can merge them.
_LETTER = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]"
_WORD, _ENDS_IN_LETTER = rf"\A{_LETTER}+\z", rf"{_LETTER}[{re.escape(_TAIL)}]*\z"
#: Words that are given to the model at once.
_MERGED = 4096
#: The letters that stand for bytes in the model's vocabulary.
_OTHERS = (b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b))
_BYTES = {b: 256 + i for i, b in enumerate(_OTHERS)}
_SPELLED = np.array([b if b == 32 else _BYTES.get(b, b) for b in range(256)], dtype="<u4")  # blanks stay


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file; it outlives a task."""
    held = sys.modules.setdefault("_stitchlake_worker", types.ModuleType("_stitchlake_worker"))
    if getattr(held, "path", None) != path:
        held.path, held.encoder = path, Encoder(path)
    return held.encoder


#: The steps of a tokenizer whose texts may be cut at blanks.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_blanks(path: str) -> bool:
    """Whether a tokenizer file has the steps that allow texts to be encoded piece by piece."""
    import json

    with open(path, encoding="utf-8") as f:
        steps = json.load(f)
    normal = (steps.get("normalizer") or {}).get("normalizers", [])
    split = (steps.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return bool(
        [x["type"] for x in normal] == _NORMALIZER
        and (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [x["type"] for x in split] == ["Split", "ByteLevel"]
        and split[0]["pattern"] == {"Regex": _SPLIT}
        and not split[1]["add_prefix_space"]
        and steps["model"]["type"] == "BPE"
        and not steps["model"].get("dropout")
        and (suffix := steps["model"].get("end_of_word_suffix"))
        and all(chr(_BYTES.get(b, b)) + suffix in steps["model"]["vocab"] for b in range(256))
        and steps.get("post_processor") is None
        and all(x["content"].startswith("<|") for x in steps["added_tokens"])
    )


def _cut(piece: str) -> Iterator[str]:
    """The piece in parts of some ``LONG`` characters, where digits allow it."""
    at = 0
    while m := _DIGITS.search(piece, at + LONG):
        yield piece[at : m.start()]
        at = m.start()
    yield piece[at:]


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tok = Tokenizer.from_file(path)
        self.by_pieces = cuts_at_blanks(path)
        self.merger = Tokenizer(self.tok.model)  # for words that are normalized and spelled in the model's letters
        self.merger.pre_tokenizer = WhitespaceSplit()
        suffix, vocab = self.tok.model.end_of_word_suffix, self.tok.get_vocab()
        self.ends_word = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.ends_word[[i for x, i in vocab.items() if suffix and x.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}  # piece -> its number; its ids stand between two bounds, in the pool
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.bounds = np.zeros(1 << 10, dtype=np.int64)
        self.n = 1

    @property
    def used(self) -> int:
        return int(self.bounds[self.n])

    def _keep(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember pieces whose ids stand one after another."""
        used, n, k = self.used, len(ids), len(pieces)
        while used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), dtype=np.uint32)])
        while self.n + k >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros(len(self.bounds), dtype=np.int64)])
        self.pool[used : used + n] = ids
        self.bounds[self.n + 1 : self.n + k + 1] = used + np.cumsum(lengths)
        self.known.update(zip(pieces, range(self.n, self.n + k), strict=True))
        self.n += k

    def _places(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        return self.bounds[at], self.bounds[at + 1] - self.bounds[at]

    def _gather(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        before = np.cumsum(length) - length
        total = int(before[-1] + length[-1]) if len(length) else 0
        return self.pool[np.repeat(start - before, length) + np.arange(total)]

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces one after another, how many each has); long pieces are given to the tokenizer in parts."""
        ids: list[int] = []
        sizes: list[int] = []

        def encode(batch: list[str]) -> None:
            for e in self.tok.encode_batch(batch, add_special_tokens=False):
                got = e.ids
                sizes.append(len(got))
                ids.extend(got)

        if max(map(len, pieces), default=0) <= LONG:
            for i in range(0, len(pieces), 20_000):
                encode(pieces[i : i + 20_000])
            return np.array(ids, dtype=np.uint32), np.array(sizes, dtype=np.int64)
        found, lengths = [], []
        for p in pieces:  # few: a block of text holds hardly more than a hundred pieces as long
            for part in _cut(p) if len(p) > LONG else [p]:
                encode([part])
            lengths.append(sum(sizes))
            found.append(np.array(ids, dtype=np.uint32))
            ids.clear()
            sizes.clear()
        return np.concatenate(found), np.array(lengths, dtype=np.int64)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encoded``, for words of ``_LETTER`` in lower case."""
        ids, sizes = [np.empty(0, dtype=np.uint32)], [np.empty(0, dtype=np.int64)]
        for i in range(0, len(words), _MERGED):
            some = words[i : i + _MERGED]
            spelled = _SPELLED[np.frombuffer(" ".join(some).encode(), dtype=np.uint8)].tobytes().decode("utf-32-le")
            got = self.merger.encode_batch_fast([spelled], add_special_tokens=False)[0]
            ids.append(np.array(got.ids, dtype=np.uint32))
            sizes.append(np.diff(np.flatnonzero(self.ends_word[ids[-1]]), prepend=-1))
        return np.concatenate(ids), np.concatenate(sizes)

    def _numbers(self, pieces: pa.Array, words: bool) -> np.ndarray:
        """The numbers of pieces, which may repeat; those not met before are encoded (``words``: words in lower case)."""
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            some = [names[i] for i in new.tolist()]
            self._keep(some, *(self._merged if words else self._encoded)(some))
            at[new] = np.arange(self.n - len(some), self.n)
        return at[coded.indices.to_numpy(zero_copy_only=False)]

    def _block_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each of the distinct pieces starts in them, how many it has)."""
        if len(self.known) > REMEMBERED or self.used > REMEMBERED_IDS:
            self.forget()
        base = pc.if_else(pc.match_substring_regex(pieces, _ENDS_IN_LETTER), pc.utf8_rtrim(pieces, _TAIL), pieces)
        number = np.zeros((len(pieces), 2), dtype=np.int64)  # of what stands before the tail, and of the tail
        word = np.asarray(pc.match_substring_regex(base, _WORD).to_numpy(zero_copy_only=False), dtype=bool)
        for words in (True, False):
            at = np.flatnonzero(word == words)
            some = base.take(pa.array(at))
            number[at, 0] = self._numbers(pc.utf8_lower(some) if words else some, words)
        shorter = pc.less(pc.binary_length(base), pc.binary_length(pieces)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(np.asarray(shorter, dtype=bool))
        whole, before = (x.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist() for x in (pieces, base))
        number[at, 1] = self._numbers(pa.array([p[len(b) :] for p, b in zip(whole, before, strict=True)], pa.string()), False)
        start, n = self.bounds[number], self.bounds[number + 1] - self.bounds[number]
        ids, sizes = self._gather(start.ravel(), n.ravel()), n.sum(axis=1)
        return ids, np.cumsum(sizes) - sizes, sizes

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end`` after it; offsets by text). Null counts as empty."""
        texts = texts.fill_null("")
        if not self.by_pieces:
            got = self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False)
            off = np.cumsum([0, *(len(e.ids) + 1 for e in got)])
            return np.fromiter((i for e in got for i in (*e.ids, end)), dtype=np.uint32, count=int(off[-1])), off
        odd = np.flatnonzero(np.asarray(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False), dtype=bool))
        plain = texts
        if len(odd):
            mask = np.zeros(len(texts), dtype=bool)
            mask[odd] = True
            plain = pc.if_else(pa.array(mask), pa.scalar("", texts.type), texts)
        pieces = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        off = pieces.offsets.to_numpy().astype(np.int64)
        off -= off[0]
        coded = pieces.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        pool, start, sizes = self._block_ids(coded.dictionary)
        n = sizes[codes]
        before = np.zeros(len(codes) + 1, dtype=np.int64)
        np.cumsum(n, out=before[1:])
        place = np.repeat(start[codes] - before[:-1], n)
        place += np.arange(before[-1])
        flat = pool.take(place)
        cut = before[off]
        sizes = np.diff(cut)
        special = {int(i): np.array(self.tok.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, dtype=np.uint32) for i in odd}
        for i, x in special.items():
            sizes[i] = len(x)
        out_off = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=out_off[1:])
        out = np.full(int(out_off[-1]), end, dtype=np.uint32)
        if not special:
            keep = np.ones(len(out), dtype=bool)
            keep[out_off[1:] - 1] = False
            out[keep] = flat
        else:
            for i in range(len(sizes)):
                out[out_off[i] : out_off[i + 1] - 1] = special[i] if i in special else flat[cut[i] : cut[i + 1]]
        return out, out_off

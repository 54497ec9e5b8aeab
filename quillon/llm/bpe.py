"""BPE encoding by speculation and verification, and decoding.

For each batch the words not seen before are split greedily, always taking the
longest vocabulary entry. A greedy split is the true BPE split exactly when
every token is what BPE makes of its own characters and every adjacent pair of
tokens is compatible: no merge with a part of both sides could have come before
the merges inside them. That test walks down the merge tree of both tokens; it
is done for all pairs of the batch at once. Only words with a failing pair go
through exact merging. A word's ids are kept as bytes, so a text is a join of
look-ups, and the number of words kept is bounded.

Supported are word-end-suffix vocabularies with the normaliser and splitter of
the given file. Plain letters of common scripts are normalised and split here;
texts with any other code point use the library's own normaliser and splitter
(not its model), so rare characters follow its Unicode tables. Strings of the
file's added tokens in a text become those tokens, as in the library.

Defined results: a null text is encoded as an empty one (no tokens, empty
decoded text); texts of any length are encoded whole; repeated rows are encoded
alike; of overlapping added tokens the leftmost counts, as in the library; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.llm.common import positional, settled, with_fields

SUFFIX = "</w>"
KEPT_WORDS = 100_000
SHORT = 64
#: code points whose case, composition and class are the same everywhere
PLAIN = regex.compile("[\u0000-ʯΆ-ϿЀ-ҁҊ-ԯ‐-‧‰-⁞₠-₿぀-ゖァ-ヺ一-龥가-힣]*")
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = "'s|'t|'re|'ve|'m|'ll|'d|"
SPLIT_ASCII = re.compile(f"{_CUT}[a-z]+|[0-9]|[^{_SPACE}a-z0-9]+")
#: within PLAIN the only numbers beside 0-9 are these six
SPLIT = re.compile(rf"{_CUT}[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:_|[^{_SPACE}\w])+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class Merges:
    """Vocabulary, merge tree and the pair test of one tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.text = text
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.longest = max(len(t.removesuffix(SUFFIX)) for t in self.vocab)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        n = max(self.vocab.values()) + 1
        self.rank = np.zeros(n, np.int64)  # 0: a base symbol
        self.left, self.right = np.arange(n), np.arange(n)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs, 1):
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if (i, j) in self.merge:
                continue
            self.merge[i, j] = (r, k)
            if self.rank[k] == 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        self.fast = {i << 32 | j: r << 32 | k for (i, j), (r, k) in self.merge.items()}
        keys = np.array([(i << 32) | j for i, j in self.merge], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.sound = np.ones(n, bool)
        for t, i in self.vocab.items():
            if self.rank[i]:
                self.sound[i] = self.exact(t.removesuffix(SUFFIX), t.endswith(SUFFIX)) == [i]

    def symbols(self, word: str, ends: bool) -> list[int]:
        v = self.vocab
        return [v[c] for c in word[:-1]] + [v[word[-1] + (SUFFIX if ends else "")]]

    def exact(self, word: str, ends: bool = True) -> list[int]:
        """Merge the pair of least rank, leftmost first, until none is left."""
        ids = self.symbols(word, ends)
        n = len(ids)
        if n <= SHORT:
            get, none = self.fast.get, 1 << 62
            pairs = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
            while pairs and (least := min(pairs)) != none:
                i = pairs.index(least)
                ids[i] = least & 0xFFFFFFFF
                del ids[i + 1], pairs[i]
                if i:
                    pairs[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
                if i < len(pairs):
                    pairs[i] = get(ids[i] << 32 | ids[i + 1], none)
            return ids
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := self.merge.get((made, ids[k])):
                    heapq.heappush(heap, (m[0], i, made, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := self.merge.get((ids[h], made))):
                heapq.heappush(heap, (m[0], h, ids[h], made, m[1]))
        return [i for i in ids if i >= 0]

    def greedy(self, word: str) -> list[int]:
        """Longest vocabulary entry first."""
        out, at, n, get = [], 0, len(word), self.vocab.get
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                i = get(word[at:to] if to < n else word[at:] + SUFFIX)
                if i is not None:
                    break
            out.append(i)
            at = to
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or a rank above all."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of adjacent tokens BPE leaves apart.

        Undo the later of the two tokens' last merges step by step: just before
        it, its nearer half touched the other token, and a merge of the two of
        lower rank (or of equal rank further left) would have come first.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        good = self.sound[a] & self.sound[b]
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.flatnonzero(good)
        while len(live):
            x, y = a[live], b[live]
            clash = self.pair_rank(x, y) < limit[live]
            good[live[clash]] = False
            live, x, y = live[~clash], x[~clash], y[~clash]
            rx, ry = self.rank[x], self.rank[y]
            done = (rx == 0) & (ry == 0)
            live, x, y, rx, ry = live[~done], x[~done], y[~done], rx[~done], ry[~done]
            undo_left = rx > ry
            # the pair lies right of merges in a and left of merges in b: on a tie of ranks the left one is first
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return good

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each byte-level word."""
        guess = [self.greedy(w) for w in words]
        size = np.array([len(g) for g in guess], np.int64)
        flat = np.array([i for g in guess for i in g], np.int64)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), size)
            inside = owner[1:] == owner[:-1]
            pair = (flat[:-1][inside] << 32) | flat[1:][inside]
            distinct, back = np.unique(pair, return_inverse=True)
            good = self.compatible(distinct >> 32, distinct & 0xFFFFFFFF)[back]
            wrong = set(owner[:-1][inside][~good].tolist())
        else:
            wrong = set()
        wrong |= set(np.repeat(np.arange(len(words)), size)[~self.sound[flat]].tolist())
        self.failed = getattr(self, "failed", 0) + len(wrong)
        for w in wrong:
            guess[w] = self.exact(words[w])
        return guess


class Coder:
    """Encodes texts; keeps a bounded number of words."""

    def __init__(self, merges: Merges):
        self.merges, self.ids, self.decoded = merges, {}, {}
        self.cut = regex.compile("|".join(regex.escape(a) for a in sorted(merges.added, key=len, reverse=True))) if merges.added else None
        self.table = byte_alphabet()
        self.library = None

    def pieces(self, text: str) -> list[str | int]:
        """Words of a text (ids for added tokens), in order."""
        if self.cut and self.cut.search(text):
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += self.plain(text[at : m.start()])
                out.append(self.merges.added[m[0]])
                at = m.end()
            return out + self.plain(text[at:])
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            return SPLIT_ASCII.findall(text.lower())
        if PLAIN.fullmatch(text):
            text = unicodedata.normalize("NFC", text)
            return SPLIT.findall(text.replace("Σ", "σ").lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.merges.text)
        unlevel = {ord(c): b for b, c in self.table.items()}
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(unlevel[ord(c)] for c in w).decode("utf-8", "surrogateescape") for w, _ in split]

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """Little-endian 32-bit ids and the decoded text of each."""
        split = [self.pieces(t) if t else [] for t in texts]
        used = set().union(*split)
        if len(self.ids) + len(used) > KEPT_WORDS:  # keep what this batch uses again
            self.ids = {w: self.ids[w] for w in used if w in self.ids}
            self.decoded = {w: self.decoded[w] for w in self.ids}
        new = used - self.ids.keys()
        fresh = [w for w in new if isinstance(w, str)]
        level = [w.encode("utf-8", "surrogateescape").decode("latin-1").translate(self.table) for w in fresh]
        name = self.merges.names.__getitem__
        for w, ids in zip(fresh, self.merges.words(level)):
            self.ids[w], self.decoded[w] = array("I", ids).tobytes(), " ".join(map(name, ids))
        for i in new:
            if isinstance(i, int):
                self.ids[i], self.decoded[i] = array("I", [i]).tobytes(), name(i)
        ids = [b"".join(map(self.ids.__getitem__, words)) for words in split]
        return ids, [" ".join(map(self.decoded.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def load(path: str) -> Merges:
    with open(path, encoding="utf-8") as f:
        return Merges(f.read())


def encode(docs: DataFrame, text: str, path: str, batch_chars: int = 1_000_000) -> DataFrame:
    """docs with ``ids`` (little-endian unsigned 32-bit) and ``decoded``; no shuffle.

    Input columns of these two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    at = docs.columns.index(text)
    plain, _, back = positional(docs)

    def run(batches):
        coder = Coder(shared.value)
        for batch in batches:
            column, start = batch.column(at), 0
            while start < len(column):
                texts, size = [], 0
                while start + len(texts) < len(column) and (not texts or size < batch_chars):
                    texts.append(column[start + len(texts)].as_py())
                    size += len(texts[-1] or "")
                ids, decoded = coder.encode(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[*batch.schema.names, "ids", "decoded"])
                start += len(texts)

    return back(plain.mapInArrow(settled(run), with_fields(plain.schema, ("ids", T.BinaryType()), ("decoded", T.StringType()))), "ids", "decoded")

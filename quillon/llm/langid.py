"""Language identification with bit-sliced Bloom filters over character n-grams.

Training keeps, for every language, the n-grams whose share of that language's
n-grams of the same order reaches ``min_share``: at most ``1 / min_share`` of
them per order, whatever the corpus. All languages share one array of machine
words, in which bit *l* of a word belongs to language *l*'s filter. A look-up
ANDs ``probes`` words and so returns the languages that contain an n-gram, all
at once. A text's hits per language (population counts of one bit position) are
corrected for false positives with the filter's measured fill rate; the largest
corrected count decides.

Defined results: a text that is null or has no letter gives ``und`` and 0.0; a
text with letters but no known n-gram gives the language with most training
documents and 0.0; ties go to the language with more training documents, then
to the smaller name; with no labelled training row every text gives ``und``.
The model is fitted on at most ``sample_docs`` whole documents per language,
chosen by a hash of the id; prediction covers every row and whole texts, and
repeated rows alike; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import positional, with_fields
from quillon.llm.words import mix

ORDERS = (2, 3, 4)
_U = np.uint64
_fold: np.ndarray | None = None
_mark: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point to lower-case letter, or to itself for a combining mark, or 32 for what is neither."""
    global _fold, _mark
    if _fold is None:
        table = np.full(0x110000, 32, dtype=np.uint32)
        _mark = np.zeros(0x110000, dtype=bool)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            _mark[c] = unicodedata.category(ch) in ("Mn", "Mc")
            if ch.isalpha() or _mark[c]:
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def grams(texts: list[str | None], orders: tuple[int, ...]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per order (gram hashes, row of each); and which rows have a letter.

    Letters and their marks keep their place, runs of other characters become
    one space; marks alone are no letter.
    """
    joined = "".join(f" {t} " if t else "  " for t in texts)
    lengths = np.array([(len(t) if t else 0) + 2 for t in texts], dtype=np.int64)
    code = fold_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    space = code == 32
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))
    code, row = code[keep].astype(np.uint64), row[keep]
    lettered = np.zeros(len(texts), dtype=bool)
    lettered[row[(code != 32) & ~_mark[code]]] = True
    found = []
    for n in orders:
        m = len(code) - n + 1
        if m <= 0:
            found.append((np.zeros(0, np.uint64), np.zeros(0, np.int32)))
            continue
        packed = np.zeros(m, np.uint64)
        for j in range(n):
            packed = (packed << _U(16)) ^ code[j : j + m]
        inside = (row[:m] == row[n - 1 :]) & ~((code[:m] == 32) & (code[n - 1 :] == 32) & (n == 2))
        found.append((mix(packed[inside], n), row[:m][inside]))
    return found, lettered


@dataclass
class BitSlicedBloom:
    """Filters of up to 64 languages for each of ``planes`` word planes."""

    languages: list[str]
    docs: list[int]
    slots: np.ndarray
    probes: int
    false_rate: np.ndarray

    @staticmethod
    def build(languages: list[str], docs: list[int], hashes: list[np.ndarray], bits_per_gram: int = 12, probes: int = 4) -> BitSlicedBloom:
        most = max((len(h) for h in hashes), default=0)
        size = 1 << max(10, int(np.ceil(np.log2(max(1, most * bits_per_gram)))))
        slots = np.zeros((-(-max(1, len(languages)) // 64), size), dtype=np.uint64)
        model = BitSlicedBloom(languages, docs, slots, probes, np.zeros(len(languages)))
        for i, h in enumerate(hashes):
            for p in range(probes):
                np.bitwise_or.at(slots[i // 64], model._slot(h, p), _U(1) << _U(i % 64))
            fill = np.count_nonzero(slots[i // 64] & (_U(1) << _U(i % 64))) / size
            model.false_rate[i] = fill**probes
        return model

    def _slot(self, h: np.ndarray, p: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h + _U(p) * ((h >> _U(32)) | _U(1))) & _U(self.slots.shape[1] - 1)).astype(np.int64)

    def containing(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of the languages that contain it, one row per plane."""
        found = np.full((self.slots.shape[0], len(h)), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for p in range(self.probes):
            found &= self.slots[:, self._slot(h, p)]
        return found

    def decide(self, texts: list[str | None], orders: tuple[int, ...]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        found, lettered = grams(texts, orders)
        total = np.zeros((len(self.languages), len(texts)))
        for h, row in found:
            if not len(h) or not self.languages:
                continue
            mask = self.containing(h)
            n = np.bincount(row, minlength=len(texts))
            for i, rate in enumerate(self.false_rate):
                bit = ((mask[i // 64] >> _U(i % 64)) & _U(1)).astype(bool)
                hits = np.bincount(row[bit], minlength=len(texts))
                total[i] += np.maximum(0.0, hits - n * rate) / (1.0 - min(rate, 0.999))
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        order = sorted(range(len(self.languages)), key=lambda i: (-self.docs[i], self.languages[i]))
        total = total[order]
        best = np.argmax(total, axis=0)
        top = total[best, np.arange(len(texts))]
        # the share of the best language's lead among all corrected hits, 0 to 1
        score = np.where(top > 0, top / np.maximum(total.sum(axis=0), 1e-9), 0.0)
        names = [self.languages[order[b]] if ok else "und" for b, ok in zip(best, lettered)]
        return names, np.where(lettered, np.clip(score, 0.0, 1.0), 0.0)


_COUNTS = T.StructType([T.StructField("language", T.StringType()), T.StructField("gram_order", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def _count_grams(orders: tuple[int, ...]):
    def run(batches):
        for batch in batches:
            names = batch.column(1).to_pylist()
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 256):
                found, _ = grams(texts[at : at + 256], orders)
                part = np.array(names[at : at + 256], dtype=object)
                for name in sorted(set(part)):
                    mine = part == name
                    for n, (h, row) in zip(orders, found):
                        g, c = np.unique(h[mine[row]], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(np.full(len(g), n, np.int32)), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], names=_COUNTS.names)

    return run


def fit(docs: DataFrame, text: str, language: str, doc_id: str, train: Column, *, sample_docs: int = 1000, min_share: float = 2e-5, orders: tuple[int, ...] = ORDERS) -> BitSlicedBloom:
    """Learn the filters from rows where ``train`` holds and the language is not null.

    ``sample_docs`` bounds the expected number of documents taken per language;
    ``1 / min_share`` bounds the n-grams kept per language and order, and with
    them what the driver holds.
    """
    usable = docs.filter(train & F.col(language).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(language).count().collect()}
    if not counts:
        return BitSlicedBloom.build([], [], [])
    share = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / v)))])
    picked = usable.filter(F.pmod(F.xxhash64(F.lit(17), doc_id), F.lit(1 << 20)) < share[F.col(language)] * (1 << 20))
    rows = picked.select(F.col(text), F.col(language)).mapInArrow(_count_grams(orders), _COUNTS).groupBy("language", "gram_order", "gram").agg(F.sum("n").alias("n"))
    total = rows.groupBy("language", "gram_order").agg(F.sum("n").alias("total"))
    kept = rows.join(F.broadcast(total), ["language", "gram_order"]).filter(F.col("n") >= F.col("total") * min_share)
    got = kept.select("language", "gram").toArrow()
    names = np.array(got.column(0).to_pylist(), dtype=object)
    hashes = got.column(1).to_numpy().view(np.uint64)
    languages = sorted(counts)
    return BitSlicedBloom.build(languages, [counts[x] for x in languages], [hashes[names == x] for x in languages])


def identify(docs: DataFrame, text: str, model: BitSlicedBloom, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """docs with ``lang_pred`` and ``score`` (input columns of these names are replaced); one narrow pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    plain, _, back = positional(docs)

    def run(batches):
        for batch in batches:
            names, scores = [], []
            column = batch.column(at)
            start = 0
            while start < len(column):
                texts, size = [], 0
                while start < len(column) and (not texts or size < 200_000):
                    texts.append(column[start].as_py())
                    size += len(texts[-1] or "")
                    start += 1
                got, score = shared.value.decide(texts, orders)
                names += got
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, "lang_pred", "score"])

    return back(plain.mapInArrow(run, with_fields(plain.schema, ("lang_pred", T.StringType()), ("score", T.DoubleType()))), "lang_pred", "score")

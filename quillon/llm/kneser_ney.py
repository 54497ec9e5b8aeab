"""Quality classifier: interpolated modified Kneser-Ney models of trusted text.

Two models make one probability. The word model predicts each of the
``VOCABULARY`` most frequent words, one symbol for all others, and the text's
end from up to ``WORD_ORDER - 1`` words before, across word edges and sentences.
For a word outside the vocabulary the letter model adds its spelling: it
predicts the characters of a word from up to ``ORDER - 1`` preceding ones, with
a mark for the word's start and end; characters outside the ``ALPHABET`` most
frequent ones share one symbol. Counts are made by map tasks and summed by
n-gram. Each order's counts are joined with the totals and discount masses of
their contexts and with the probabilities of the next lower order; all these
are joins and sums keyed by n-gram or context, so every shard holds a slice of
the keys. Orders below the highest use continuation counts (distinct left
neighbours), except for n-grams at a word's or text's start.

A document's perplexity is 10 to the power of minus its mean log10 probability
per character. A document is kept if its perplexity is at most its
language's threshold: the ``quantile`` of the perplexities of trusted documents
in that language times ``slack``. Languages with fewer than ``least_docs``
such documents use the quantile over all languages. These are the trusted
documents of a quarter that the models aren't fitted on (chosen by a hash of
the id), however few they are; without any there is no threshold.

The models are fitted on all trusted documents of the other three quarters,
whole texts. Their ``HEAD`` most frequent n-grams and contexts are looked up in a
table that every task holds; the others stay where they are. As a text's log
probability is a sum, what an n-gram adds to the next lower order's estimate can
be added later: a filter of all keys rules out what no model has, a document
lists those of the rest that the head lacks, and these are joined at their keys. Scores
are those of the whole tables; quantiles and verdicts cover all documents.

A few insults hardly move a document's mean, so labelled toxic documents, where
given, add evidence by word. A word's evidence is the log ratio of the shares
of toxic and of trusted documents that hold it, a document's that of its
strongest word. Words are learned on all labelled documents of three quarters, if at least three toxic ones
hold them and their likelihood ratio rules out chance; the limit is the
``quantile`` of the evidence of the trusted documents in the last quarter.

Defined results: a null text or one without words has no perplexity (null) and
is not kept; a null language uses the overall threshold; without trusted
documents every document with words is kept; repeated rows are judged one by
one, each alike; ties in frequency go by the character or the word's hash; an
empty table gives no rows. Input columns may have any names; one called like a
result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import Scratch, positional, rows_per_batch, settled, table, with_fields
from quillon.llm.words import Words, chunks, mix, scan_words

ORDER = 5
WORD_ORDER = 3
BITS = 12
ALPHABET = 4000  # with the marks it fits BITS
VOCABULARY = 4000
OTHER, START, END, FIRST = 1, 2, 3, 4
LEARN = 3  # of four parts of the labelled documents
HEAD = 1 << 21  # n-grams and contexts of a model that tasks hold; the others are joined
FILTER = 1 << 27  # bits of the filter of all keys, three for each key in one word of 64
FILTER_BLOCK = 4096  # words of the filter that are summed together
SPELLINGS = 1 << 18  # words whose spelling a task remembers
FEW_ROWS = 2_000_000  # rows of one or two numbers that are broadcast; beyond it Spark chooses
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[i for i in range(128) if not chr(i).isalpha()]] = 32
_GRAMS = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("c", T.LongType())])


def codes_of(words: list[str], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words, each with start and end; and the word of each symbol."""
    return spelled(" ".join(words), len(words), index)


def spelled(text: str, n: int, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The same of n words with a blank between each two."""
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = point == 32
    table = np.full(max(map(ord, index), default=0) + 2, OTHER, np.int16)
    table[[ord(c) for c in index]] = list(index.values())
    size = np.diff(np.flatnonzero(blank), prepend=-1, append=len(point)) + 1
    last = np.cumsum(size) - 1
    code = np.zeros(int(last[-1]) + 1, np.int64)
    code[last], code[last - size + 1] = END, START
    code[code == 0] = table[np.minimum(point[~blank], len(table) - 1)]
    return code, np.repeat(np.arange(n), size)


def text_of_words(c: Words, at: np.ndarray) -> str:
    """The words with these numbers, with a blank between each two."""
    starts, size = c.starts[at], c.ends()[at] - c.starts[at] + 1
    if not len(at):
        return ""
    last = np.cumsum(size) - 1
    raw = c.raw[np.minimum(np.arange(last[-1] + 1) + np.repeat(starts - (last - size + 1), size), len(c.raw) - 1)]
    raw[last] = 32
    return raw[:-1].tobytes().decode("utf-8", "replace")


def windows(code: np.ndarray, word: np.ndarray, order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length n the packed n-grams that end at each symbol, 0 where the word is shorter."""
    out, packed = [], code.copy()
    out.append((np.arange(len(code)), packed))
    for n in range(2, order + 1):
        m = len(code) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        gram = np.zeros(m, np.int64)
        for j in range(n):
            gram = (gram << BITS) | code[j : j + m]
        at = np.flatnonzero(word[:m] == word[n - 1 :])
        out.append((at + n - 1, gram[at]))
    return out


def _count(index: dict[str, int]):
    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(0), chunk_bytes=2 << 20):
                _, one, times = np.unique(c.hashes, return_index=True, return_counts=True)
                code, word = spelled(text_of_words(c, one), len(one), index)
                for n, (at, gram) in enumerate(windows(code, word), 1):
                    keep = gram != START if n == 1 else np.ones(len(gram), bool)
                    g, back = np.unique(gram[keep], return_inverse=True)
                    found = np.bincount(back, weights=times[word[at[keep]]], minlength=len(g)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), n, np.int32)), pa.array(g), pa.array(found)], names=_GRAMS.names)

    return run


def _count_sequences(known: np.ndarray, code: np.ndarray):
    """N-grams of the words of whole texts."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(0)):
                symbol, text = sequences(c, known, code)
                for n, (at, gram) in enumerate(windows(symbol, text, WORD_ORDER), 1):
                    g, times = np.unique(gram[gram != START] if n == 1 else gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), n, np.int32)), pa.array(g), pa.array(times.astype(np.int64))], names=_GRAMS.names)

    return run


def sequences(c: Words, known: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a chunk's texts, each with start and end, and the text of each symbol; texts without words have none."""
    size = np.diff(c.doc_at)
    used = np.flatnonzero(size)
    n = size[used] + 2
    text = np.repeat(used, n)
    symbol = np.full(len(text), START, np.int64)
    first = np.cumsum(n) - n
    symbol[first + n - 1] = END
    inner = np.ones(len(text), bool)
    inner[first] = inner[first + n - 1] = False
    found, value = _look(known, code, c.hashes)
    symbol[inner] = np.where(found, value, OTHER)
    return symbol, text


def _words(batches):
    """Words by their hash, with how often they occur."""
    for batch in batches:
        for c in chunks(batch.column(0)):
            w, n = np.unique(c.hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def _characters(batches):
    for batch in batches:
        for c in chunks(batch.column(0), chunk_bytes=2 << 20):
            point = np.frombuffer(c.raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
            n = np.bincount(point)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([chr(p) for p in at], pa.string()), pa.array(n[at].astype(np.int64))], names=["ch", "n"])


def _masks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key's word of the filter and its bits in it."""
    h, one = mix(key.view(np.uint64)), np.uint64(1)
    bit = lambda shift: one << ((h >> np.uint64(shift)) & np.uint64(63))
    return ((h >> np.uint64(32)) % np.uint64(FILTER // 64)).astype(np.int64), (bit(0) | bit(6) | bit(12)).view(np.int64)


_FILTERED = "block int, at binary, mask binary"


def _filter_part(batches):
    """The filter of a task's keys: of each block the words that aren't 0."""
    words = np.zeros(FILTER // 64, np.int64)
    for batch in batches:
        np.bitwise_or.at(words, *_masks(batch.column(0).to_numpy()))
    for start in range(0, len(words), FILTER_BLOCK):
        block = words[start : start + FILTER_BLOCK]
        at = np.flatnonzero(block)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([start // FILTER_BLOCK], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([block[at].tobytes()], pa.binary())], names=["block", "at", "mask"])


def _or_blocks(words: dict[int, np.ndarray], batch: pa.RecordBatch) -> None:
    for b, at, mask in zip(*(batch.column(i).to_pylist() for i in range(3))):
        if b not in words:
            words[b] = np.zeros(FILTER_BLOCK, np.int64)
        words[b][np.frombuffer(at, np.uint16)] |= np.frombuffer(mask, np.int64)


def _filter_sum(batches):
    """Blocks of several tasks as one."""
    words: dict[int, np.ndarray] = {}
    for batch in batches:
        _or_blocks(words, batch)
    for b, block in words.items():
        at = np.flatnonzero(block)
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([block[at].tobytes()], pa.binary())], names=["block", "at", "mask"])


def key_filter(keys: DataFrame, scratch: Scratch) -> np.ndarray:
    """Bits of the keys in the one column; FILTER of them, whatever the number of keys."""
    got = scratch.table(keys.mapInArrow(settled(_filter_part), _FILTERED).repartition("block").mapInArrow(settled(_filter_sum), _FILTERED), "filter").toArrow()
    scratch.drop("filter")
    scratch.sweep(1)
    blocks: dict[int, np.ndarray] = {}
    for batch in got.to_batches():
        _or_blocks(blocks, batch)
    words = np.zeros(FILTER // 64, np.int64)
    for b, block in blocks.items():
        words[b * FILTER_BLOCK : b * FILTER_BLOCK + FILTER_BLOCK] = block[: len(words) - b * FILTER_BLOCK]
    return words


class Asked:
    """Keys that aren't in the heads but may be in the models, with the text or word that asks for each."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.owners, self.keys = bits, [], []

    def may(self, gram: np.ndarray, kind: int) -> np.ndarray:
        """Places of what the filter doesn't rule out."""
        at, mask = _masks(gram | np.int64(kind << 60))
        return np.flatnonzero(self.bits[at] & mask == mask)

    def add(self, owner: np.ndarray, gram: np.ndarray, kind: int) -> None:
        self.owners.append(owner)
        self.keys.append(gram | np.int64(kind << 60))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.owners, self.keys)]
        self.owners, self.keys = [], []
        return tuple(out)


@dataclass
class Model:
    """Sorted n-grams with log10 probabilities, contexts with log10 back-off weights, by order."""

    index: dict[str, int]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float
    kind: int = 0  # key of an n-gram beyond the head: itself and this kind, of a context the next one
    rest: DataFrame | None = None  # (key, weight) of n-grams and contexts beyond the head
    keys: DataFrame | None = None  # keys of all

    def score(self, words: list[str], asked: Asked | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, predicted symbols) of each word."""
        return self.spell(" ".join(words), len(words), asked)

    def spell(self, text: str, n: int, asked: Asked | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same of n words with a blank between each two."""
        code, word = spelled(text, n, self.index)
        counts = np.bincount(word, minlength=n) - 1  # but the start
        return np.bincount(word, weights=self.each(code, word, asked), minlength=n), counts

    def each(self, code: np.ndarray, word: np.ndarray, asked: Asked | None = None) -> np.ndarray:
        """log10 probability of each symbol, 0 for a start; ``word`` tells which symbols belong together.

        ``asked`` collects what isn't in the head: the weights of the keys among
        them that there are have to be added.
        """
        total = np.zeros(len(code))
        open_ = code != START
        order = len(self.grams)
        grams = windows(code, word, order)
        for n in range(order, 0, -1):
            at, gram = grams[n - 1]
            want = open_[at]
            at, gram = at[want], gram[want]
            hit, value = _find(self.grams[n - 1], self.logp[n - 1], gram, word[at], self.kind, asked)
            total[at[hit]] += value
            open_[at[hit]] = False
            if n > 1:
                rest = np.ones(len(at), bool)
                rest[hit] = False
                at, context = at[rest], gram[rest] >> BITS
                hit, weight = _find(self.contexts[n - 1], self.backoff[n - 1], context, word[at], self.kind + 1, asked)
                total[at[hit]] += weight
        total[open_] += self.floor
        return total


@dataclass
class Sequence:
    """The word model: its n-grams, and the vocabulary as sorted hashes with their symbols."""

    orders: Model
    known: np.ndarray
    code: np.ndarray

    def score(self, c: Words, asked: Asked | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of each text's words and end, which words are outside the vocabulary)."""
        symbol, text = sequences(c, self.known, self.code)
        total = np.bincount(text, weights=self.orders.each(symbol, text, asked), minlength=c.last - c.first)
        return total, symbol[(symbol != START) & (symbol != END)] == OTHER


class Spellings:
    """What a letter model that is all in the head gave for the words that a task has met, the last SPELLINGS or fewer."""

    def __init__(self, model: Model, bits: np.ndarray | None):
        self.model, self.bits = model, bits
        self.forget()

    def forget(self) -> None:
        self.words, self.p, self.n = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)

    def score(self, c: Words, word: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, predicted symbols) of words by their sorted hashes and a place of each."""
        met, at = np.zeros(len(word), bool), np.zeros(len(word), np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            met = self.words[at] == word
        p, n, new = np.zeros(len(word)), np.zeros(len(word), np.int64), np.flatnonzero(~met)
        p[met], n[met] = self.p[at[met]], self.n[at[met]]
        p[new], n[new] = self.model.spell(text_of_words(c, one[new]), len(new), None if self.bits is None else Asked(self.bits))  # which only spares searches
        if len(self.words) + len(new) > SPELLINGS:
            self.forget()
        if len(new) <= SPELLINGS:
            every = np.concatenate([self.words, word[new]])
            order = np.argsort(every, kind="stable")
            self.words, self.p, self.n = every[order], np.concatenate([self.p, p[new]])[order], np.concatenate([self.n, n[new]])[order]
        return p, n


def _find(keys: np.ndarray, values: np.ndarray, want: np.ndarray, owner: np.ndarray, kind: int, asked: Asked | None) -> tuple[np.ndarray, np.ndarray]:
    """(places of what the head has, its values); what the filter allows and the head lacks is asked for."""
    may = np.arange(len(want)) if asked is None else asked.may(want, kind)
    found, value = _look(keys, values, want[may])
    if asked is not None:
        lacks = may[~found]
        asked.add(owner[lacks], want[lacks], kind)
    return may[found], value[found]


def _look(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(want), bool), np.zeros(len(want))
    if len(keys) > 1 << 17:  # in order it takes a fifth of the time
        order = np.argsort(want)
        at = np.empty(len(want), np.int64)
        at[order] = np.searchsorted(keys, want[order])
    else:
        at = np.searchsorted(keys, want)
    at = np.minimum(at, len(keys) - 1)
    return keys[at] == want, values[at]


def train(texts: DataFrame, scratch: Scratch | None = None) -> Model:
    """Fit the letter model on a table of one text column."""
    chars = texts.mapInArrow(_characters, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ch").limit(ALPHABET)
    index = {r[0]: i for i, r in enumerate(chars.collect(), FIRST) if not r[0].isspace()}
    model = _orders(texts.mapInArrow(settled(_count(index)), _GRAMS), len(index) + 2, ORDER, 0, scratch)  # the alphabet, the shared symbol and the end
    model.index = index
    return model


def train_words(texts: DataFrame, scratch: Scratch | None = None) -> Sequence:
    """Fit the word model on a table of one text column; words that occur once are outside its vocabulary."""
    top = texts.mapInArrow(_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "word").limit(VOCABULARY).toArrow()
    known = top.column(0).to_numpy().view(np.uint64)
    sort = np.argsort(known)
    known, code = known[sort], (np.arange(len(known)) + FIRST)[sort]
    return Sequence(_orders(texts.mapInArrow(settled(_count_sequences(known, code)), _GRAMS), len(known) + 2, WORD_ORDER, 2, scratch), known, code)


def _orders(counted: DataFrame, size: int, order_: int, kind: int, scratch: Scratch | None) -> Model:
    """Probabilities and back-off weights of all orders from n-gram counts; ``size`` symbols can be predicted."""
    scratch = scratch or Scratch(counted.sparkSession)
    raw = scratch.table(counted.groupBy("n", "gram").agg(F.sum("c").alias("c")), "grams")
    lower: DataFrame | None = None
    model = Model({}, [], [], [], [], float(np.log10(1.0 / size)), kind)
    parts: list[DataFrame] = []
    for n in range(1, order_ + 1):
        mine = raw.filter(F.col("n") == n).select("gram", "c", F.col("c").alias("times"))
        if n < order_:
            left = raw.filter(F.col("n") == n + 1).groupBy(F.expr(f"gram & {(1 << BITS * n) - 1}L").alias("gram")).agg(F.count(F.lit(1)).alias("k"))
            mine = mine.join(left, "gram", "left")
            begins = F.expr(f"shiftright(gram, {BITS * (n - 1)}) = {START}")
            mine = mine.select("gram", F.when(begins, F.col("c")).otherwise(F.coalesce("k", F.col("c"))).alias("c"), "times")
        freq = {r[0]: r[1] for r in mine.filter("c <= 4").groupBy("c").count().collect()}
        n1, n2, n3, n4 = (freq.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [min(i - 0.01, max(0.01, i - (i + 1) * y * b / a)) if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        mine = mine.withColumn("ctx", F.shiftright("gram", BITS)).withColumn("cut", cut)
        ctx = mine.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("cut").alias("mass")).select("ctx", "total", (F.col("mass") / F.col("total")).alias("gamma"))
        mine = mine.join(ctx, "ctx").withColumn("suffix", F.expr(f"gram & {(1 << BITS * (n - 1)) - 1}L"))
        base = F.lit(1.0 / size) if lower is None else F.coalesce("lp", F.lit(1.0 / size))
        if lower is not None:
            mine = mine.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("lp")), "suffix", "left")
        p = (F.col("c") - F.col("cut")) / F.col("total") + F.col("gamma") * base
        lower = scratch.table(mine.select("gram", "ctx", "times", p.alias("p"), base.alias("base"), "gamma"), f"order{n}")
        # what the n-gram adds to the estimate without it
        parts.append(lower.select(F.lit(n).alias("n"), F.lit(0).alias("c"), "gram", "times", F.log10("p").alias("value"), (F.log10("p") - F.log10("base") - F.log10("gamma")).alias("weight")))
        back = lower.groupBy("ctx").agg(F.sum("times").alias("times"), F.log10(F.max("gamma")).alias("value"))
        if n > 1:
            parts.append(back.select(F.lit(n).alias("n"), F.lit(1).alias("c"), F.col("ctx").alias("gram"), "times", "value", F.col("value").alias("weight")))
        elif (first := back.select("value").first()) is not None:
            model.floor += first[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    scratch.sweep(1)  # the last order's shuffles are the largest
    every = scratch.table(every.select("n", "c", "gram", F.col("value").cast("float").alias("value"), "weight", F.floor(8 * F.log2("times")).cast("int").alias("heat")), "features")
    scratch.drop("grams", *(f"order{n}" for n in range(1, order_ + 1)))  # all is in this one table
    key = F.expr(f"gram | if(c = 1, {kind + 1 << 60}L, {kind << 60}L)").alias("key")
    model.keys = every.select(key)
    hist = sorted(((r[0], r[1]) for r in every.groupBy("heat").count().collect()), reverse=True)  # eight for each power of two
    held = np.cumsum([c for _, c in hist])
    least = hist[fits - 1][0] if (fits := int(np.searchsorted(held, HEAD, "right"))) else 1 << 30
    if fits < len(hist):
        model.rest = every.filter(F.col("heat") < least).select(key, "weight")
    got = every.filter(F.col("heat") >= least).select(F.expr("gram | if(c = 1, shiftleft(1L, 60), 0L)"), "value").toArrow()
    gram, value = (got.column(i).to_numpy() for i in range(2))
    is_context, gram = gram >> 60, gram & ((1 << 60) - 1)
    order = is_context + sum((gram >> BITS * i > 0).astype(np.int8) for i in range(order_))  # no symbol is 0
    for n in range(1, order_ + 1):
        for c, keys, values in ((0, model.grams, model.logp), (1, model.contexts, model.backoff)):
            at = np.flatnonzero((order == n) & (is_context == c))
            at = at[np.argsort(gram[at])]
            keys.append(gram[at])
            values.append(value[at])
    return model


def _plain_words(c: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of a chunk, folded and without ASCII signs and digits."""
    hashes, _, doc_at = scan_words(_LETTERS[c.raw], c.offsets, True)
    return hashes, np.repeat(np.arange(c.first, c.last), np.diff(doc_at))


def _holders(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a column and the rows that hold each."""
    found = []
    for c in chunks(column):
        hashes, row = _plain_words(c)
        order = np.lexsort((row, hashes))
        w, r = hashes[order], row[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
        found.append(w[new])
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)


_HELD = "word long, n long"


def _held(batches):
    """Documents by word."""
    for batch in batches:
        w, n = _holders(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def learn_words(toxic: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of telling words and their evidence, from two tables of one text column; only those words are collected."""
    n_toxic, n_trusted = toxic.count(), trusted.count()
    if not n_toxic or not n_trusted:
        return np.zeros(0, np.uint64), np.zeros(0)
    often = toxic.mapInArrow(settled(_held), _HELD).groupBy("word").agg(F.sum("n").alias("k")).filter("k >= 3")
    words = often.join(trusted.mapInArrow(settled(_held), _HELD).groupBy("word").agg(F.sum("n").alias("g")), "word", "left").fillna(0, ["g"])
    k, g = F.col("k"), F.col("g")
    evidence = F.log(k / n_toxic) - F.log((g + 0.5) / (n_trusted + 1))
    # Dunning's log likelihood ratio of the two shares, so that chance alone lists hardly a word
    both = (k + g) / (n_toxic + n_trusted)
    fit = lambda x, n, p: x * F.log(F.greatest(p, F.lit(1e-300))) + (n - x) * F.log(F.greatest(1 - p, F.lit(1e-300)))
    surprise = 2 * (fit(k, n_toxic, k / n_toxic) + fit(g, n_trusted, g / n_trusted) - fit(k, n_toxic, both) - fit(g, n_trusted, both))
    got = words.select("word", evidence.alias("evidence"), surprise.alias("surprise")).filter("evidence > 1 and surprise > 12").toArrow()
    word = got.column(0).to_numpy().view(np.uint64)
    order = np.argsort(word)
    return word[order], got.column(1).to_numpy()[order]


JUDGED = ("log10_prob", "n_symbols", "perplexity", "threshold", "kept")
SCORES = (("log10_prob", T.DoubleType()), ("n_symbols", T.LongType()), ("evidence", T.DoubleType()))


def score(docs: DataFrame, text: str, model: Model, telling: tuple[np.ndarray, np.ndarray] | None = None, sequence: Sequence | None = None, bits: np.ndarray | None = None, sent: list | None = None) -> DataFrame:
    """docs with ``log10_prob``, ``n_symbols`` and ``evidence``; each distinct word of a batch is spelled once.

    Without ``sequence`` every word counts with its spelling alone. With ``bits``
    (``key_filter`` of the models' ``keys``) there is a column ``asked`` as well:
    keys whose weights, if they have any, have to be added to ``log10_prob``.
    ``sent`` gets the broadcast of the models, to be destroyed when the result is stored.
    """
    letters_asked = model.rest is not None
    listed, weight = telling or (np.zeros(0, np.uint64), np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast((replace(model, rest=None, keys=None), sequence and replace(sequence, orders=replace(sequence.orders, rest=None, keys=None)), bits))
    if sent is not None:
        sent.append(shared)
    added = SCORES if bits is None else (*SCORES, ("asked", T.ArrayType(T.LongType())))
    at = docs.columns.index(text)
    plain, _, back_to = positional(docs)

    def run(batches):
        spelling, order, bits = shared.value
        before = Spellings(spelling, bits)
        for batch in batches:
            owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            logp, count, strongest = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for c in chunks(batch.column(at), chunk_bytes=2 << 20):
                word, one, back = np.unique(c.hashes, return_index=True, return_inverse=True)
                asked = None if bits is None else Asked(bits)
                # a model that is all in the head asks for nothing
                p, n = spelling.spell(text_of_words(c, one), len(one), asked) if asked and letters_asked else before.score(c, word, one)
                by_word = asked and asked.take()
                both = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[c.doc_at])
                if len(one):
                    count[c.first : c.last] = both(n[back])
                    outside = np.ones(len(back), bool)
                    if order is None:
                        logp[c.first : c.last] = both(p[back])
                    else:
                        placed, outside = order.score(c, asked)
                        logp[c.first : c.last] = placed + both(np.where(outside, p[back], 0.0))
                    if asked:
                        text, key = asked.take()
                        row, by_text = _spread(by_word, back, outside, np.repeat(np.arange(c.last - c.first), np.diff(c.doc_at)), len(one))
                        owners += [c.first + text, c.first + row]
                        keys += [key, by_text]
                if len(listed):
                    hashes, row = _plain_words(c)
                    found, value = _look(listed, weight, hashes)
                    np.maximum.at(strongest, row[found], value[found])
            found = [pa.array(logp), pa.array(count), pa.array(strongest)]
            if len(added) > len(SCORES):
                owner, key = np.concatenate(owners), np.concatenate(keys)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))])
                found.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(key[np.argsort(owner, kind="stable")])))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *(f for f, _ in added)])

    return back_to(plain.mapInArrow(settled(run), with_fields(plain.schema, *added)), *(f for f, _ in added))


def _spread(by_word: tuple[np.ndarray, np.ndarray], word: np.ndarray, outside: np.ndarray, row: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the keys that distinct words ask for, for each place in a row at which such a word is spelled."""
    owner, key = by_word
    key = key[np.argsort(owner, kind="stable")]
    n = np.bincount(owner, minlength=n_words)
    at = np.flatnonzero(outside & (n[word] > 0))
    times, first = n[word[at]], (np.cumsum(n) - n)[word[at]]
    inner = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(row[at], times), key[np.repeat(first, times) + inner]


def judge(docs: DataFrame, trusted: DataFrame, *, doc_id: str = "doc_id", text: str = "text", language: str = "lang", carry: list[str] | None = None, quantile: float = 0.99, slack: float = 1.15, least_docs: int = 30, toxic: DataFrame | None = None) -> DataFrame:
    """docs (or ``carry``) with ``log10_prob``, ``perplexity``, ``threshold`` and ``kept``.

    ``trusted`` and ``toxic`` hold the ids of such documents in their first columns.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in JUDGED]
    part = F.pmod(F.xxhash64(F.lit(11), "_t"), F.lit(4))
    text_of = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_x"))

    def ids_of(some: DataFrame) -> DataFrame:
        return some.select(F.col(some.columns[0]).alias("_t")).filter("_t is not null").distinct()

    def learned(ids: DataFrame) -> DataFrame:
        """The texts that may be learned from."""
        mine = ids.filter(part < LEARN)
        return text_of.join(F.broadcast(mine) if mine.count() <= FEW_ROWS else mine, F.col("_d") == F.col("_t"), "left_semi").select("_x")

    ids = ids_of(trusted)
    telling = None
    with rows_per_batch(spark, 1000):
        good_texts = scratch.table(learned(ids), "trusted")
        model, sequence = train(good_texts, scratch), train_words(good_texts, scratch)
        if toxic is not None:
            telling = learn_words(scratch.table(learned(ids_of(toxic)), "toxic"), good_texts)
        scratch.drop("trusted", "toxic")
        rests = [r for r in (model.rest, sequence.orders.rest) if r is not None]
        rest = rests[0].union(rests[-1]) if len(rests) > 1 else rests[0] if rests else None
        bits = None if rest is None else key_filter(model.keys.union(sequence.orders.keys), scratch)
    key = [F.col(doc_id).alias("_d"), F.col(language).alias("_l")]

    def with_rest(scored: DataFrame) -> DataFrame:
        """log10_prob with the weights that the documents ask for."""
        more = scored.select("_row", F.explode("asked").alias("key")).join(rest, "key").groupBy("_row").agg(F.sum("weight").alias("_more"))
        more = table(more, "more").withColumnRenamed("_row", "_r")
        if more.count() <= FEW_ROWS:  # else texts that are carried move
            more = F.broadcast(more)
        return scored.join(more, F.col("_row") == F.col("_r"), "left").withColumn("log10_prob", F.col("log10_prob") + F.coalesce("_more", F.lit(0.0))).drop("_row", "asked", "_r", "_more")

    kept_columns = [F.col(c).alias(f"c_{c}") for c in carry]
    sent: list = []
    row = [] if rest is None else [F.monotonically_increasing_id().alias("_row")]
    with rows_per_batch(spark, 1000):
        # texts, if carried, are stored once rather than scored twice
        scored = table(score(docs.select(*row, *kept_columns, *key, F.col(text).alias("_x")), "_x", model, telling, sequence, bits, sent).drop("_x"), "scored")
    for models in sent:  # each executor has them on its disk
        models.destroy()
    if rest is not None:
        scored = with_rest(scored)
    scored = scored.withColumn("perplexity", F.when(F.col("n_symbols") > 0, F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_symbols"))))
    good = scored.select("_d", "_l", "perplexity", "evidence").filter("perplexity is not null").join(ids, F.col("_d") == F.col("_t")).withColumn("_fresh", part >= LEARN)
    fresh = F.when(F.col("_fresh"), F.col("perplexity"))
    cut: Column = F.percentile_approx(fresh, quantile, 2000)
    whole, most = good.agg((cut * slack).alias("t"), F.percentile_approx(F.when(F.col("_fresh"), F.col("evidence")), quantile, 2000)).first()
    per = good.groupBy("_l").agg((cut * slack).alias("_limit"), F.count(fresh).alias("_n")).filter(F.col("_n") >= least_docs).select(F.col("_l").alias("_g"), "_limit")
    per = table(per, "limits")  # one row per language
    scratch.clear()
    if per.count() <= 10_000:
        per = F.broadcast(per)
    joined = scored.join(per, F.col("_l") == F.col("_g"), "left")
    limit = F.coalesce("_limit", F.lit(whole if whole is not None else float("inf")).cast("double"))
    return joined.select(*[F.col(f"c_{c}").alias(c) for c in carry], "log10_prob", "n_symbols", "perplexity", limit.alias("threshold"), F.coalesce((F.col("perplexity") <= limit) & (F.col("evidence") <= F.lit(most if most is not None else float("inf"))), F.lit(False)).alias("kept"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that are labelled good and not toxic."""
    return labels.filter("quality = 1 and toxic = 0").select("doc_id")


def toxic_ids(labels: DataFrame) -> DataFrame:
    """Ids that are labelled toxic."""
    return labels.filter("toxic = 1").select("doc_id")

"""Language-model scoring with a gated recurrent network in numpy.

The network is a GRU over word tokens. Its output is factored: a softmax over
classes of words of similar frequency, then one over the words of the class. It
is trained by truncated back-propagation: windows of ``WINDOW`` steps, with the
state carried from window to window and cleared where a document begins. Words
outside the vocabulary share one entry, under which a word's share is the mean of
two: its discounted corpus count, where the mass so freed goes to a byte 4-gram
model's spelling, and its count plus one, where all unseen words are one type, as
in the unigram base. The first is a proper distribution over words of any bytes;
the second gives every unseen word the same share, whatever their number, so
that scores can be held against the base's. The network's distribution is mixed
with the tokens' corpus frequencies; the weight is fitted on documents kept from
training. Scoring runs all documents of a batch side by side, longest
first, window by window with the state carried, so a text of any length is
scored whole.

What the model knows of the corpus comes from all training documents: one pass
counts words, and the spellings of distinct words, map-side; the vocabulary and
the head list are the most frequent words (both bounded), every other word's
count stays in a table that the documents' words are joined with at the word's
key. No word of that table is more frequent than the least of the head list.

The network starts on at most ``sample_docs`` expected documents on the driver,
of which a tenth is held back: epochs go on while those gain. Then all other
training documents (``share`` of them) refine it where they are: every task
trains a copy on each ``GROUP_DOCS`` documents of its part, and the copies'
weights are averaged by tokens, block by block, at the block's key. The average
is taken if the held-back documents gain. The first documents are chosen by a
hash of the id. All are read whole. Words are identified by 64-bit hashes.

Defined results: a null or empty text is its end token alone; a null id counts
as training; repeated rows are scored one by one, each with the same result;
ties in frequency go by the word's hash; without training documents the network
is untrained and the unigram counts are 0; an empty table gives no rows. Columns
other than id and text aren't read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import remainder, rows_per_batch, settled, table, with_fields
from quillon.llm.words import FOLD, chunks

HIDDEN = 32
CLASSES = 64
PER_CLASS = 64
WINDOW = 24
HEAD = 1 << 16
STREAMS = 1024
SHARE = 1.0
GROUP_DOCS = 6000
GROUP_TOKENS = 2_000_000
GROUP_STREAMS = 512
BLOCK = 8192
SPELLINGS = 1 << 20
LOG10 = float(np.log(10.0))
#: weight of plain counts, of which unseen words have one, among words outside the vocabulary
PLAIN = 0.5
_F = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _log_total(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials of each row; rows are shifted only if any value is large."""
    if x.size and x.max() > 60:
        top = x.max(axis=1)
        return top + np.log(np.exp(x - top[:, None]).sum(axis=1))
    return np.log(np.exp(x).sum(axis=1))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


@dataclass
class Network:
    """GRU with class-factored output; token t belongs to class t // PER_CLASS."""

    size: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(size: int, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        h, n = HIDDEN, CLASSES * PER_CLASS
        draw = lambda *s, by: (rng.standard_normal(s) / np.sqrt(by)).astype(_F)
        w = {"emb": draw(n, h, by=h), "wx": draw(h, 3 * h, by=h), "wh": draw(h, 3 * h, by=h), "b": np.zeros(3 * h, _F)}
        w |= {"wc": draw(h, CLASSES, by=h), "bc": np.zeros(CLASSES, _F), "wo": draw(CLASSES, h, PER_CLASS, by=h), "bo": np.zeros((CLASSES, PER_CLASS), _F)}
        # entries beyond the vocabulary can't be predicted
        spare = np.arange(n).reshape(CLASSES, PER_CLASS) >= size
        w["bo"][spare] = -30.0
        w["bc"][spare.all(axis=1)] = -30.0
        return Network(size, w)

    def step(self, gates_x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One GRU step from the input's share of the gates."""
        k = HIDDEN
        gh = h @ self.weights["wh"]
        rz = _sigmoid(gates_x[:, : 2 * k] + gh[:, : 2 * k])
        n = np.tanh(gates_x[:, 2 * k :] + rz[:, :k] * gh[:, 2 * k :])
        z = rz[:, k:]
        return n + z * (h - n), rz, n, gh

    def log_prob(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural log probability of each token after its state."""
        w = self.weights
        cls, word = token // PER_CLASS, token % PER_CLASS
        x = h @ w["wc"] + w["bc"]
        out = (x[np.arange(len(token)), cls] - _log_total(x)).astype(np.float64)
        order = np.argsort(cls, kind="stable")
        edge = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(edge)):
            at = order[edge[c] : edge[c + 1]]
            x = h[at] @ w["wo"][c] + w["bo"][c]
            out[at] += x[np.arange(len(at)), word[at]] - _log_total(x)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, state: np.ndarray, end: int) -> tuple[dict[str, np.ndarray], float, np.ndarray]:
        """(gradients, mean loss, last state) of one window: inputs x and targets y, a row per step and a column per stream."""
        w, k = self.weights, HIDDEN
        steps, s = x.shape
        hs, kept = [state], []
        wx = w["wx"]
        ids = x.ravel()
        sort = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[sort], prepend=-1))
        used = ids[sort[first]]  # each input once, since frequent words fill most places
        gates = np.zeros((len(w["emb"]), 3 * k), wx.dtype)
        gates[used] = w["emb"][used] @ wx + w["b"]
        for t in range(steps):
            h = np.where((x[t] == end)[:, None], _F(0), hs[-1])
            new, rz, n, gh = self.step(gates[x[t]], h)
            kept.append((h, rz, n, gh))
            hs.append(new)
        top = np.concatenate(hs[1:])
        token = y.ravel()
        cls, word = token // PER_CLASS, token % PER_CLASS
        rows, count = np.arange(len(token)), len(token)
        g = {name: np.zeros_like(value) for name, value in w.items()}
        logp = _log_softmax(top @ w["wc"] + w["bc"])
        loss = -float(logp[rows, cls].sum())
        pc = np.exp(logp)
        pc[rows, cls] -= 1
        pc /= count
        g["wc"], g["bc"] = top.T @ pc, pc.sum(axis=0)
        dtop = pc @ w["wc"].T
        order = np.argsort(cls, kind="stable")
        edge = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(edge)):
            at = order[edge[c] : edge[c + 1]]
            logp = _log_softmax(top[at] @ w["wo"][c] + w["bo"][c])
            loss -= float(logp[np.arange(len(at)), word[at]].sum())
            p = np.exp(logp)
            p[np.arange(len(at)), word[at]] -= 1
            p /= count
            g["wo"][c], g["bo"][c] = top[at].T @ p, p.sum(axis=0)
            dtop[at] += p @ w["wo"][c].T
        dtop = dtop.reshape(steps, s, k)
        dh = np.zeros((s, k), top.dtype)
        dgx = np.zeros((steps, s, 3 * k), top.dtype)
        for t in range(steps - 1, -1, -1):
            h, rz, n, gh = kept[t]
            dh = dh + dtop[t]
            r, z = rz[:, :k], rz[:, k:]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * gh[:, 2 * k :] * r * (1 - r)
            dgx[t] = np.concatenate([dr, dz, dn], axis=1)
            dgh = np.concatenate([dr, dz, dn * r], axis=1)
            g["wh"] += h.T @ dgh
            dh = (dh * z + dgh @ w["wh"].T) * (x[t] != end)[:, None]
        flat = np.add.reduceat(dgx.reshape(-1, 3 * k)[sort], first, axis=0)
        g["b"] = flat.sum(axis=0)
        g["wx"] = w["emb"][used].T @ flat
        g["emb"][used] = flat @ wx.T
        return g, loss / count, hs[-1]

    def train(self, docs: list[np.ndarray], end: int, *, epochs: int = 2, streams: int = 48, rate: float = 4e-3, good=None) -> None:
        """Truncated back-propagation over streams of concatenated documents.

        ``good`` rates the network (more is better): after an epoch that gains nothing the weights before it come back.
        """
        if not docs:
            return
        w = self.weights
        rng = np.random.default_rng(5)
        m = {n: np.zeros_like(v) for n, v in w.items()}
        v2 = {n: np.zeros_like(v) for n, v in w.items()}
        done, best = 0, -np.inf
        for epoch in range(epochs):
            flow = np.concatenate([docs[i] for i in rng.permutation(len(docs))])
            s = max(1, min(streams, len(flow) // WINDOW))
            length = len(flow) // s
            target = flow[: s * length].reshape(s, length).T
            given = np.vstack([np.full((1, s), end), target[:-1]])
            state = np.zeros((s, HIDDEN), _F)
            before = {n: v.copy() for n, v in w.items()} if good else None
            for t0 in range(0, length, WINDOW):
                g, _, state = self.gradients(given[t0 : t0 + WINDOW], target[t0 : t0 + WINDOW], state, end)
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                clip = min(1.0, 1.0 / max(norm, 1e-9))
                done += 1
                lr = rate * np.sqrt(1 - 0.999**done) / (1 - 0.9**done) * (0.5 if epoch else 1.0)
                for name in w:
                    a = g[name] * _F(clip)
                    m[name] += _F(0.1) * (a - m[name])
                    v2[name] += _F(0.001) * (a * a - v2[name])
                    w[name] -= (lr * m[name] / (np.sqrt(v2[name]) + 1e-8)).astype(_F)
            if good:
                now = good()
                if now <= best:
                    w.update(before)
                    return
                best = now

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[n].ravel() for n in sorted(self.weights)])

    def unflat(self, values: np.ndarray) -> None:
        at = 0
        for n in sorted(self.weights):
            v = self.weights[n]
            self.weights[n] = values[at : at + v.size].reshape(v.shape).astype(_F)
            at += v.size

    def walk(self, tokens: np.ndarray, at: np.ndarray, end: int):
        """(document, token, natural log probability) of all tokens, window by window; document i is tokens[at[i]:at[i+1]], its end included."""
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        gates = self.weights["emb"] @ self.weights["wx"] + self.weights["b"]
        for first in range(0, len(order), STREAMS):
            docs = order[first : first + STREAMS]
            length, start = size[docs], at[docs]
            h, last = np.zeros((len(docs), HIDDEN), _F), np.full(len(docs), end)
            for t0 in range(0, int(length.max(initial=0)), WINDOW):
                states, wanted, owner = [], [], []
                for t in range(t0, min(t0 + WINDOW, int(length[0]))):
                    live = int(np.searchsorted(-length, -t, "left"))
                    h = self.step(gates[last[:live]], h[:live])[0]
                    last = tokens[start[:live] + t]
                    states.append(h)
                    wanted.append(last)
                    owner.append(docs[:live])
                token = np.concatenate(wanted)
                yield np.concatenate(owner), token, self.log_prob(np.concatenate(states), token)

    def score(self, tokens: np.ndarray, at: np.ndarray, end: int, usual: np.ndarray | None = None, weight: float = 1.0) -> np.ndarray:
        """log10 probability of each document.

        With ``usual`` (a probability per token) the network has ``weight`` in a mixture of the two.
        """
        total = np.zeros(len(at) - 1)
        for owner, token, p in self.walk(tokens, at, end):
            if usual is not None:
                p = np.log(weight * np.exp(p) + (1.0 - weight) * usual[token])
            total += np.bincount(owner, weights=p, minlength=len(total))
        return total / LOG10

    def each(self, docs: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, the network's probability of each) of documents, in the order of ``walk``."""
        found = [(t, np.exp(p)) for _, t, p in self.walk(np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])]), end)]
        return np.concatenate([t for t, _ in found]), np.concatenate([p for _, p in found])


def spelling_alphabet(raw: np.ndarray) -> np.ndarray:
    """Symbol of each byte: 0 is a word's edge, the last one any byte that isn't frequent in raw."""
    size = Speller.SYMBOLS
    seen = np.bincount(raw, minlength=256)
    code = np.full(256, size - 1, np.int64)
    code[np.argsort(-seen, kind="stable")[: size - 2]] = np.arange(1, size - 1)
    return code


def spelled_symbols(code: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of words raw[starts[i]:ends[i]] with three edges before and one behind; each one's place; where words begin."""
    size = ends - starts + 4
    first = np.cumsum(size) - size
    x = np.zeros(int(size.sum()), np.int64)
    inner = np.arange(len(x)) - np.repeat(first, size)
    body = (inner >= 3) & (inner < np.repeat(size, size) - 1)
    x[body] = code[raw[(np.repeat(starts, size) + inner - 3)[body]]]
    return x, inner, first


class Speller:
    """Interpolated byte 4-grams: a proper distribution over words of any bytes."""

    SYMBOLS = 56
    BACK = 3.0

    def __init__(self, words: list[bytes], counts: list[int]):
        raw = np.frombuffer(b"".join(words), np.uint8)
        code = spelling_alphabet(raw)
        ends = np.cumsum([len(w) for w in words]).astype(np.int64) if words else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if words else ends
        x, inner, _ = spelled_symbols(code, raw, starts, ends)
        grams = self.grams(x, inner)
        self._fit(code, grams, np.repeat(np.array(counts, float), ends - starts + 1) if words else np.zeros(0))

    @classmethod
    def of_counts(cls, code: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> Speller:
        out = cls.__new__(cls)
        out._fit(code, grams, counts)
        return out

    @classmethod
    def grams(cls, x: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """The packed 4-grams that end at a word's bytes and its end."""
        s, at = cls.SYMBOLS, np.flatnonzero(inner >= 3)
        return ((x[at - 3] * s + x[at - 2]) * s + x[at - 1]) * s + x[at]

    def _fit(self, code: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> None:
        s = self.SYMBOLS
        self.code = code
        whole = np.bincount(grams, weights=counts, minlength=s**4).astype(_F).reshape((s,) * 4)
        p = np.full(s, 1.0 / s, _F)
        for n in range(1, 5):
            c = whole.sum(axis=tuple(range(4 - n))) if n < 4 else whole
            p = (c + _F(self.BACK) * p) / (c.sum(axis=-1, keepdims=True) + _F(self.BACK))
        self.log = np.log10(p).astype(np.float16)
        self.spread = -float(np.log10(np.count_nonzero(code == s - 1)))

    def score(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 probability of each word raw[starts[i]:ends[i]]."""
        if not len(starts):
            return np.zeros(0)
        x, inner, first = spelled_symbols(self.code, raw, starts, ends)
        p = np.zeros(len(x))
        p[3:] = self.log[x[:-3], x[1:-2], x[2:-1], x[3:]] + np.where(x[3:] == self.SYMBOLS - 1, self.spread, 0.0)
        p[inner < 3] = 0.0
        return np.add.reduceat(p, first)


@dataclass
class Model:
    """Network, vocabulary (hashes sorted, with their tokens), the tokens' usual probabilities and the network's weight."""

    network: Network
    known: np.ndarray
    token: np.ndarray
    usual: np.ndarray
    weight: float = 1.0
    other: int = 1
    end: int = 0

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), self.other)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.token[at], self.other)

    def documents(self, column: pa.Array) -> list[np.ndarray]:
        """Tokens of each text, the end included."""
        return [np.append(self.tokens(c.row(i)), self.end) for c in chunks(column, fold=True) for i in range(c.last - c.first)]

    def balance(self, docs: list[np.ndarray]) -> float:
        """Fit the network's weight to documents by expectation maximisation; their mean log probability under the mixture."""
        if not docs:
            return -np.inf
        token, p = self.network.each(docs, self.end)
        q, weight = self.usual[token], 0.8
        for _ in range(30):
            part = weight * p / (weight * p + (1 - weight) * q)
            weight = float(np.clip(part.mean(), 0.01, 0.99))
        self.weight = weight
        return float(np.log(weight * p + (1 - weight) * q).mean())


def vocabulary(head: np.ndarray, counts: np.ndarray, all_words: int, ends: int) -> Model:
    """An untrained model of the most frequent words of a head list sorted by frequency; those that occur once stay out."""
    listed = int(np.count_nonzero(counts[: CLASSES * PER_CLASS - 2] > 1))
    known = head[:listed]
    # tokens by frequency: 0 the end, 1 any other word
    token = np.arange(2, 2 + listed)
    of_token = np.concatenate([[ends, all_words - counts[:listed].sum()], counts[:listed], np.zeros(CLASSES * PER_CLASS - 2 - listed)])
    usual = (of_token + 0.5 * (np.arange(len(of_token)) < 2 + listed)) / (of_token.sum() + 0.5 * (2 + listed))
    sort = np.argsort(known)
    return Model(Network.fresh(2 + listed), known[sort], token[sort], np.maximum(usual, 1e-300))


def fit(model: Model, docs: list[np.ndarray]) -> list[np.ndarray]:
    """Train on documents (tokens) but every tenth, which are returned; epochs go on while those gain."""
    held = docs[9::10]
    model.network.train([d for i, d in enumerate(docs) if i % 10 != 9], model.end, epochs=3, good=(lambda: model.balance(held)) if held else None)
    model.balance(held)
    return held


_TALLY = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
_BLOCKS = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("sums", T.BinaryType()), T.StructField("tokens", T.DoubleType())])
_TAIL = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("word", T.LongType()), T.StructField("n", T.LongType()), T.StructField("spelled", T.FloatType())])


def _tally(code: np.ndarray):
    """Words (kind 0) and spellings of distinct words (kind 1) with their counts; the documents (kind 2)."""

    def run(batches):
        spelled = np.zeros(Speller.SYMBOLS**4, np.int32)
        docs = 0

        def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64, copy=False)), pa.array(n.astype(np.int64))], names=_TALLY.names)

        for batch in batches:
            docs += batch.num_rows
            for c in chunks(batch.column(0), fold=True, chunk_bytes=4 << 20):
                word, first, n = np.unique(c.hashes, return_index=True, return_counts=True)
                yield rows(0, word.view(np.int64), n)
                x, inner, _ = spelled_symbols(code, FOLD[c.raw], c.starts[first], c.ends()[first])
                gram, n = np.unique(Speller.grams(x, inner), return_counts=True)
                spelled[gram] += n.astype(np.int32)
        at = np.flatnonzero(spelled)
        yield rows(1, at, spelled[at])
        yield rows(2, np.zeros(1, np.int64), np.array([docs]))

    return run


def _refine(shared):
    """Weights of copies trained on a task's documents, summed by tokens and cut into blocks."""

    def run(batches):
        model, docs, size = shared.value, [], 0
        start = model.network.flat()
        total, tokens = np.zeros(len(start)), 0.0

        def group() -> None:
            nonlocal docs, size, total, tokens
            copy = Network(model.network.size, {})
            copy.weights = {n: v.copy() for n, v in model.network.weights.items()}
            copy.train(docs, model.end, epochs=1, streams=GROUP_STREAMS, rate=1e-3)
            total += copy.flat() * size
            tokens += size
            docs, size = [], 0

        for batch in batches:
            for d in model.documents(batch.column(0)):
                docs.append(d)
                size += len(d)
                if len(docs) >= GROUP_DOCS or size >= GROUP_TOKENS:
                    group()
        if docs:
            group()
        if tokens:
            cut = range(0, len(total), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK for i in cut], pa.int32()), pa.array([total[i : i + BLOCK].tobytes() for i in cut], pa.binary()), pa.array([tokens] * len(cut))], names=_BLOCKS.names)

    return run


def _add_blocks(batches):
    """Blocks of weights summed by their number."""
    sums: dict[int, np.ndarray] = {}
    tokens: dict[int, float] = {}
    for batch in batches:
        for b, raw, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            values = np.frombuffer(raw, np.float64)
            sums[b] = sums[b] + values if b in sums else values
            tokens[b] = tokens.get(b, 0.0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary()), pa.array(list(tokens.values()), pa.float64())], names=_BLOCKS.names)


def refine(model: Model, texts: DataFrame, held: list[np.ndarray]) -> None:
    """Average the weights of copies trained on all texts, in place, if held-back documents gain by it."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    parts = texts.mapInArrow(settled(_refine(shared)), _BLOCKS).repartition("block").mapInArrow(_add_blocks, _BLOCKS)
    got = sorted(((r["block"], r["sums"], r["tokens"]) for r in parts.collect()), key=lambda r: r[0])  # the network once
    if not got:
        return
    before, was, weight = model.network.flat(), model.balance(held), model.weight
    model.network.unflat(np.concatenate([np.frombuffer(s, np.float64) / n for _, s, n in got]))
    if held and model.balance(held) <= was:
        model.network.unflat(before)
        model.weight = weight


def _gather(shared):
    """One row per document and word outside the head list; of head words outside the vocabulary their spelling, once per task."""

    def run(batches):
        head, inside, speller = shared.value
        seen = inside.copy()
        for batch in batches:
            ids, text_hash = batch.column(0), batch.column(1).to_numpy()
            for c in chunks(batch.column(2), fold=True, chunk_bytes=4 << 20):
                row = np.repeat(np.arange(c.first, c.last), np.diff(c.doc_at))
                spot = np.minimum(np.searchsorted(head, c.hashes), max(0, len(head) - 1))
                far = (head[spot] != c.hashes) if len(head) else np.ones(len(row), bool)
                unseen = np.flatnonzero(~far & ~seen[spot]) if len(head) else np.zeros(0, np.int64)
                near, first = np.unique(spot[unseen], return_index=True)
                seen[near] = True
                order = np.lexsort((c.hashes[far], row[far]))
                w, r = c.hashes[far][order], row[far][order]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
                at = np.flatnonzero(new)
                place = np.concatenate([np.flatnonzero(far)[order][at], unseen[first]])
                if not len(place):
                    continue
                n = np.concatenate([np.diff(np.append(at, len(w))), np.zeros(len(near), np.int64)])
                owner = pa.array(np.concatenate([r[at], np.zeros(len(near), np.int64)]), mask=np.concatenate([np.zeros(len(at), bool), np.ones(len(near), bool)]))
                spelled = speller.score(FOLD[c.raw], c.starts[place], c.ends()[place]).astype(_F)
                yield pa.RecordBatch.from_arrays([ids.take(owner), pa.array(text_hash).take(owner), pa.array(c.hashes[place].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(spelled)], names=_TAIL.names)

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, divisor: int = 7, held: int = 2, sample_docs: int = 1500, share: float = SHARE) -> DataFrame:
    """One row per row of docs with the unigram and the network's log10 probability."""
    spark = docs.sparkSession
    out = F.coalesce(remainder(F.col(doc_id), divisor) == held, F.lit(False))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), (~out).alias("trains"), F.col(text).alias("text"))
    trains = base.filter("trains")
    n = trains.count()
    place = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 30))
    first = int(min(1.0, sample_docs / max(1, n)) * (1 << 30))
    more = min(1 << 30, first + int(share * (1 << 30)))
    sample = pa.array([r[0] for r in trains.filter(place < first).orderBy("doc_id", "text_hash").select("text").collect()], pa.string())  # bounded by sample_docs

    code = spelling_alphabet(np.concatenate([FOLD[c.raw] for c in chunks(sample, fold=True)] or [np.zeros(0, np.uint8)]))
    with rows_per_batch(spark, 1000):
        tally = table(trains.select("text").mapInArrow(settled(_tally(code)), _TALLY).groupBy("kind", "key").agg(F.sum("n").alias("n")), "tally")
    words = tally.filter("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    ends = tally.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    totals = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("s"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    top = words.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    grams = tally.filter("kind = 1").orderBy(F.desc("n"), "key").limit(SPELLINGS).select("key", "n").toArrow()
    speller = Speller.of_counts(code, grams.column(0).to_numpy(), grams.column(1).to_numpy().astype(float))

    by_count = top.column(0).to_numpy().view(np.uint64)
    model = vocabulary(by_count, top.column(1).to_numpy(), int(totals["s"]), int(ends))
    kept = fit(model, model.documents(sample))
    with rows_per_batch(spark, 1000):
        refine(model, trains.filter((place >= first) & (place < more)).select("text"), kept)

    order = np.argsort(by_count)
    head, counts = by_count[order], top.column(1).to_numpy()[order]
    inside = model.tokens(head) != model.other
    listed = counts[inside]
    # words outside the vocabulary: counts less a discount, and what that frees
    n1, n2 = int(totals["n1"]) - int(np.count_nonzero(listed == 1)), int(totals["n2"]) - int(np.count_nonzero(listed == 2))
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    mass = int(totals["s"]) - int(listed.sum())
    freed = discount * (int(totals["v"]) - len(listed)) if mass else 1.0
    mass = max(mass, 1)
    types = int(totals["v"]) - len(listed) + 1
    all_tokens, distinct = int(totals["s"]) + int(ends), int(totals["v"]) + (1 if ends else 0)

    with rows_per_batch(spark, 1000):
        rows = table(base.select("doc_id", "text_hash", "text").mapInArrow(settled(_gather(spark.sparkContext.broadcast((head, inside, speller)))), _TAIL), "words")
    head_spelled = np.zeros(len(head))
    for r in rows.filter("n = 0").groupBy("word").agg(F.max("spelled")).collect():  # at most HEAD rows
        head_spelled[np.searchsorted(head, np.uint64(r[0] & 0xFFFFFFFFFFFFFFFF))] = r[1]
    tail = rows.filter("n > 0").join(words.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    proper = (F.greatest(F.lit(0.0), F.col("c") - discount) + freed * F.pow(F.lit(10.0), F.col("spelled"))) / mass
    share_of = F.log10((1 - PLAIN) * proper + PLAIN * (F.col("c") + 1) / (mass + types))
    tail = tail.groupBy("doc_id", "text_hash").agg(F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"), F.sum(F.col("n") * share_of).alias("outside"))

    within = np.log10((1 - PLAIN) * (np.maximum(0.0, counts - discount) + freed * 10.0**head_spelled) / mass + PLAIN * (counts + 1) / (mass + types))
    within[inside] = 0.0
    shared = spark.sparkContext.broadcast((model, head, np.log10(counts + 1.0), within))

    def run(batches):
        model, head, logs, within = shared.value
        for batch in batches:
            own = [[], [], [], []]
            for c in chunks(batch.column(3), fold=True, chunk_bytes=8 << 20):
                size = np.diff(c.doc_at)
                row = np.repeat(np.arange(len(size)), size)
                token = model.tokens(c.hashes)
                at = c.doc_at + np.arange(len(size) + 1)
                flow = np.full(at[-1], model.end)
                flow[np.arange(len(token)) + row] = token
                spot = np.minimum(np.searchsorted(head, c.hashes), max(0, len(head) - 1))
                near = head[spot] == c.hashes if len(head) else np.zeros(len(row), bool)
                own[0].append(size + 1)
                own[1].append(np.bincount(row[near], minlength=len(size)).astype(np.int64))
                own[2].append(np.bincount(row[near], weights=logs[spot[near]], minlength=len(size)).astype(float))
                own[3].append(model.network.score(flow, at, model.end, model.usual, model.weight) + np.bincount(row[near], weights=within[spot[near]], minlength=len(size)))
            own = [np.concatenate(o) if o else np.zeros(0) for o in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(own[0].astype(np.int64)), pa.array(own[1].astype(np.int64)), pa.array(own[2]), pa.array(own[3])], names=scored.names)

    scored = with_fields(base.drop("text").schema, ("n_tokens", T.LongType()), ("near_known", T.LongType()), ("near_logs", T.DoubleType()), ("score", T.DoubleType()))
    with rows_per_batch(spark, 1000):  # a few numbers a document; texts would else go to Python in batches of 10,000
        done = table(base.mapInArrow(settled(run), scored), "scored")
    copies = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "text_hash"))
    done = done.withColumn("copies", copies)
    tail = tail.select(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash"), "known", "logs", "outside")
    joined = done.join(tail, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_hash") == F.col("t_hash")), "left")
    known = F.col("near_known") + F.expr("coalesce(known, 0) div copies") + (1 if ends else 0)
    logs = F.col("near_logs") + F.coalesce(F.col("logs"), F.lit(0.0)) / F.col("copies") + float(np.log10(ends + 1.0))
    whole = float(np.log10(all_tokens + distinct + 1.0))
    return joined.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", known.cast("long").alias("n_known"), F.lit(all_tokens).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * whole).alias("base_score"), (F.col("score") + F.coalesce(F.col("outside"), F.lit(0.0)) / F.col("copies")).alias("score"))

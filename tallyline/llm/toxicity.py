"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector, if it was frequent enough in training, beside the mean
of the vectors of its character trigrams. Gated recurrent units read a window of words
in both directions, attention pools their states, and a logistic unit gives the window's
score. Windows overlap and cover the whole text; a document scores as its worst window.

Labels are of documents, so training is in rounds: the network picks the highest scoring
windows of toxic and of clean documents, some random clean ones are added, and it learns
from these. The first pick goes by the words' log-odds, which also start their vectors.
Everything is numpy, and small; scoring runs in Spark's tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyline.llm.common import trimmed

#: Words in a window and between the starts of two.
WINDOW = 32
STRIDE = 24
#: Labelled documents that the network is fitted on, at most, and the longest of them.
FIT_TOXIC = 1_200
FIT_CLEAN = 2_400
FIT_CHARS = 20_000
#: Windows of a document among which training picks.
FIT_WINDOWS = 64
#: Words with vectors of their own, at most, and how many documents one must be in.
MAX_WORDS = 20_000
WORD_DOCUMENTS = 3
ROUNDS = 6
BATCH = 256
#: Sizes: word vector, trigram vector, trigram table, state of one direction, attention.
WORD_SIZE, TRIGRAM_SIZE, TRIGRAMS, STATE, ATTENTION = 8, 8, 4_096, 8, 8
#: Words remembered per worker process, windows scored at a time, characters cut at a time.
MAX_REMEMBERED = 150_000
WINDOWS_AT_ONCE = 2_048
CHARS_AT_ONCE = 1 << 21
#: Labelled documents of this many residues are the test fold.
FOLDS = 5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def bare(token: str) -> str:
    """A token without what isn't a letter or digit at its ends."""
    if token.isalnum():
        return token
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all words, one after the other, and how many each has."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    counts = np.array([len(w) for w in words])  # of length + 2 characters
    counts = np.maximum(counts, 1)
    if len(codes) < 3:
        return np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    mixed = (codes[:-2] * 0x9E3779B1 + codes[1:-1]) * 0x85EBCA6B + codes[2:]
    mixed = (mixed ^ (mixed >> np.uint64(17))) * np.uint64(0xC2B2AE35)
    numbers = ((mixed >> np.uint64(16)) % TRIGRAMS).astype(np.int64)
    starts = np.cumsum([0, *(len(w) + 2 for w in words[:-1])])
    starts = np.minimum(starts, len(numbers) - 1)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return numbers[at], counts


@dataclass
class Network:
    """Parameters, and the vocabulary that the word vectors belong to."""

    words: dict[str, int]
    p: dict[str, np.ndarray]

    def inputs(self, words: list[str]) -> np.ndarray:
        """Vectors of words: their own, if they are in the vocabulary, and their trigrams'."""
        own = np.array([self.words.get(w, 0) for w in words], np.int64)
        return self.vectors(own, *trigrams(words))

    def vectors(self, own: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        first = np.cumsum(counts) - counts
        chars = np.add.reduceat(self.p["trigrams"][numbers], first) / counts[:, None]
        return np.concatenate([self.p["words"][own], chars], 1).astype(np.float32)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        return np.concatenate([x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"], 1)

    def states(self, gates: np.ndarray, mask: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """States of one direction, (windows, words, STATE); ``tape`` gets what backward needs."""
        n, length, _ = gates.shape
        u, h = self.p[f"U{d}"], np.zeros((n, STATE), np.float32)
        out = np.empty((n, length, STATE), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            hu = h @ u
            zr = sigmoid(gates[:, t, : 2 * STATE] + hu[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            c = np.tanh(gates[:, t, 2 * STATE :] + r * hu[:, 2 * STATE :])
            new = c + z * (h - c)
            m = mask[:, t, None]
            if tape is not None:
                tape.append((t, h, z, r, c, hu[:, 2 * STATE :]))
            h = np.where(m, new, h)
            out[:, t] = h
        return out

    def pooled(self, h: np.ndarray, mask: np.ndarray):
        a = np.tanh(h @ self.p["A"])
        e = np.where(mask, a @ self.p["v"], -30.0)
        e = np.exp(e - e.max(1, keepdims=True)) * mask
        weights = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
        context = np.einsum("nt,nth->nh", weights, h)
        return a, weights, context, context @ self.p["o"] + self.p["c"][0]

    def scores(self, ids: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Scores of windows of rows of ``table`` (projected words); 0 is no word."""
        out = []
        for i in range(0, len(ids), WINDOWS_AT_ONCE):
            part = ids[i : i + WINDOWS_AT_ONCE]
            mask, gates = part > 0, table[part]
            h = [self.states(gates[:, :, k * 3 * STATE : (k + 1) * 3 * STATE], mask, d) for k, d in enumerate("fb")]
            out.append(sigmoid(self.pooled(np.concatenate(h, 2), mask)[3]))
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Of the mean logistic loss by parameter, and by input."""
        tapes = {"f": [], "b": []}
        h = np.concatenate([self.states(x @ self.p[f"W{d}"] + self.p[f"b{d}"], mask, d, tapes[d]) for d in "fb"], 2)
        a, weights, context, logit = self.pooled(h, mask)
        g = {}
        dl = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["o"], g["c"] = context.T @ dl, np.array([dl.sum()])
        dcontext = dl[:, None] * self.p["o"]
        dh = weights[:, :, None] * dcontext[:, None, :]
        dw = np.einsum("nth,nh->nt", h, dcontext)
        de = weights * (dw - (dw * weights).sum(1, keepdims=True))
        g["v"] = np.einsum("nta,nt->a", a, de)
        da = de[:, :, None] * self.p["v"] * (1 - a * a)
        g["A"] = np.einsum("nth,nta->ha", h, da)
        dh = dh + da @ self.p["A"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, w = self.p[f"U{d}"], self.p[f"W{d}"]
            du, dgates = np.zeros_like(u), np.zeros((*mask.shape, 3 * STATE), np.float32)
            carry = np.zeros((len(x), STATE), np.float32)
            for t, before, z, r, c, hc in reversed(tapes[d]):
                carry = carry + dh[:, t, k * STATE : (k + 1) * STATE]
                m = mask[:, t, None]
                dnew = carry * m
                dc = dnew * (1 - z) * (1 - c * c)
                dz = dnew * (before - c) * z * (1 - z)
                dr = dc * hc * r * (1 - r)
                dhu = np.concatenate([dz, dr, dc * r], 1)
                dgates[:, t] = np.concatenate([dz, dr, dc], 1)
                du += before.T @ dhu
                carry = carry * ~m + dnew * z + dhu @ u.T
            g[f"U{d}"], g[f"W{d}"] = du, np.einsum("ntx,ntg->xg", x, dgates)
            g[f"b{d}"] = dgates.sum((0, 1))
            dx += dgates @ w.T
        return g, dx


def new_network(words: list[str], odds: np.ndarray, rng: np.random.Generator) -> Network:
    inputs = WORD_SIZE + TRIGRAM_SIZE

    def drawn(*shape, scale=None):
        return rng.normal(0, scale or 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    p = {"words": drawn(len(words) + 1, WORD_SIZE, scale=0.1), "trigrams": drawn(TRIGRAMS, TRIGRAM_SIZE, scale=0.1)}
    p["words"][0] = 0
    p["words"][1:, 0] = odds / 2
    for d in "fb":
        p[f"W{d}"], p[f"U{d}"] = drawn(inputs, 3 * STATE), drawn(STATE, 3 * STATE)
        p[f"b{d}"] = np.zeros(3 * STATE, np.float32)
    p["A"], p["v"] = drawn(2 * STATE, ATTENTION), drawn(ATTENTION)
    p["o"], p["c"] = drawn(2 * STATE), np.zeros(1, np.float32)
    return Network({w: i + 1 for i, w in enumerate(words)}, p)


def windows(ids: np.ndarray) -> np.ndarray:
    """Overlapping windows that cover ``ids``, padded with 0; one for no words."""
    count = 1 + max(0, -(-(len(ids) - WINDOW) // STRIDE))
    padded = np.zeros((count - 1) * STRIDE + WINDOW, np.int64)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def fit(texts: list[str], toxic: list[int], seed: int = 11) -> Network:
    """A network fitted on labelled texts."""
    rng = np.random.default_rng(seed)
    numbers: dict[str, int] = {}
    docs = []
    for text in texts:
        tokens = (bare(t) for t in text.lower().split())
        docs.append(np.array([numbers.setdefault(t, len(numbers) + 1) for t in tokens if t], np.int64))
    y = np.array(toxic, bool)
    seen = {True: Counter(), False: Counter()}
    for ids, label in zip(docs, y):
        seen[bool(label)].update(np.unique(ids).tolist())
    every = ["", *numbers]
    totals = Counter(seen[True]) + seen[False]
    own = sorted((i for i, n in totals.items() if n >= WORD_DOCUMENTS), key=lambda i: (-totals[i], every[i]))[:MAX_WORDS]
    rate = {k: (np.array([seen[k][i] for i in own]) + 0.5) / ((y == k).sum() + 1) for k in (True, False)}
    odds = np.clip(np.log(rate[True] / rate[False]), -4, 4) if own else np.zeros(0)
    net = new_network([every[i] for i in own], odds, rng)
    odds_of = np.zeros(len(every), np.float32)
    odds_of[own] = odds

    lexicon = _Lexicon(net, every)
    cut, owner = [], []
    for k, ids in enumerate(docs):
        part = windows(ids)
        if len(part) > FIT_WINDOWS:
            part = part[np.sort(rng.choice(len(part), FIT_WINDOWS, replace=False))]
        cut.append(part)
        owner.append(np.full(len(part), k))
    if not cut or not len(own) or y.all() or not y.any():
        net.p["o"][:] = 0  # nothing to learn from: the share of toxic documents
        net.p["c"][0] = np.log((y.sum() + 0.5) / ((~y).sum() + 0.5))
        return net
    # clean documents without words, for the score of empty texts
    cut, owner = np.concatenate([*cut, np.zeros((16, WINDOW), np.int64)]), np.concatenate([*owner, len(y) + np.arange(16)])
    y = np.append(y, np.zeros(16, bool))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for round_ in range(ROUNDS):
        if round_ == 0:
            score = np.maximum(odds_of[cut], 0).sum(1)
        else:
            table = np.concatenate([np.zeros((1, 6 * STATE), np.float32), net.projected(lexicon.vectors(np.arange(1, len(every))))])
            score = net.scores(cut, table)
        order = np.lexsort((-score, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        top = order[place < 2]
        if round_ > 2:  # toxic documents in which nothing is found are taken for mislabelled
            top = top[~y[owner[top]] | (score[top] > 0.1)]
        clean = np.flatnonzero(~y[owner])
        chosen = np.unique(np.concatenate([top, rng.choice(clean, min(len(clean), len(top)), replace=False)]))
        positive = y[owner[chosen]]
        chosen = np.concatenate([chosen, rng.choice(chosen[positive], max(0, (~positive).sum() // 2 - positive.sum()))]) if positive.any() else chosen
        rng.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            part = chosen[i : i + BATCH]
            step += 1
            _learn(net, cut[part], y[owner[part]], lexicon, moments, step, rng)
    return net


class _Lexicon:
    """The words of the training texts by number, and their trigrams."""

    def __init__(self, net: Network, words: list[str]):
        self.net = net
        self.own = np.array([net.words.get(w, 0) for w in words], np.int64)
        self.numbers, self.counts = trigrams(words)
        self.first = np.cumsum(self.counts) - self.counts

    def trigrams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[ids]
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.numbers[np.repeat(self.first[ids], counts) + within], counts

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        return self.net.vectors(self.own[ids], *self.trigrams(ids))


def _summed(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows that go to each of ``size`` places."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    out[places] = np.add.reduceat(rows[order], first)
    return out


def _learn(net: Network, ids, y, lexicon: _Lexicon, moments, step, rng) -> None:
    """One step of Adam on some windows."""
    used, at = np.unique(ids, return_inverse=True)
    at = at.reshape(ids.shape)
    own, (numbers, counts) = lexicon.own[used], lexicon.trigrams(used)
    x = net.vectors(own, numbers, counts)
    hidden = rng.random(len(own)) < 0.1  # some words must do without a vector of their own
    x[hidden, :WORD_SIZE] = 0
    mask = ids > 0
    g, dx = net.gradients(x[at], mask, y.astype(np.float32))
    dx = dx * mask[:, :, None]
    by_word = _summed(dx.reshape(-1, x.shape[1]), at.ravel(), len(used))
    by_word[hidden, :WORD_SIZE] = 0
    g["words"] = _summed(by_word[:, :WORD_SIZE], own, len(net.p["words"]))
    g["words"][0] = 0
    by_trigram = np.repeat(by_word[:, WORD_SIZE:] / counts[:, None], counts, 0)
    g["trigrams"] = _summed(by_trigram, numbers, TRIGRAMS)
    rate = 0.01 * min(1.0, 150 / step)
    for k, grad in g.items():
        m, v = moments[k]
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


class Scorer:
    """Scores whole texts; remembers the projections of words."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.of_token: dict[str, int] = {}
        self.table = np.zeros((1 << 14, 6 * STATE), np.float32)

    def _learn(self, tokens: set[str]) -> None:
        words = {t: bare(t) for t in tokens}
        new = sorted({w for w in words.values() if w and w not in self.rows})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            first = len(self.rows) + 1
            while first + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(part)] = self.net.projected(self.net.inputs(part))
            self.rows.update(zip(part, range(first, first + len(part))))
        self.of_token.update((t, self.rows[w] if w else 0) for t, w in words.items())

    def _ids(self, tokens: list[str]) -> np.ndarray:
        ids = np.fromiter(map(self.of_token.__getitem__, tokens), np.int64, len(tokens))
        return ids[ids > 0]

    def _parts(self, text: str) -> Iterator[str]:
        """Some characters of the text at a time, cut behind white space."""
        at = 0
        while at < len(text):
            end = at + CHARS_AT_ONCE
            while end < len(text) and not text[end - 1].isspace():
                end += 1
            yield text[at:end]
            at = end

    def scores(self, texts: list[str]) -> list[float]:
        found = np.zeros(len(texts))
        waiting, owners, held = [], [], 0

        def settle():
            nonlocal held
            if waiting:
                score = self.net.scores(np.concatenate(waiting), self.table)
                np.maximum.at(found, np.repeat(owners, [len(w) for w in waiting]), score)
                waiting.clear()
                owners.clear()
            held = 0

        short = [text.lower().split() if len(text) <= CHARS_AT_ONCE else None for text in texts]
        if len(self.of_token) > MAX_REMEMBERED:
            self.clear()
        self._learn({t for tokens in short if tokens for t in tokens if t not in self.of_token})
        for k, (text, tokens) in enumerate(zip(texts, short)):
            if tokens is not None:
                cut = windows(self._ids(tokens))
                waiting.append(cut)
                owners.append(k)
                held += len(cut)
            else:
                before: list[str] = []
                for part in self._parts(text):
                    tokens = before + part.lower().split()
                    fresh = {t for t in tokens if t not in self.of_token}
                    if len(self.of_token) + len(fresh) > MAX_REMEMBERED:
                        settle()  # numbers of words are about to change
                        self.clear()
                        self._learn({t for x in short[k:] if x for t in x})
                        fresh = set(tokens)
                    self._learn(fresh - self.of_token.keys())
                    score = self.net.scores(windows(self._ids(tokens)), self.table)
                    found[k] = max(found[k], score.max())
                    real = [t for t in tokens if self.of_token[t]]
                    before = real[-(WINDOW - STRIDE) :]
            if held >= WINDOWS_AT_ONCE:
                settle()
        settle()
        return found.tolist()


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """A network fitted on the labelled documents outside the test fold, a bounded sample.

    The sample is the first ``FIT_TOXIC`` and ``FIT_CLEAN`` ids in order of their hash,
    of texts up to ``FIT_CHARS``. Ids with several labels are toxic if one says so; null
    ids and labels and documents without a label aren't used; without any usable label
    every text gets the same score.
    """
    known = labels.where(f"`{id_col}` is not null and `{label_col}` is not null")
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__toxic"))
    known = known.where(~held_out(F.col("__id")))
    drawn = [
        known.where(F.col("__toxic") == value).orderBy(F.xxhash64("__id"), "__id").limit(most)
        for value, most in ((1, FIT_TOXIC), (0, FIT_CLEAN))
    ]
    sample = F.broadcast(drawn[0].union(drawn[1]))  # FIT_TOXIC + FIT_CLEAN rows at most
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text")).where(F.length("__text") <= FIT_CHARS)
    found = rows.join(sample, "__id").toArrow().to_pylist()
    found.sort(key=lambda r: (r["__id"], r["__text"]))
    return fit([r["__text"] for r in found[: 2 * (FIT_TOXIC + FIT_CLEAN)]], [r["__toxic"] for r in found[: 2 * (FIT_TOXIC + FIT_CLEAN)]])


def held_out(id_: Column) -> Column:
    """Whether an id is in the test fold."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def score_texts(docs: DataFrame, net: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text, 0 to 1, in a new column.

    Null texts are empty; an empty text has one window without words, so all of them
    score alike. Repeated rows stay, an empty table gives an empty result. All columns
    of ``docs`` come out unchanged; ``score_col`` must not be among them.
    """
    sent = docs.sparkSession.sparkContext.broadcast((net.words, net.p))
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(*sent.value))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [str(t) if t is not None else "" for t in batch.column(place).to_pylist()]
                columns = [*batch.columns, pa.array(scorer.scores(texts), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(trimmed(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per row; rows are handled as in ``score_texts``.

    ``predicted`` is 1 from a score of 0.5; a null id isn't held out.
    """
    net = fit_on(docs, labels, id_col, text_col)
    named = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    scored = score_texts(named, net, "__text", "__score")
    return scored.select(
        F.col("__id").alias(id_col),
        held_out(F.col("__id")).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; columns unchanged."""
    net = fit_on(docs, labels, id_col, text_col)
    return score_texts(docs, net, text_col, "__toxicity").where("__toxicity < 0.5").drop("__toxicity")

"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train one model under the non-negative unbiased risk: prior * loss(positives, +) +
max(0, loss(unlabelled, -) - prior * loss(positives, -)); where the bracket would fall below zero, the step goes the other way.
The class prior is estimated from a first model's scores of every unlabelled row and trusted positive that the model was not trained on, as histograms made
on the executors: the least ratio, over thresholds, of the unlabelled share above to the positives' share above.

A score is made from the whole text: a small network over statistics (words, lines, repetition, symbols), plus one weight for each of ``BUCKETS`` hashed words
and pairs of neighbouring words, so that what a text says counts and not only its shape. The gradient steps use a sample of ``max_rows`` rows of each kind at
most and four fifths of the rows at most, chosen by a hash of the id; everything else covers all rows.

Defined results: null or empty text has features of zero words and gets a score like any other; null labels teach nothing; rows that repeat an id are scored
each, and are positives together if any label of that id is 1; rows with the same text have the same score; very long texts are read whole; without positives or
unlabelled text every score is 0.5; labelled rows without a document are ignored; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.words import Words, hash_words, mix, slices
from loamgraph.session import pin

#: Hashed words and word pairs.
BUCKETS = 1 << 13
SPREAD_BUCKETS = 256
STATS = 15
#: Margins are counted in steps of this width, within plus and minus EDGE.
STEP, EDGE = 0.05, 30.0


@dataclass
class Features:
    """Statistics by text, and the hashed words as rows of (bucket, weight): ``offsets[i]:offsets[i+1]`` are text i's."""

    stats: np.ndarray
    offsets: np.ndarray
    buckets: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.stats)

    def rows(self, pick: np.ndarray) -> Features:
        many = np.diff(self.offsets)[pick]
        at = np.repeat(self.offsets[pick] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        return Features(self.stats[pick], np.append(0, np.cumsum(many)), self.buckets[at], self.weights[at])

    @staticmethod
    def of(x: Features | np.ndarray) -> Features:
        """Plain statistics have no words."""
        if isinstance(x, Features):
            return x
        return Features(np.asarray(x, dtype=np.float32), np.zeros(len(x) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))

    @staticmethod
    def join(parts: list[Features]) -> Features:
        if not parts:
            return Features(np.zeros((0, STATS), np.float32), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        sizes = np.concatenate([np.diff(p.offsets) for p in parts])
        return Features(
            np.concatenate([p.stats for p in parts]),
            np.append(0, np.cumsum(sizes)),
            np.concatenate([p.buckets for p in parts]),
            np.concatenate([p.weights for p in parts]),
        )


def word_buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every word and of every pair of neighbours, its text)."""
    owner = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = mix(w.hashes[pair] * np.uint64(3) + w.hashes[pair + 1])
    bucket = (np.concatenate([w.hashes, pairs]) % np.uint64(BUCKETS)).astype(np.int64)
    return bucket, np.concatenate([owner, owner[pair]])


def described(texts: list[str | None]) -> Features:
    """Of whole texts. A bucket's weight is its count over the root of the text's words and pairs."""
    w = hash_words(texts)
    bucket, owner = word_buckets(w)
    key, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
    total = np.bincount(owner, minlength=len(texts))
    own = key // BUCKETS
    weights = (count / np.sqrt(np.maximum(total[own], 1))).astype(np.float32)
    return Features(statistics(texts, w), np.append(0, np.cumsum(np.bincount(own, minlength=len(texts)))), key % BUCKETS, weights)


def features(texts: list[str | None]) -> np.ndarray:
    """One row of statistics per text."""
    return statistics(texts, hash_words(texts))


def statistics(texts: list[str | None], w: Words) -> np.ndarray:
    n = len(texts)
    count = np.diff(w.offsets)
    some = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), count)
    raw_owner = np.repeat(np.arange(n), np.diff(w.raw_offsets))
    size = np.maximum(np.diff(w.raw_offsets) - 1, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(raw_owner[mask], minlength=n) / size

    raw, h = w.raw, w.hashes
    out = np.zeros((n, STATS), dtype=np.float32)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    # different words of each text: first of its kind after a sort of (text, word)
    order = np.lexsort((h, owner))
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    kinds = np.bincount(owner[order][first], minlength=n)
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.bincount(owner, weights=w.lengths, minlength=n) / some / 10
    out[:, 2] = np.bincount(owner[same], minlength=n) / some
    out[:, 3] = np.log1p(kinds) / np.maximum(np.log1p(count), 1)
    digit, upper = (raw >= 48) & (raw <= 57), (raw >= 65) & (raw <= 90)
    symbol = (raw < 128) & (raw > 32) & ~(digit | upper | ((raw >= 97) & (raw <= 122)))
    out[:, 4] = share(symbol & ~np.isin(raw, np.frombuffer(b".,!?'-\"", np.uint8))) * 10
    out[:, 5] = share(np.isin(raw, np.frombuffer(b".,!?", np.uint8))) * 10
    out[:, 6] = share(digit) * 10
    out[:, 7] = share(upper) * 10
    out[:, 8] = share(raw == 10) * 100
    out[:, 9] = share((raw == 32) | ((raw >= 9) & (raw <= 13))) * 5
    out[:, 10] = share(symbol) * 10
    out[:, 11] = share(raw >= 128) * 2
    bucket = (h % np.uint64(SPREAD_BUCKETS)).astype(np.int64)
    counts = np.bincount(owner * SPREAD_BUCKETS + bucket, minlength=n * SPREAD_BUCKETS).reshape(n, SPREAD_BUCKETS)
    shares = counts / some[:, None]
    out[:, 12] = shares.max(axis=1, initial=0) * 5
    out[:, 13] = (shares * shares).sum(axis=1) * 10
    out[:, 14] = count == 0
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    words: np.ndarray  # a weight per bucket
    prior: float

    def hidden(self, x: Features) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x.stats - self.mean) / self.scale, -5, 5).astype(np.float32)
        return z, np.maximum(z @ self.w1 + self.b1, 0)

    def margin(self, x: Features) -> np.ndarray:
        return self.hidden(x)[1] @ self.w2 + self.b2[0] + sums(self.words[x.buckets] * x.weights, x.offsets)

    def margin_texts(self, texts: list[str | None]) -> np.ndarray:
        """The same as ``margin(described(texts))``; words are looked up one by one instead of counted by bucket first."""
        w = hash_words(texts)
        bucket, owner = word_buckets(w)
        total = np.bincount(owner, minlength=len(texts))
        by_word = np.bincount(owner, weights=self.words[bucket], minlength=len(texts)) / np.sqrt(np.maximum(total, 1))
        plain = Features.of(statistics(texts, w))
        return self.hidden(plain)[1] @ self.w2 + self.b2[0] + by_word

    def score(self, x: Features | np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(Features.of(x)).astype(np.float64))


PARAMETERS = ("w1", "b1", "w2", "b2", "words")


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each row; empty rows have 0."""
    return np.diff(np.append(0.0, np.cumsum(values, dtype=np.float64))[offsets])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def slopes(net: Network, x: Features, n_pos: int, prior: float) -> tuple[float, float, dict[str, np.ndarray]]:
    """(positives' part of the risk, the bracket, gradients of what is stepped along) of a batch whose first ``n_pos`` rows are positives.

    The loss is logistic. With a bracket below zero the gradient is that of minus the bracket.
    """
    z, a = net.hidden(x)
    m = a @ net.w2 + net.b2[0] + sums(net.words[x.buckets] * x.weights, x.offsets)
    loss = lambda v: np.logaddexp(0, -v)
    positive = prior * loss(m[:n_pos]).mean()
    bracket = loss(-m[n_pos:]).mean() - prior * loss(-m[:n_pos]).mean()
    s = sigmoid(m)
    n_unl = len(m) - n_pos
    if bracket >= 0:
        g = np.concatenate([np.full(n_pos, -prior / n_pos), s[n_pos:] / n_unl])
    else:
        g = np.concatenate([prior * s[:n_pos] / n_pos, -s[n_pos:] / n_unl])
    da = np.outer(g, net.w2) * (a > 0)
    by_word = np.bincount(x.buckets, weights=np.repeat(g, np.diff(x.offsets)) * x.weights, minlength=BUCKETS)
    return positive, bracket, {"w1": z.T @ da, "b1": da.sum(axis=0), "w2": a.T @ g, "b2": np.array([g.sum()]), "words": by_word}


def start(pos: Features, unl: Features, prior: float, hidden: int, rng: np.random.Generator) -> Network:
    both = np.concatenate([pos.stats, unl.stats])
    w1, w2 = rng.normal(0, (2 / both.shape[1]) ** 0.5, (both.shape[1], hidden)), rng.normal(0, hidden**-0.5, hidden)
    return Network(both.mean(axis=0), both.std(axis=0) + 1e-3, w1, np.zeros(hidden), w2, np.zeros(1), np.zeros(BUCKETS), prior)


def train(
    pos: Features, unl: Features, prior: float, hidden: int = 16, steps: int = 600, batch: int = 512, rate: float = 1e-2, decay: float = 1e-3, seed: int = 3,
) -> Network:
    """Adam on mini-batches of the non-negative risk; weights of words and layers decay."""
    rng = np.random.default_rng(seed)
    net = start(pos, unl, prior, hidden, rng)
    held = {k: [np.zeros_like(getattr(net, k)) for _ in range(2)] for k in PARAMETERS}
    for t in range(1, steps + 1):
        x = Features.join([part.rows(rng.integers(0, len(part), batch)) for part in (pos, unl)])
        for k, grad in slopes(net, x, batch, prior)[2].items():
            if k in ("w1", "w2", "words"):
                grad = grad + decay * getattr(net, k)
            m, v = held[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            setattr(net, k, getattr(net, k) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
    return net


def estimate_prior(steps: np.ndarray, pos: np.ndarray, unl: np.ndarray) -> float:
    """Histograms of margins: counts of positives and of unlabelled rows by ``steps``. The least ratio of shares above a threshold that leaves half to 98 % of
    the positives above it."""
    order = np.argsort(-steps)
    above, rest = np.cumsum(pos[order]) / max(1, pos.sum()), np.cumsum(unl[order]) / max(1, unl.sum())
    usable = (above >= 0.5) & (above <= 0.98)
    return float(np.clip((rest[usable] / above[usable]).min(), 0.05, 0.99)) if usable.any() else 0.5


def counted(margins: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(margins, -EDGE, EDGE) / STEP)


def fit(pos: Features | np.ndarray, unl: Features | np.ndarray) -> Network | None:
    """In memory: a fifth of each is kept back for the prior."""
    if not len(pos) or not len(unl):
        return None
    pos, unl = Features.of(pos), Features.of(unl)
    rng = np.random.default_rng(2)
    pos, unl = pos.rows(rng.permutation(len(pos))), unl.rows(rng.permutation(len(unl)))
    a, b = max(1, len(pos) * 4 // 5), max(1, len(unl) * 4 // 5)
    first = train(pos.rows(np.arange(a)), unl.rows(np.arange(b)), 0.5, steps=300)
    seen = [counted(first.margin(x.rows(np.arange(k, len(x))))) for x, k in ((pos, a), (unl, b))]
    values = np.unique(np.concatenate(seen))
    prior = estimate_prior(values, *[np.array([(s == v).sum() for v in values]) for s in seen]) if len(seen[0]) and len(seen[1]) else 0.5
    return train(pos, unl, prior)


def spread_of(id_: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(id_.cast("string"), F.lit("sample")), 11) / F.lit(float(1 << 53))


def fit_quality(
    docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 6000
) -> Network | None:
    """``learn_from`` holds for both tables. Trains on samples, then counts every other row for the prior."""
    trusted = labels.filter(learn_from & (F.col(label_col) == 1)).select(F.col(id_col).cast("long").alias("id")).distinct()
    texts = docs.filter(learn_from).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    spread = spread_of(F.col("id"))
    cut_pos, cut_unl = (min(0.8, max_rows / max(1, n)) for n in (trusted.count(), texts.select("id").count()))
    picked = F.broadcast(trusted.filter(spread < cut_pos).limit(2 * max_rows))
    pos = collect_features(texts.join(picked, "id", "left_semi"), max_rows)
    unl = collect_features(texts.filter(spread < cut_unl), max_rows)
    if not len(pos) or not len(unl):
        return None
    first = train(pos, unl, 0.5, steps=300)
    step = F.floor(F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.col("margin"))) / STEP).alias("step")
    seen = pin(margins(texts, first).select("doc_id", step))
    others = trusted.filter(spread >= cut_pos)
    of_pos = {r["step"]: r["n"] for r in seen.join(others, seen["doc_id"] == others["id"], "left_semi").groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()}
    rest = seen.filter(spread_of(F.col("doc_id")) >= cut_unl)
    of_unl = {r["step"]: r["n"] for r in rest.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = sorted(of_pos.keys() | of_unl.keys())  # 2 * EDGE / STEP + 1 at most
    return train(pos, unl, estimate_prior(np.array(steps), *[np.array([h.get(k, 0) for k in steps]) for h in (of_pos, of_unl)]))


def collect_features(rows: DataFrame, max_rows: int) -> Features:
    """Features of a sample, made on the executors; at most BUCKETS pairs of numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start_, texts in slices(b.column(1)):
                x = described(texts)
                split = [(a, c) for a, c in zip(x.offsets, x.offsets[1:], strict=False)]
                made = [[r.tobytes() for r in x.stats], [x.buckets[a:c].astype("<u2").tobytes() for a, c in split], [x.weights[a:c].tobytes() for a, c in split]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start_, len(texts)), *(pa.array(c, pa.binary()) for c in made)], names=["id", "x", "b", "w"])

    made = rows.select("id", "text").mapInArrow(run, "id long, x binary, b binary, w binary")
    got = sorted(made.limit(2 * max_rows).collect(), key=lambda r: (spread_key(r["id"]), r["x"], r["b"]))[:max_rows]
    parts = [np.frombuffer(r["b"], "<u2").astype(np.int64) for r in got]
    if not got:
        return Features.join([])
    return Features(
        np.array([np.frombuffer(r["x"], np.float32) for r in got]),
        np.append(0, np.cumsum([len(x) for x in parts])),
        np.concatenate(parts),
        np.concatenate([np.frombuffer(r["w"], np.float32) for r in got]),
    )


def spread_key(id_: int | None) -> int:
    """An order of ids that has nothing to do with their size."""
    return int(mix(np.array([(id_ or 0) & (1 << 64) - 1], dtype=np.uint64))[0])


def margins(texts: DataFrame, model: Network | None) -> DataFrame:
    """``texts``: id, text. doc_id, margin (0 without a model)."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers and a few hundred, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start_, rows in slices(b.column(1)):
                m = np.zeros(len(rows)) if shared.value is None else shared.value.margin_texts(rows).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start_, len(rows)), pa.array(m, pa.float64())], names=["doc_id", "margin"])

    return texts.select("id", "text").mapInArrow(run, "doc_id long, margin double")


def score(docs: DataFrame, model: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bounded = F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.col("margin")))
    return margins(texts, model).select("doc_id", (1 / (1 + F.exp(-bounded))).alias("score"))

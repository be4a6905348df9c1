"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed vectors of the word and of its first bytes, so that inflected forms share what they have in common.
Filters of several widths run over the words of the whole text; each filter's largest response over the text (max
pooling) feeds a logistic unit. The first component of every vector starts from the log-odds of its bucket among toxic and other
training texts. Training is by Adam, the gradient flows through the pooled places only.

Thresholds are calibrated by language: the language is guessed from hashed words of the text itself, and scores are shifted so that the language's best
threshold (by F1) falls on ``CUT``. Every labelled row that was not trained on counts, in histograms of margins made on the executors. Languages with fewer than
``LEAST`` toxic or other such rows use the threshold of all.

Training uses ``max_rows`` labelled rows at most and three quarters of them at most, chosen by a hash of the id; scoring runs where the rows are, once: margins
are kept, thresholds shift them.

Defined results: null or empty text has no words and scores below ``CUT``; null labels teach nothing; an id with labels of both kinds is toxic; rows that repeat
an id are scored each, rows with the same text alike; very long texts are read whole; of thresholds with the same F1 the highest counts; without labels of both
kinds every score is 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.words import Words, hash_words, slices
from loamgraph.session import pin

BUCKETS = 1 << 14
PREFIXES = (4, 5)
WIDTHS = (1, 2, 3)
DIM, FILTERS = 8, 8
CUT = 0.3
LANG_BUCKETS = 1 << 12
#: Rows of each kind that a language needs for a threshold of its own; margins are counted in steps of STEP.
LEAST, STEP = 10, 0.02


def word_ids(w: Words) -> np.ndarray:
    """(words, 1 + prefixes) buckets."""
    return np.stack([w.hashes % np.uint64(BUCKETS), *[w.prefixes(n) % np.uint64(BUCKETS) for n in PREFIXES]], axis=1).astype(np.int32)


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


@dataclass
class Filters:
    """Embeddings, one weight block (width * DIM, FILTERS) and bias per width, and the logistic unit."""

    table: np.ndarray
    weights: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    languages: list[str] = field(default_factory=list)
    lang_table: np.ndarray | None = None  # (LANG_BUCKETS, languages) log-probabilities
    cuts: np.ndarray | None = None  # margin at the threshold, by language

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return self.table[ids].sum(axis=1)

    def pooled(self, x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest responses (texts, widths * FILTERS), at least 0, and each width's responses by place."""
        n = len(offsets) - 1
        count = np.diff(offsets)
        held = np.flatnonzero(count)
        pooled, by_place = [], []
        for width, weight, bias in zip(WIDTHS, self.weights, self.bias, strict=True):
            r = np.zeros((len(x), FILTERS), np.float32)
            for k in range(width):
                if len(x) > k:
                    r[: len(x) - k] += x[k:] @ weight[k * DIM : (k + 1) * DIM]
            r += bias
            if width > 1 and len(x):  # windows stay inside their text
                ends = offsets[1:][held]
                for k in range(1, width):
                    r[np.maximum(ends - k, offsets[:-1][held])] = 0
            top = np.zeros((n, FILTERS), np.float32)
            if len(held):
                top[held] = np.maximum(np.maximum.reduceat(r, offsets[:-1][held], axis=0), 0)
            pooled.append(top)
            by_place.append(r)
        return np.concatenate(pooled, axis=1), by_place

    def margins(self, w: Words) -> np.ndarray:
        h, _ = self.pooled(self.embed(word_ids(w)), w.offsets)
        return h @ self.out + self.out_bias

    def guess_language(self, w: Words) -> np.ndarray:
        n = len(w.offsets) - 1
        if not self.languages:
            return np.zeros(n, np.int64)
        seen = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.lang_table[(w.hashes % np.uint64(LANG_BUCKETS)).astype(np.int64)], axis=0)])
        return (seen[w.offsets[1:]] - seen[w.offsets[:-1]]).argmax(axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        w = hash_words(texts)
        z = self.margins(w).astype(np.float64) - self.cuts[self.guess_language(w)].astype(np.float64)
        p = 1 / (1 + np.exp(-np.clip(z + logit(CUT), -30, 30)))
        return np.where(np.diff(w.offsets) > 0, p, 0.0)


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, offsets), built in slices so that only the ids are ever held whole."""
    parts, counts = [], []
    for _, run in slices(texts):
        w = hash_words(run)
        parts.append(word_ids(w))
        counts.append(np.diff(w.offsets))
    ids = np.concatenate(parts) if parts else np.zeros((0, 1 + len(PREFIXES)), np.int32)
    return ids, np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else [])]).astype(np.int64)


def initial(ids: np.ndarray, offsets: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Filters:
    seen = np.zeros((2, BUCKETS))
    for i, label in enumerate(y):
        seen[label, np.unique(ids[offsets[i] : offsets[i + 1]])] += 1
    clean, toxic = seen
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / (len(y) - y.sum() + 1))
    sure = (toxic + clean) / (toxic + clean + 8)
    table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    table[:, 0] = odds * sure
    weights = [rng.normal(0, 0.1, (width * DIM, FILTERS)).astype(np.float32) for width in WIDTHS]
    for weight in weights:
        weight[0, : FILTERS // 2] += 0.5
    return Filters(table, weights, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0.1, 0.05, len(WIDTHS) * FILTERS).astype(np.float32))


class Adam:
    def __init__(self, shape: tuple, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, x: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-7)


def slopes(net: Filters, ids: np.ndarray, x: np.ndarray, offsets: np.ndarray, h: np.ndarray, places: list[np.ndarray], g: np.ndarray) -> dict:
    """Gradients of the sum of ``g`` times the texts' margins: through the largest response of each filter only."""
    dh = np.outer(g, net.out) * (h > 0)
    table = np.zeros_like(net.table)
    weights, bias = [np.zeros_like(w) for w in net.weights], [np.zeros_like(b) for b in net.bias]
    for k, width in enumerate(WIDTHS):
        for i in range(len(g)):
            a, b = offsets[i], offsets[i + 1]
            d = dh[i, k * FILTERS : (k + 1) * FILTERS]
            live = np.flatnonzero(d)
            if not len(live):
                continue
            top = a + places[k][a:b, live].argmax(axis=0)
            bias[k][live] += d[live]
            for j in range(width):
                here = np.minimum(top + j, b - 1)
                inside = (top + j < b).astype(np.float32)
                weights[k][j * DIM : (j + 1) * DIM, live] += x[here].T * (d[live] * inside)
                back = net.weights[k][j * DIM : (j + 1) * DIM, live] * (d[live] * inside)
                for column in range(ids.shape[1]):
                    np.add.at(table, ids[here, column], back.T)
    return {"table": table, "weights": weights, "bias": bias, "out": h.T @ g}


def train(texts: list[str], y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 3e-3, seed: int = 5) -> Filters:
    rng = np.random.default_rng(seed)
    ids, bounds = hashed(texts)
    net = initial(ids, bounds, y, rng)
    odds = np.log(y.mean() / (1 - y.mean()))
    net.out_bias = float(odds) - 1.0
    adams = {"table": Adam(net.table.shape, rate), "out": Adam(net.out.shape, rate)}
    adams |= {("w", k): Adam(x.shape, rate) for k, x in enumerate(net.weights)} | {("b", k): Adam(x.shape, rate) for k, x in enumerate(net.bias)}
    weight_of = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    bias = np.array([net.out_bias], np.float32)
    bias_adam = Adam((1,), rate * 10)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            part = np.sort(order[at : at + batch])
            spans = [np.arange(bounds[i], bounds[i + 1]) for i in part]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
            own = ids[np.concatenate(spans).astype(np.int64)] if offsets[-1] else ids[:0]
            x = net.embed(own)
            h, places = net.pooled(x, offsets)
            p = 1 / (1 + np.exp(-np.clip(h @ net.out + bias[0], -30, 30)))
            g = ((p - y[part]) * weight_of[part] / len(part)).astype(np.float32)
            grads = slopes(net, own, x, offsets, h, places, g)
            for k in range(len(WIDTHS)):
                adams["w", k].step(net.weights[k], grads["weights"][k])
                adams["b", k].step(net.bias[k], grads["bias"][k])
            adams["out"].step(net.out, grads["out"])
            bias_adam.step(bias, np.array([g.sum()], np.float32))
            adams["table"].step(net.table, grads["table"])
    net.out_bias = float(bias[0])
    return net


def learn_languages(net: Filters, texts: list[str | None], langs: list[str | None]) -> None:
    """``langs`` is used here alone: to learn the guess of a text's language."""
    net.languages = sorted({x for x in langs if x is not None})
    counts = np.full((LANG_BUCKETS, max(1, len(net.languages))), 0.1)
    for start, run in slices(texts):
        w = hash_words(run)
        for i, lang in enumerate(langs[start : start + len(run)]):
            if lang is not None:
                h = w.hashes[w.offsets[i] : w.offsets[i + 1]] % np.uint64(LANG_BUCKETS)
                np.add.at(counts[:, net.languages.index(lang)], h.astype(np.int64), 1)
    net.lang_table = np.log(counts / counts.sum(axis=0))
    net.cuts = np.zeros(max(1, len(net.languages)), dtype=np.float32)


def cut_of(steps: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The margin at the best threshold, from counts by ``steps``: the middle between the last step that is above it and the first below."""
    order = np.argsort(-steps)
    hit, miss = np.cumsum(toxic[order]), np.cumsum(clean[order])
    k = int((2 * hit / (hit + miss + toxic.sum())).argmax())
    below = steps[order[k + 1]] + 1 if k + 1 < len(steps) else steps[order[k]] - 50
    return float((steps[order[k]] + below) / 2 * STEP)


def calibrate(net: Filters, seen: np.ndarray) -> None:
    """``seen``: rows of (language, step, toxic rows, other rows). Sets the languages' thresholds."""
    values = np.unique(seen[:, 1])

    def counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(values, rows[:, 1])
        return tuple(np.bincount(at, weights=rows[:, c], minlength=len(values)) for c in (2, 3))

    net.cuts[:] = cut_of(values, *counted(seen))
    for k in range(len(net.languages)):
        own = counted(seen[seen[:, 0] == k])
        if min(x.sum() for x in own) >= LEAST:
            net.cuts[k] = cut_of(values, *own)


def judged(net: Filters, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(margin, guessed language, has words) of every text."""
    w = hash_words(texts)
    return net.margins(w).astype(np.float64), net.guess_language(w), np.diff(w.offsets) > 0


def fit(texts: list[str | None], y: np.ndarray, langs: list[str | None], seed: int = 9) -> Filters | None:
    """In memory: a quarter is kept back for the thresholds."""
    y = np.asarray(y, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return None
    kept_back = np.random.default_rng(seed).random(len(y)) < 0.25
    if y[~kept_back].min() == y[~kept_back].max() or not kept_back.any() or y[kept_back].min() == y[kept_back].max():
        kept_back[:] = False
    net = train([t for t, k in zip(texts, kept_back, strict=True) if not k], y[~kept_back])
    learn_languages(net, texts, langs)
    check = kept_back if kept_back.any() else np.ones(len(y), dtype=bool)
    margin, guess, _ = (np.concatenate(x) for x in zip(*(judged(net, run) for _, run in slices(texts, 1_000_000)), strict=True))
    calibrate(net, np.stack([guess, np.floor(margin / STEP), y == 1, y == 0], axis=1)[check])
    return net


def spread_of(id_: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(id_.cast("string"), F.lit("sample")), 11) / F.lit(float(1 << 53))


def margins(docs: DataFrame, model: Filters | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, margin, language (a number), has_words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of DIM numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in slices(b.column(1)):
                n = len(texts)
                made = (np.zeros(n), np.zeros(n, int), np.zeros(n, bool)) if shared.value is None else judged(shared.value, texts)
                cols = [pa.array(x, t) for x, t in zip(made, (pa.float64(), pa.int32(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, n), *cols], names=["doc_id", "margin", "language", "has_words"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, margin double, language int, has_words boolean")


def scores(judged_rows: DataFrame, model: Filters | None) -> DataFrame:
    """``margins`` to doc_id, score."""
    if model is None:
        return judged_rows.select("doc_id", F.lit(0.0).alias("score"))
    cuts = F.array(*[F.lit(float(c)) for c in model.cuts])  # one number per language
    z = F.col("margin") - F.get(cuts, F.col("language")) + logit(CUT)
    return judged_rows.select("doc_id", F.when(F.col("has_words"), 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).otherwise(0.0).alias("score"))


def fit_and_score(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "toxic",
    max_rows: int = 5000,
    max_bytes: int = 32 << 20,
) -> tuple[Filters | None, DataFrame]:
    """(model, doc_id and score of every row of ``docs``). ``learn_from`` holds for both tables. Texts are read once to train and once to score.

    The net learns from at most ``max_rows`` labelled rows of ``max_bytes`` of text together, on the driver; thresholds come from all labelled rows.
    """
    known = labels.filter(learn_from & F.col(label_col).isin(0, 1))
    usable = pin(known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label")).filter("id is not null"))
    share = min(0.75, max_rows / max(1, usable.count()))
    picked = F.broadcast(usable.filter(spread_of(F.col("id")) < share).orderBy(spread_of(F.col("id")), "id").limit(2 * max_rows))
    named = docs.filter(learn_from).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"),
    )
    held = pin(named.join(picked, "id").withColumns({"u": spread_of(F.col("id")), "t": F.xxhash64("text"), "size": F.octet_length("text") + 1}))
    sizes = held.select("u", "t", "lang", "size").orderBy("u", "t", "lang").limit(max_rows).collect()
    left, chosen = max_bytes, []
    for r in sizes:  # in the order of the hash; a text that is too large for what is left is passed over
        if r["size"] <= left:
            left -= r["size"]
            chosen.append((r["u"], r["t"]))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(sorted(set(chosen)), "u double, t long"))
    rows = held.join(wanted, ["u", "t"], "left_semi").orderBy("u", "t", "lang").limit(len(chosen)).collect() if chosen else []
    texts, y = [r["text"] for r in rows], np.array([r["label"] for r in rows], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return None, score(docs, None, id_col, text_col)
    net = train(texts, y)
    learn_languages(net, texts, [r["lang"] for r in rows])
    made = pin(margins(docs, net, id_col, text_col))
    labelled = made.join(usable.withColumnRenamed("id", "doc_id"), "doc_id").withColumn("step", F.floor(F.col("margin") / STEP))
    toxic = lambda c: F.sum((F.col("label") == c).cast("long"))
    for held in (labelled.filter(spread_of(F.col("doc_id")) >= share), labelled):  # with nothing else, the rows trained on
        seen = np.array([tuple(r) for r in held.groupBy("language", "step").agg(toxic(1).alias("t"), toxic(0).alias("c")).collect()]).reshape(-1, 4)
        if seen[:, 2].sum() and seen[:, 3].sum():
            calibrate(net, seen)
            break
    return net, scores(made, net)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, **options) -> Filters | None:
    return fit_and_score(docs, labels, learn_from, **options)[0]


def score(docs: DataFrame, model: Filters | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score."""
    return scores(margins(docs, model, id_col, text_col), model)

"""The two classifiers against naive definitions: risk, convolution, pooling, and gradients by differences."""

import numpy as np
import pytest

from loamgraph.llm import quality, toxicity
from loamgraph.llm.words import hash_words

TEXTS = ["good words here", "bad words there | there", "", None, "one", "good good bad words 123 !", "UPPER lower\nlines\n", "good words here and more of them"]


def naive_margin(net, x, i):
    z = [min(5.0, max(-5.0, (x.stats[i][k] - net.mean[k]) / net.scale[k])) for k in range(quality.STATS)]
    hidden = [max(0.0, sum(z[k] * net.w1[k][j] for k in range(len(z))) + net.b1[j]) for j in range(len(net.b1))]
    own = range(x.offsets[i], x.offsets[i + 1])
    return sum(a * b for a, b in zip(hidden, net.w2, strict=True)) + net.b2[0] + sum(net.words[x.buckets[k]] * x.weights[k] for k in own)


def naive_risk(net, x, n_pos, prior):
    """(prior * loss of positives, loss of unlabelled as negatives - prior * loss of positives as negatives)."""
    m = [naive_margin(net, x, i) for i in range(len(x))]
    loss = lambda v, y: np.log(1 + np.exp(-y * v))
    p, u = m[:n_pos], m[n_pos:]
    return prior * np.mean([loss(v, 1) for v in p]), np.mean([loss(v, -1) for v in u]) - prior * np.mean([loss(v, -1) for v in p])


@pytest.mark.parametrize(("prior", "shift"), [(0.4, 0.0), (0.95, 3.0)])
def test_risk_and_its_slopes(prior, shift):
    x, rng = quality.described(TEXTS), np.random.default_rng(4)
    net = quality.start(x, x, prior, 5, rng)
    net.words[:] = rng.normal(0, 0.3, quality.BUCKETS)
    net.b1[:], net.b2[0] = rng.normal(0, 0.1, 5), 0.2
    n_pos = 4
    if shift:  # positives far up, unlabelled far down: the bracket falls below zero
        net.w2[:] = 0
        net.words[x.buckets[: x.offsets[n_pos]]] += shift
        net.words[x.buckets[x.offsets[n_pos + 2] :]] -= 2 * shift
    assert np.allclose(net.margin_texts(TEXTS), net.margin(x), atol=1e-6)
    positive, bracket, grads = quality.slopes(net, x, n_pos, prior)
    assert np.allclose((positive, bracket), naive_risk(net, x, n_pos, prior), atol=1e-5) and (bracket < 0) == bool(shift)
    value = lambda: -naive_risk(net, x, n_pos, prior)[1] if shift else sum(naive_risk(net, x, n_pos, prior))
    for name in quality.PARAMETERS:
        flat, grad = getattr(net, name).reshape(-1), grads[name].reshape(-1)
        for k in ([*x.buckets[:12]] if name == "words" else range(min(12, len(flat)))):
            old, eps = flat[k], 1e-4
            flat[k] = old + eps
            up = value()
            flat[k] = old - eps
            down = value()
            flat[k] = old
            assert abs((up - down) / (2 * eps) - grad[k]) < 2e-4, (name, k)


def test_quality_reads_what_texts_say():
    """Two texts of one shape that say different things."""
    rng = np.random.default_rng(0)
    make = lambda words: [" ".join(rng.choice(words, 30)) for _ in range(400)]
    pos, bad = make(["alpha", "gamma", "omega"]), make(["aphla", "mamga", "meoga"])
    unl = [*make(["alpha", "gamma", "omega"])[:200], *bad]
    net = quality.fit(quality.described(pos), quality.described(unl))
    s = net.score(quality.described(["alpha gamma omega " * 10, "aphla mamga meoga " * 10]))
    assert s[0] > 0.5 > 0.3 > s[1]


def test_prior_is_the_least_ratio():
    steps = np.arange(10)
    pos, unl = np.array([0, 0, 0, 0, 0, 5, 5, 30, 30, 30]), np.array([100, 100, 100, 50, 50, 20, 20, 15, 15, 30])
    ratios = [(unl[steps >= t].sum() / 500) / (pos[steps >= t].sum() / 100) for t in steps if 50 <= pos[steps >= t].sum() <= 98]
    assert abs(quality.estimate_prior(steps, pos, unl) - min(ratios)) < 1e-12


def naive_pool(net, x, width):
    """Every window inside the text, every filter; the largest response or 0."""
    k = toxicity.WIDTHS.index(width)
    out = np.zeros(toxicity.FILTERS)
    for at in range(len(x) - width + 1):
        for f in range(toxicity.FILTERS):
            out[f] = max(out[f], net.bias[k][f] + sum(x[at + j][d] * net.weights[k][j * toxicity.DIM + d][f] for j in range(width) for d in range(toxicity.DIM)))
    return out


def naive_tox_margin(net, ids):
    x = [sum(net.table[i] for i in word) for word in ids]
    return float(np.concatenate([naive_pool(net, x, w) for w in toxicity.WIDTHS]) @ net.out + net.out_bias)


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(3)
    size = lambda *s: rng.normal(0, 0.5, s)
    weights = [size(w * toxicity.DIM, toxicity.FILTERS) for w in toxicity.WIDTHS]
    return toxicity.Filters(size(toxicity.BUCKETS, toxicity.DIM), weights, [size(toxicity.FILTERS) for _ in weights], size(len(weights) * toxicity.FILTERS), 0.3)


def test_convolution_is_the_naive_one(net):
    w = hash_words(TEXTS)
    ids = toxicity.word_ids(w)
    want = [naive_tox_margin(net, ids[a:b]) for a, b in zip(w.offsets, w.offsets[1:], strict=False)]
    assert np.allclose(net.margins(w), want, atol=1e-4)


def test_toxicity_slopes(net):
    w = hash_words(TEXTS)
    ids, g = toxicity.word_ids(w), np.linspace(-1, 1, len(TEXTS))
    x = net.embed(ids)
    h, places = net.pooled(x, w.offsets)
    grads = toxicity.slopes(net, ids, x, w.offsets, h, places, g)
    value = lambda: float(g @ net.margins(w))
    rng = np.random.default_rng(1)
    pairs = [(net.out, grads["out"]), (net.table, grads["table"])]
    pairs += list(zip(net.weights, grads["weights"], strict=True)) + list(zip(net.bias, grads["bias"], strict=True))
    for value_of, grad in pairs:
        flat, slope = value_of.reshape(-1), grad.reshape(-1)
        picked = rng.choice(np.flatnonzero(np.abs(slope) > 0), 8) if value_of is net.table else rng.integers(0, len(flat), 12)
        for k in picked:
            old, eps = flat[k], 1e-4
            flat[k] = old + eps
            up = value()
            flat[k] = old - eps
            down = value()
            flat[k] = old
            assert abs((up - down) / (2 * eps) - slope[k]) < 5e-3


def test_cut_has_the_best_f1():
    rng = np.random.default_rng(5)
    for _ in range(30):
        margin = rng.normal(0, 1, 60)
        y = margin + rng.normal(0, 1, 60) > 0.5
        steps, at = np.unique(np.floor(margin / toxicity.STEP), return_inverse=True)
        cut = toxicity.cut_of(steps, np.bincount(at, y), np.bincount(at, ~y))
        f1 = lambda c: 2 * (y & (margin >= c)).sum() / ((margin >= c).sum() + y.sum())
        assert f1(cut) >= max(f1(s * toxicity.STEP) for s in steps) - 1e-9

"""The quality classifier against plain loops: tokens, word vectors, pooled vectors, the network's training and scores."""

import math
import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from orefield.llm import quality
from orefield.llm.textnum import buffers

TEXTS = ["The cat, the dog: 12 cats!", "", "a", "über-straße 7 7 7 | | |", None, "x " * 40_000, "la la la la\n\n\tla 99", "The cat, the dog: 12 cats!"]
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+")


def bucket_of(token):
    (_, data, offsets), = buffers(pa.array([token.decode()]))
    (bucket,), _ = quality.tokens(data, offsets)
    return int(bucket)


def plain_tokens(text):
    known = {}
    return [known.setdefault(t, bucket_of(t)) if t not in known else known[t] for t in TOKEN.findall((text or "").encode())]


def plain_vectors(texts, seed):
    index, out = quality.index_vectors(seed).astype(float), np.zeros((quality.BUCKETS, quality.DIMS))
    for found in map(plain_tokens, texts):
        for i, word in enumerate(found):
            for j in range(max(i - quality.WINDOW, 0), min(i + quality.WINDOW + 1, len(found))):
                if i != j:
                    out[word] += index[found[j]]
    return np.array([v / max(math.sqrt((v * v).sum()), 1) for v in out])


def plain_pooled(text, vectors):
    found = [vectors[b] for b in plain_tokens(text)]
    if not found:
        return np.zeros(2 * quality.DIMS + 1)
    mean = sum(found) / len(found)
    square = sum(v * v for v in found) / len(found)
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), [square.sum()]])


def columns(texts):
    return list(buffers(pa.array(texts, pa.string())))


def test_tokens_and_word_vectors_against_loops():
    texts = [t or "" for t in TEXTS]
    bucket, row = [], []
    for first, data, offsets in columns(texts):
        b, r = quality.tokens(data, offsets)
        bucket.append(b)
        row.append(r + first)
    bucket, row = np.concatenate(bucket), np.concatenate(row)
    for i, t in enumerate(texts):
        assert bucket[row == i].tolist() == plain_tokens(t)
    assert np.allclose(quality.word_vectors(bucket, row, 3), plain_vectors(texts, 3), atol=1e-5)


def test_pooled_vectors_against_loops(monkeypatch):
    monkeypatch.setattr(quality, "SLICE", 7)  # texts of more tokens than a slice, and slices of several texts
    vectors = np.random.default_rng(2).normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    texts = [(t or "")[:400] for t in TEXTS]
    got = np.concatenate([quality.pooled(data, offsets, vectors) for _, data, offsets in columns(texts)])
    assert np.allclose(got, [plain_pooled(t, vectors.astype(float)) for t in texts], atol=1e-3)


def loss(params, x, y):
    w1, b1, w2, b2 = params
    total = 0.0
    for row, label in zip(x, y):
        h = [math.tanh(sum(row[k] * w1[k][j] for k in range(len(row))) + b1[j]) for j in range(len(b1))]
        z = sum(h[j] * w2[j] for j in range(len(h))) + b2[0]
        total += math.log1p(math.exp(-z)) if label else math.log1p(math.exp(z))
    return total / len(x) + 0.5e-4 * (np.square(w1).sum() + np.square(w2).sum())


def test_training_follows_the_slope_of_the_loss():
    """Each step is Adam's by slopes that finite differences of the plain loss give; the temperature is the best of its grid on rows left out."""
    random_ = np.random.default_rng(4)
    x, y = random_.normal(size=(24, 3)), random_.integers(0, 2, 24)
    mean, std, w1, b1, w2, b2, temperature = quality.train_network(x, y, 5, hidden=2, epochs=6)
    assert np.allclose(mean, x.mean(0)) and np.allclose(std, x.std(0) + 1e-4)
    z = np.clip((x - mean) / std, -8, 8)
    late = np.arange(24) % 4 == 3
    start = np.random.default_rng(5)
    params = [start.normal(0, 3**-0.5, (3, 2)), np.zeros(2), start.normal(0, 2**-0.5, 2), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, 7):
        slopes = []
        for p in params:
            slope = np.zeros_like(p)
            for at in np.ndindex(p.shape):
                kept, sides = p[at], []
                for by in (1e-5, -1e-5):
                    p[at] = kept + by
                    sides.append(loss(params, z[~late], y[~late]))
                p[at] = kept
                slope[at] = (sides[0] - sides[1]) / 2e-5
            slopes.append(slope)
        for p, g, m, v in zip(params, slopes, first, second):
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.999 * v + 0.001 * g * g
            p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    for got, want in zip((w1, b1, w2, b2), (*params[:3], params[3][0])):
        assert np.allclose(got, want, atol=1e-5)

    def left_out(t):
        total = 0.0
        for row, label in zip(z[late], y[late]):
            out = (np.tanh(row @ w1 + b1) @ w2 + b2) / t
            total += math.log1p(math.exp(-out if label else out))
        return total

    assert left_out(temperature) <= min(left_out(0.25 * 32 ** (i / 59)) for i in range(60)) + 1e-9


def test_whole_score_against_loops():
    rng = random.Random(3)
    vectors = np.random.default_rng(7).normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    size = 2 * quality.DIMS + 1
    draw = np.random.default_rng(8).normal
    model = quality.QualityModel(vectors, draw(size=size), np.abs(draw(size=size)) + 0.1, draw(size=(size, 4)), draw(size=4), draw(size=4), 0.3, 1.7)
    texts = [" ".join(rng.choice(["oak", "elm", "42", "|", "née"]) for _ in range(rng.randrange(30))) for _ in range(40)] + ["", "oak"]
    got = np.concatenate([model.score(quality.pooled(data, offsets, vectors)) for _, data, offsets in columns(texts)])
    for score, text in zip(got, texts):
        x = [min(max((v - m) / s, -8), 8) for v, m, s in zip(plain_pooled(text, vectors.astype(float)), model.mean, model.std)]
        h = [math.tanh(sum(v * w for v, w in zip(x, model.w1[:, j])) + model.b1[j]) for j in range(4)]
        z = (sum(a * b for a, b in zip(h, model.w2)) + model.b2) / model.temperature
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-3


def test_training_holds_the_tokens_of_one_part_of_the_texts(monkeypatch):
    """6 MB of texts: tokens of all of them at once would take ten times as much of the driver's memory."""
    rng = np.random.default_rng(2)
    words = np.array([f"w{i}" for i in range(400)])
    texts = [" ".join(words[rng.integers(0, 400, 4000)]) for _ in range(320)]
    table = pa.table({"doc_id": list(range(320)), "text_hash": [0] * 320, "text": texts, "quality": [i % 2 for i in range(320)]})
    monkeypatch.setattr(quality, "training_rows", lambda *_: SimpleNamespace(toArrow=lambda: table))
    quality.tokens(*columns(texts[:30])[0][1:])  # tables of powers stay
    tracemalloc.start()
    try:
        model = quality.fit_quality(None, None)
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
    parts = [quality.tokens(data, offsets) for _, data, offsets in columns(texts)]
    rows = np.concatenate([r + at for (_, r), (at, *_) in zip(parts, columns(texts))])
    assert np.array_equal(model.vectors, quality.word_vectors(np.concatenate([b for b, _ in parts]), rows, 11))

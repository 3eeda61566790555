"""What enters the toxicity curve: against sums over words, in blocks of long texts, and where classes lie far apart."""

import re

import numpy as np

from framequarry.llm import kneser_ney
from framequarry.llm.ppm import _grams


def model():
    rng = np.random.default_rng(3)
    texts = [b" ".join(rng.choice([b"good", b"bad", b"ugly", b"Worse", b"words", b"and", "äöü".encode()], 300)) for _ in range(2)]
    counts = []
    for t in texts:
        counts.append(np.unique(_grams(kneser_ney._FOLD[np.frombuffer(t, np.uint8)], np.array([0, len(t)]), 5)[0], return_counts=True))
    keys = np.union1d(counts[0][0], counts[1][0])
    n = np.zeros((len(keys), 2))
    for c, (k, m) in enumerate(counts):
        n[np.searchsorted(keys, k), c] = m
    return kneser_ney.Model(keys, n, 5, np.ones(1 << 24, bool))


def test_features_are_sums_over_words(monkeypatch):
    m = model()
    texts = [b"bad, good; ugly", b"", b"...", b"one", "And äöü worse-words x1 bad bad bad".encode(), b"good " * 400 + b"ugly" * 30 + b" bad"]
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = m.features(buf, offs)
    for t, f in zip(texts, got, strict=True):
        r = m._ratios(np.frombuffer(t, np.uint8), np.array([0, len(t)])) if t else np.zeros(0)
        words = sorted((r[x.start() : x.end()].sum() for x in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", t)), reverse=True)
        n = max(1, len(t))
        assert np.allclose(f, [r.sum() / n, r.sum() / np.sqrt(n), words[0] if words else 0, np.mean(words[:3]) if words else 0, np.log1p(len(words)), 1])
    monkeypatch.setattr(kneser_ney, "BLOCK", 50)
    long = texts[-1]
    assert np.allclose(m.features(np.frombuffer(long, np.uint8), np.array([0, len(long)]))[0, :2], got[-1, :2])
    spaced = b"good bad ugly and words " * 20
    blocks = m.features(np.frombuffer(spaced, np.uint8), np.array([0, len(spaced)]))
    monkeypatch.setattr(kneser_ney, "BLOCK", 1 << 20)
    assert np.allclose(blocks, m.features(np.frombuffer(spaced, np.uint8), np.array([0, len(spaced)])))


def test_classes_far_apart_have_a_curve_between_them():
    rng = np.random.default_rng(1)
    z = np.r_[rng.normal([20, 17, 5], 1, (80, 3)), rng.normal([3, 2, 5], 1, (340, 3))]
    z = np.c_[z, z[:, 0] * 0.9 + rng.normal(0, 0.1, 420), np.ones(420)]
    y = np.r_[np.ones(80), np.zeros(340)]
    p = z @ kneser_ney._logistic(z, y)
    assert ((p > 0) == (y > 0)).all()

"""A training step costs the same few calls however many classes it meets, and moves what a plain sum over its tokens moves."""

import numpy as np

from plumbline.llm import language_model as lm


def made(units: int = 900, n: int = 700):
    rng = np.random.default_rng(3)
    model = lm.LogBilinear(np.sort(rng.integers(1, 500, units))[::-1].astype(float))
    tokens = np.minimum(rng.geometric(0.01, n), units) - 1
    return model, tokens, rng.integers(0, units, (n, lm.CONTEXT))


def test_a_step_does_not_go_class_by_class(monkeypatch):
    model, tokens, before = made()
    assert len(np.unique(model.class_of[tokens])) > 10
    calls, own = [], lm.logistic
    monkeypatch.setattr(lm, "logistic", lambda x: calls.append(x.shape) or own(x))
    model.step(tokens, before, np.random.default_rng(1))
    assert len(calls) <= 4


def test_a_step_sums_over_its_tokens():
    """Against loops over tokens and noise in double precision, with the same draws."""
    model, tokens, before = made()
    plain = {name: getattr(model, name).astype(float) for name in model.NAMES}
    d, rng = lm.DIMENSION, np.random.default_rng(1)
    model.step(tokens, before, rng)
    rng = np.random.default_rng(1)
    noise = rng.choice(len(model.chance), lm.CLASS_NOISE, p=model.chance)
    here = np.unique(model.class_of[tokens])
    drawn = {}
    for k, u in zip(here.tolist(), rng.random((len(here), lm.NOISE)), strict=True):
        low, high = model.sums[k * model.width], model.sums[min((k + 1) * model.width, model.size)]
        drawn[k] = np.searchsorted(model.sums, low + u * (high - low), side="right") - 1
    slopes = {name: np.zeros_like(x) for name, x in plain.items()}
    s = lambda x: 1 / (1 + np.exp(-x))
    for t, b in zip(tokens.tolist(), before.tolist(), strict=True):
        c = int(model.class_of[t])
        m = [plain["matrices"][j * d : (j + 1) * d] for j in range(lm.CONTEXT)]
        h = np.append(sum(plain["context"][x] @ m[j] for j, x in enumerate(b)), 1.0)
        low, high = model.sums[c * model.width], model.sums[min((c + 1) * model.width, model.size)]
        away = np.zeros(d)
        for name, row, chance, right in [("classes", c, lm.CLASS_NOISE * model.chance[c], 1), *(("classes", k, lm.CLASS_NOISE * model.chance[k], 0) for k in noise.tolist()),
                                         ("unit", t, lm.NOISE * model.weights[t] / (high - low), 1), *(("unit", u, lm.NOISE * model.weights[u] / (high - low), 0) for u in drawn[c].tolist())]:
            g = right - s(h @ plain[name][row] - np.log(chance))
            slopes[name][row] += g * h
            away += g * plain[name][row][:-1]
        for j, x in enumerate(b):
            slopes["context"][x] += m[j] @ away
            slopes["matrices"][j * d : (j + 1) * d] += np.outer(plain["context"][x], away)
    for name, g in slopes.items():
        assert np.allclose(getattr(model, name), plain[name] + lm.RATE * g / np.sqrt(1e-4 + g * g), atol=2e-3), name


def test_noise_is_summed_once(monkeypatch):
    """Slopes of noise units go to the sums of rows group by group: no sums by class before (``reduceat`` of three axes takes longest of all)."""
    model, tokens, before = made()

    class Watched:
        def __getattr__(self, name):
            return getattr(np, name)

        class add:
            @staticmethod
            def reduceat(x, *a, **k):
                assert x.ndim < 3
                return np.add.reduceat(x, *a, **k)

    monkeypatch.setattr(lm, "np", Watched())
    model.step(tokens, before, np.random.default_rng(1))


def test_shares_of_large_products():
    """An exponential that overflows, or all that vanish, do not spoil the logarithms."""
    h, columns = np.array([[200.0], [1.0], [-300.0]], dtype=np.float32), np.array([[1.0, 0.5]], dtype=np.float32)
    found = lm.log_share(h, columns, np.array([0, 1, 1]))
    s = h.astype(float) @ columns.astype(float)
    plain = s - s.max(axis=1, keepdims=True)
    plain = plain - np.log(np.exp(plain).sum(axis=1, keepdims=True))
    assert np.allclose(found, plain[[0, 1, 2], [0, 1, 1]], atol=1e-5)

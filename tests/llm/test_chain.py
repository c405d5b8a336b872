"""Op 2's fitting, against plain gradients fold by fold."""

import numpy as np
import pytest

from tapewright.llm import toxicity


def made(seed=3, n=240):
    """Texts of a few words, of which some speak for one label or the other, and two statistics."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2, n).astype(float)
    b = np.where(rng.random(n) < 0.8, a, rng.integers(0, 2, n)).astype(float)
    pairs = {(i, int(w)) for i in range(n) for w in rng.integers(1, 30, 6)}
    pairs |= {(i, 100) for i in range(n) if a[i] and rng.random() < 0.7} | {(i, 101) for i in range(n) if b[i] and rng.random() < 0.7}
    doc, word = map(np.array, zip(*sorted(pairs)))
    return word.astype(np.uint64), doc.astype(np.int64), rng.normal(size=(n, 2)) + a[:, None], [a, b], np.arange(n) % 4


def gradient(model, w_hash, w_doc, dense, y, ridge=1.0):
    """Of the penalized log likelihood in each weight, by plain loops."""
    rows = []
    for i in range(len(y)):
        words = {int(w) for w, d in zip(w_hash, w_doc) if d == i}
        rows.append([float(int(w) in words) for w in model.words] + [float(np.clip((v - c) / s, -6, 6)) for v, c, s in zip(dense[i], model.centre, model.spread)] + [1.0])
    beta = [*model.weight, *model.dense, model.bias]
    p = [1 / (1 + np.exp(-sum(a * b for a, b in zip(r, beta)))) for r in rows]
    return [sum(r[k] * (t - q) for r, t, q in zip(rows, y, p)) - (1e-6 if k == len(beta) - 1 else ridge) * beta[k] for k in range(len(beta))]


def test_a_fit_ends_where_the_gradient_is_zero():
    w_hash, w_doc, dense, (y, _), _ = made()
    model = toxicity.fit(w_hash, w_doc, dense, y)
    assert 100 in model.words.tolist()
    assert max(map(abs, gradient(model, w_hash, w_doc, dense, y))) < 1e-3


def test_later_models_learn_from_folds_that_did_not_see_the_row(monkeypatch):
    w_hash, w_doc, dense, targets, fold = made()
    calls, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda h, d, x, y, *a: calls.append((x.copy(), y.copy())) or fit(h, d, x, y, *a))
    toxicity.fit_chain(w_hash, w_doc, dense, targets, fold)
    assert len(calls) == 10  # four folds and the whole, for each label
    fed = calls[9][0][:, -1]
    for f in range(4):
        rows, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        number = {int(i): k for k, i in enumerate(rows)}
        use = np.isin(w_doc, rows)
        model = fit(w_hash[use], np.array([number[int(d)] for d in w_doc[use]]), dense[rows], targets[0][rows])
        for i in held:
            mine = {int(w) for w, d in zip(w_hash, w_doc) if d == i}
            z = sum(w for h, w in zip(model.words.tolist(), model.weight) if h in mine) + model.bias
            z += sum(float(np.clip((v - c) / s, -6, 6)) * w for v, c, s, w in zip(dense[i], model.centre, model.spread, model.dense))
            assert fed[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    turned = [np.where(fold == 2, 1 - targets[0], targets[0]), targets[1]]
    calls.clear()
    toxicity.fit_chain(w_hash, w_doc, dense, turned, fold)
    other = calls[9][0][:, -1]
    assert np.allclose(other[fold == 2], fed[fold == 2]) and not np.allclose(other[fold != 2], fed[fold != 2])

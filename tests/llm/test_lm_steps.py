import numpy as np

from tessera.llm import lbl_lm as lm


def test_sums_hold_only_entries_that_occur():
    rng = np.random.default_rng(1)
    at, rows = rng.integers(0, 50, 400) * 7, rng.normal(size=(400, 5)).astype(np.float32)
    where, sums = lm._row_sums(at, rows)
    assert where.tolist() == sorted(set(at.tolist()))
    whole = np.zeros((350, 5))
    np.add.at(whole, at, rows)
    assert np.allclose(sums, whole[where], atol=1e-5)


def test_a_step_leaves_other_entries_and_their_sums_alone():
    model = lm.Model(np.ones(300 + lm.RARE + 1))
    start = {n: p.copy() for n, p in model.params.items()}
    texts = [np.array([1, 2, 3, model.end], "<i2")] * 5
    model.train(texts, 1, 1, 0.1, 3)
    moved = np.flatnonzero((model.params["vectors"] != start["vectors"]).any(1))
    assert set(moved.tolist()) <= {1, 2, 3, model.end}


def test_products_known_to_be_small_need_no_look():
    rng = np.random.default_rng(2)
    z, at = rng.normal(size=(40, 9)).astype(np.float32), rng.integers(0, 9, 40)
    assert np.array_equal(lm._chosen(z.copy(), at, True), lm._chosen(z.copy(), at))
    wide = lm.Model(np.ones(300 + lm.RARE + 1))
    wide.params["targets"] += 40
    wide.params["vectors"] += 40
    entries, places = wide.lay_out([np.array([1, 2, wide.end], "<i2")])
    assert np.isfinite(wide.log_probabilities(entries, places)).all()


def slow_steps(model, texts, rate, seed):
    """Model.train() for one batch, as its formulas say, in float64."""
    entries, at = model.lay_out(texts)
    rng = np.random.default_rng(seed)
    rng.shuffle(at)
    p = {n: x.astype(float) for n, x in model.params.items()}
    now = entries[at].astype(int)
    context = [entries[at - i - 1].astype(int) for i in range(lm.CONTEXT)]
    vectors = [p["vectors"][c] for c in context]
    hidden = sum(v @ m for v, m in zip(vectors, p["places"]))
    grads, back = {n: np.zeros_like(x) for n, x in p.items()}, 0
    for vec, bias, share, k, true in (("targets", "bias", model.share, lm.NOISE, now), ("class_targets", "class_bias", model.class_share, lm.CLASS_NOISE, model.class_of[now])):
        noise = np.minimum(np.searchsorted(np.cumsum(share), rng.random(k)), len(share) - 1)
        shift = np.log(k * share)
        miss = 1 / (1 + np.exp(-((hidden * p[vec][true]).sum(1) + (p[bias] - shift)[true]))) - 1
        fooled = 1 / (1 + np.exp(-(hidden @ p[vec][noise].T + (p[bias] - shift)[noise])))
        np.add.at(grads[vec], true, miss[:, None] * hidden)
        np.add.at(grads[vec], noise, fooled.T @ hidden)
        np.add.at(grads[bias], true, miss)
        np.add.at(grads[bias], noise, fooled.sum(0))
        back = back + miss[:, None] * p[vec][true] + fooled @ p[vec][noise]
    grads["places"] = np.stack([v.T @ back for v in vectors])
    for c, m in zip(context, p["places"]):
        np.add.at(grads["vectors"], c, back @ m.T)
    return {n: p[n] - rate * (g := grads[n] / len(at)) / np.sqrt(1e-6 + g * g) for n in p}


def test_a_step_and_probabilities_are_those_of_the_formulas(monkeypatch):
    rng = np.random.default_rng(4)
    model = lm.Model(rng.integers(1, 50, 300 + lm.RARE + 1))
    for n in ("targets", "class_targets"):
        model.params[n] += rng.normal(0, 0.5, model.params[n].shape).astype(np.float32)
    texts = [rng.integers(0, model.size, 40).astype("<i2") for _ in range(30)]
    expected = slow_steps(model, texts, 0.1, 3)
    model.train(texts, 1, 1, 0.1, 3)
    for n, p in expected.items():
        assert np.abs(model.params[n] - p).max() < 2e-3, n
    monkeypatch.setattr(lm, "BATCH", 100)
    entries, at = model.lay_out(texts)
    p = {n: x.astype(float) for n, x in model.params.items()}
    _, _, hidden = model.hidden(entries, at)
    found = model.log_probabilities(entries, at)
    for row, (h, e) in enumerate(zip(hidden.astype(float), entries[at])):
        c = model.class_of[e]
        of_class, own = h @ p["class_targets"].T + p["class_bias"], (h @ p["targets"].T + p["bias"])[model.starts[c] : model.ends[c]]
        one = of_class[c] - np.log(np.exp(of_class).sum()) + own[e - model.starts[c]] - np.log(np.exp(own).sum())
        assert abs(found[row] - one / np.log(10)) < 1e-4


def test_rows_with_a_column_for_the_bias():
    rows = np.arange(6, dtype=np.float32).reshape(3, 2)
    assert lm._wide(rows, rows[:, 0]).tolist() == [[0, 1, 0], [2, 3, 2], [4, 5, 4]]

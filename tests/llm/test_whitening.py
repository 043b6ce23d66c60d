"""Embedding whitening: the incremental eigendecomposition and the query against dense linear algebra."""

import numpy as np
import pytest

from flowlab.llm import whitening


def sets():
    rng = np.random.default_rng(0)
    yield "normal", rng.normal(size=(400, 24)) * 256
    yield "repeated", np.floor(rng.normal(size=(300, 8)) * 1.3) * 200
    yield "low rank", rng.normal(size=(200, 3)) @ rng.normal(size=(3, 16)) * 100
    yield "scales", rng.normal(size=(300, 10)) * np.logspace(-3, 4, 10) + 1e5
    yield "one axis", np.outer(np.arange(50.0), np.eye(6)[2])
    yield "two", rng.normal(size=(2, 5))
    yield "constant", np.ones((9, 4)) * 7


@pytest.mark.parametrize(("name", "x"), list(sets()))
def test_spectrum_equals_dense(name, x):
    centred = x - x.mean(0)
    scatter = centred.T @ centred
    size = max(np.abs(scatter).max(), 1.0)
    whole = whitening.Spectrum(x.shape[1])
    for v in x:
        whole.add(v)
    parts = [whitening.Spectrum(x.shape[1]) for _ in range(3)]
    for i, v in enumerate(x):
        parts[i % 3].add(v)
    for p in parts[1:]:
        parts[0].merge(p)
    batches = whitening.Spectrum(x.shape[1])
    for at in range(0, len(x), 90):
        batches.add_all(x[at:at + 90])
    for s in (whole, parts[0], batches):
        assert s.n == len(x) and np.allclose(s.mean, x.mean(0))
        assert np.abs(s.vec.T @ s.vec - np.eye(x.shape[1])).max() < 1e-12
        assert np.abs(s.vec * s.val @ s.vec.T - scatter).max() < 1e-11 * size
        assert (np.diff(s.val) >= 0).all()


def test_secular_roots_interlace_and_solve():
    rng = np.random.default_rng(1)
    for k in (2, 5, 40):
        d = np.sort(rng.normal(size=k)) + np.arange(k) * 1e-6
        w = rng.random(k) * np.logspace(0, -8, k) + 1e-12
        origin, shift = whitening.secular(d, w)
        x = d[origin] + shift
        want = np.linalg.eigvalsh(np.diag(d) + np.sqrt(np.outer(w, w)))
        assert np.allclose(x, want, rtol=0, atol=1e-13 * (np.abs(want).max() + 1))
        assert (x[:-1] <= d[1:]).all() and (x >= d).all()


def plain(ids, vectors, components=4):
    x = np.floor(np.array(vectors, float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    value, axes = np.linalg.eigh(c.T @ c / n)
    value, axes = value[::-1], axes[:, ::-1]
    out = {}
    for i, v in zip(ids, x):
        for k in range(components):
            out[i, k + 1] = (n, int(((n * v - s) ** 2).sum()), abs(float((v - s / n) @ axes[:, k] / np.sqrt(value[k]))), value[k] / value.sum())
    return out


def test_whiten_equals_dense(spark, monkeypatch):
    monkeypatch.setattr(whitening, "UNIT", 16)  # 20 spectra in two levels
    monkeypatch.setattr(whitening, "FAN", 6)
    monkeypatch.setattr(whitening, "BATCH", 10)
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7))).astype("float32")
    v = np.concatenate([v, np.repeat(v[:1], 100, 0)])  # a hot vector counts once in the fit
    rows = [(i, [float(e) for e in row], "x", 0) for i, row in enumerate(v)]
    rows += [(900, None, "x", 0), (901, [1.0, None] + [0.0] * 5, "x", 0), (902, [float("nan")] * 7, "x", 0), (903, [float("-inf")] * 7, "x", 0),
             (904, [], "x", 0), (905, [1.0, 2.0], "x", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, n int")
    got = whitening.whiten(df).collect()
    want = plain(range(400), v)
    assert {(r["id"], r["component"]) for r in got} == set(want) and len(got) == 1600
    for r in got:
        n, deviation, w, explained = want[r["id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(abs(r["whitened"]) - w) < 1e-9 and abs(r["explained"] - explained) < 1e-12 and r["identity_error"] < 1e-9
    same = [[r["whitened"] for r in sorted(got, key=lambda r: r["component"]) if r["id"] == i] for i in (0, 300, 399)]
    assert same[0] == same[1] == same[2]


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0  # one vector: no variance
    flat = whitening.whiten(spark.createDataFrame([(None, [1.0, 5.0, 2.0]), (None, [1.0, 5.0, 4.0]), (3, [1.0, 5.0, 9.0])], kind)).collect()
    assert len(flat) == 3 and {r["component"] for r in flat} == {1} and {r["explained"] for r in flat} == {1.0}
    # exact beyond the range of doubles, null beyond that of longs
    wide = {r["id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame([(1, [4e6]), (2, [1.0]), (3, [0.0])], kind)).collect()}
    x = [1024000000, 256, 0]
    assert wide == {i + 1: (3 * v - sum(x)) ** 2 for i, v in enumerate(x)}
    assert {r["deviation"] for r in whitening.whiten(spark.createDataFrame([(1, [4e9]), (2, [-4e9])], kind)).collect()} == {None}

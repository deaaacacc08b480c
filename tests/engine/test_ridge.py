import numpy as np
import pytest

from tonewright.operators.ridge import ALPHAS, products, ridge


def table(spark, n=60, d=4, seed=1, weights=False):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * [1, 10, 0.1, 3] + [0, 100, 5, -2]
    y = x @ [1.0, -0.2, 3.0, 0.0] + r.normal(size=n)
    w = r.integers(1, 5, n) if weights else np.ones(n, int)
    return x, y, w, spark.createDataFrame([(list(map(float, a)), float(b), int(c)) for a, b, c in zip(x, y, w, strict=True)], "x array<double>, y double, w int").repartition(3)


def fitted(x, y, w, alpha):
    """Closed form with a column that is not punished."""
    z = np.c_[np.ones(len(y)), x]
    p = np.diag([0.0] + [alpha] * x.shape[1])
    return np.linalg.solve(z.T @ (z * w[:, None]) + p, z.T @ (w * y))


@pytest.mark.parametrize("weights", [False, True])
def test_equals_the_closed_form_and_refitting(spark, weights):
    x, y, w, df = table(spark, weights=weights)
    got = ridge(df, weight="w")
    errors = {}
    for a in ALPHAS:
        e = [y[k] - np.r_[1, x[k]] @ fitted(np.delete(x, k, 0), np.delete(y, k), np.delete(w, k), a) for k in range(len(y))]
        errors[a] = float((w * np.square(e)).sum() / w.sum())
        assert np.isclose(got.errors[a], errors[a], rtol=1e-6)
    assert got.alpha == min(errors, key=errors.get)
    want = fitted(x, y, w, got.alpha)
    assert np.allclose(np.r_[got.intercept, got.weights], want, rtol=1e-6, atol=1e-8)
    said = got.transform(df).collect()
    assert np.allclose([r.prediction for r in said], [np.r_[1, r.x] @ want for r in said])


def test_sums(spark):
    x, y, w, df = table(spark, weights=True)
    z = np.c_[np.ones(len(y)), x, y]
    want = z.T @ (z * w[:, None])
    got = {(r.i, r.j): r.s for r in products(df, weight="w").collect()}
    assert len(got) == 21 and all(np.isclose(v, want[k]) for k, v in got.items())


def test_nulls_constants_and_no_rows(spark):
    rows = [([1.0, 7.0], 1.0, 1), ([2.0, 7.0], 2.0, 1), ([3.0, 7.0], 3.0, 2), ([None, 7.0], 9.0, 1), (None, 9.0, 1), ([1.0, 1.0], None, 1), ([1.0, 1.0], 9.0, 0), ([1.0, 1.0], 9.0, None)]
    df = spark.createDataFrame(rows, "x array<double>, y double, w int")
    got = ridge(df, (1e-9,), weight="w")
    assert np.allclose(got.weights, [1, 0], atol=1e-6) and np.isclose(got.intercept, 0, atol=1e-6)
    none = ridge(df.where("false"))
    assert [r.prediction for r in none.transform(df.where("y = 1")).collect()] in ([None], [0.0]) and none.alpha == ALPHAS[0]
    assert ridge(df.where("y = 1"), weight="w").intercept == 1.0

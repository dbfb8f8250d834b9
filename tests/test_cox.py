import numpy as np
import pytest

from hazardline.operators.cox import fit_cox


def reference_fit(x, t, e, steps=30):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        w = np.exp(x @ beta)
        g, h = np.zeros(len(beta)), np.zeros((len(beta),) * 2)
        for i in np.flatnonzero(e):
            risk = t >= t[i]
            m = (w[risk, None] * x[risk]).sum(0) / w[risk].sum()
            g += x[i] - m
            h += (w[risk, None, None] * x[risk][:, :, None] * x[risk][:, None, :]).sum(0) / w[risk].sum() - np.outer(m, m)
        beta = beta + np.linalg.solve(h, g)
    return beta


@pytest.mark.parametrize("per_range", [100_000, 15])
@pytest.mark.parametrize("hot", [0, 60])
def test_equals_direct_newton(spark, per_range, hot):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 3)) * [1, 10, 0.1]
    t = np.round(rng.exponential(1 / np.exp(0.8 * x[:, 0] - 0.05 * x[:, 1])), 1)
    t[:hot] = 0.7  # one time over several ranges
    e = rng.random(150) < 0.7
    rows = [([float(v) for v in x[i]], float(t[i]), int(e[i])) for i in range(150)]
    df = spark.createDataFrame(rows, "f array<double>, t double, e int")
    model = fit_cox(df, "f", "t", "e", 3, ridge=0.0, rows_per_range=per_range)
    assert model.beta == pytest.approx(reference_fit(x, t, e), rel=1e-4)
    assert model.gradient < 1e-6
    got = [r[0] for r in df.select(model.score_column("f")).collect()]
    assert got == pytest.approx(list((x - x.mean(0)) @ model.beta))


def test_no_events(spark):
    df = spark.createDataFrame([([1.0], 1.0, 0), ([2.0], 2.0, 0)], "f array<double>, t double, e int")
    with pytest.raises(ValueError, match="no events"):
        fit_cox(df, "f", "t", "e", 1)


def test_missing_values_and_unfinished_fits_are_errors(spark):
    schema = "f array<double>, t double, e int"
    rows = [([float(i % 3), float(i)], float(i % 5), i % 2) for i in range(20)]
    for bad in [([1.0, None], 1.0, 1), ([1.0], 1.0, 1), (None, 1.0, 1), ([1.0, 2.0], None, 1), ([1.0, 2.0], 1.0, None)]:
        with pytest.raises(ValueError, match="1 rows lack"):
            fit_cox(spark.createDataFrame([*rows, bad], schema), "f", "t", "e", 2)
    with pytest.raises(ValueError, match="not converged after 1 steps"):
        fit_cox(spark.createDataFrame(rows, schema), "f", "t", "e", 2, max_steps=1, tolerance=1e-12)


def test_very_large_scores_do_not_overflow(spark):
    rows = [([float(i)], float(40 - i), int(i % 4 != 0)) for i in range(40)]
    model = fit_cox(spark.createDataFrame(rows, "f array<double>, t double, e int"), "f", "t", "e", 1, ridge=1e-4, rows_per_range=7)
    assert model.beta[0] > 0 and np.isfinite(model.log_likelihood)

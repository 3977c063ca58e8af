"""Methods for tables with gaps against row-by-row arithmetic."""

import numpy as np
import pytest

from tablewise.operators import gap_patterns, imputation, missingness


def table(spark, x, names, parts=6):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["id long", *[f"{c} double" for c in names]])).repartition(parts)


def gappy(rows, width, share, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, width)) @ rng.normal(size=(width, width)) + 5 * rng.normal(size=width)
    holes = rng.uniform(size=x.shape) < share
    holes[:, 0] = False
    return np.where(holes, np.nan, x)


def chained(x, rounds):
    """Row by row: medians, then each column with gaps from the others, fewest gaps first."""
    names = [f"c{i}" for i in range(x.shape[1])]
    mean, scale = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    holes = np.isnan(x)
    z = np.where(holes, np.nanmedian(x, axis=0), x)
    z = (z - mean) / scale
    for _ in range(rounds):
        for c in sorted((i for i in range(x.shape[1]) if holes[:, i].any()), key=lambda i: (holes[:, i].sum(), names[i])):
            others = [i for i in range(x.shape[1]) if i != c]
            a = np.column_stack([np.ones(len(z)), z[:, others]])
            fit = a[~holes[:, c]]
            penalty = np.diag([0.0] + [imputation.RIDGE * len(fit)] * len(others))
            beta = np.linalg.solve(fit.T @ fit + penalty, fit.T @ z[~holes[:, c], c])
            z[holes[:, c], c] = a[holes[:, c]] @ beta
    return z * scale + mean


@pytest.mark.parametrize(("rows", "width", "share", "held"), [(400, 4, 0.15, 4_000_000), (300, 12, 0.3, 500), (60, 3, 0.5, 50)])
def test_chained_fill_equals_row_by_row(spark, monkeypatch, rows, width, share, held):
    monkeypatch.setattr(gap_patterns, "HELD", held)
    x = gappy(rows, width, share)
    names = [f"c{i}" for i in range(width)]
    out = imputation.fill_iterative(table(spark, x, names).selectExpr("*", "'keep' AS note"), names, rounds=10)
    assert out.columns == ["id", *names, "note"]
    got = out.toPandas().sort_values("id")
    assert np.allclose(got[names].to_numpy(), chained(x, 10), atol=1e-7)


def test_columns_without_values_and_not_a_number(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, None, float("nan")), (3.0, None, 6.0), (4.0, None, None)], "a double, b double, c double")
    got = imputation.fill_iterative(df, ["a", "b", "c"]).toPandas().sort_values("a")
    assert got["b"].isna().all() and np.allclose(got["c"], [2, 4, 6, 8], atol=1e-3)
    assert imputation.fill_iterative(df.where("false"), ["a"]).count() == 0


def test_folded_table_keeps_all_products(spark):
    x = gappy(500, 5, 0.3)
    x[7] = np.nan
    df = table(spark, x, "abcde")
    rows = gap_patterns.folded(df, list("abcde"), np.zeros(5), np.ones(5)).collect()
    assert sum(r.n for r in rows) == 500 and len({bytes(r.pattern) for r in rows}) == len(rows) == len({tuple(np.isnan(v)) for v in x})
    for r in rows:
        has = gap_patterns.present(bytes(r.pattern), 5)
        own = x[(~np.isnan(x) == np.isin(np.arange(5), has)).all(axis=1)]
        given = np.column_stack([np.ones(len(own)), own[:, has]])
        factor = np.frombuffer(r.factor).reshape(-1, len(has) + 1)
        assert len(factor) <= len(has) + 3 and np.allclose(factor.T @ factor, given.T @ given)


def test_likely_moments_in_closed_form(spark):
    """Of two columns of which one is whole, the maximum-likelihood moments have a formula."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=900)
    b = 2 * a + rng.normal(size=900) + 1
    there = (a + rng.normal(size=900)) < 0.4
    df = table(spark, np.column_stack([a, np.where(there, b, np.nan)]), "ab")
    mean, cov = missingness.likely_moments(gap_patterns.folded(df, ["a", "b"], np.zeros(2), np.ones(2)), 2)
    slope = np.cov(a[there], b[there], bias=True)[0, 1] / a[there].var()
    rest = (b[there] - b[there].mean() - slope * (a[there] - a[there].mean())).var()
    assert np.allclose(mean, [a.mean(), b[there].mean() + slope * (a.mean() - a[there].mean())], atol=1e-5)
    assert np.allclose(cov, [[a.var(), slope * a.var()], [slope * a.var(), rest + slope**2 * a.var()]], atol=1e-5)
    got = missingness.little_test(df, ["a", "b"]).first()
    gaps = [a[there].mean() - mean[0], b[there].mean() - mean[1]]
    stat = there.sum() * np.array(gaps) @ np.linalg.solve(cov, gaps) + (~there).sum() * (a[~there].mean() - mean[0]) ** 2 / cov[0, 0]
    assert got.statistic == pytest.approx(stat, rel=1e-4) and got.dof == 1 and got.patterns == 2 and not got.is_mcar


def test_thirty_columns_with_gaps(spark):
    x = gappy(300, 30, 0.02, seed=9)
    got = missingness.little_test(table(spark, x, [f"c{i}" for i in range(30)]).drop("id")).first()
    seen = {tuple(r) for r in ~np.isnan(x)}
    assert got.patterns == len(seen) and got.dof == sum(map(sum, seen)) - 30 and got.is_mcar

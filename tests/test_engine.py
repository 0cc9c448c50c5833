"""Signals and market queries against the same SQL in DuckDB; recursions against plain loops."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from quantloom import queries
from quantloom.operators import formulas, recursive
from quantloom.plans.compile import ewm

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame):
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)
    keys = [c for c in cols if not str(a[c].dtype).startswith("float")]
    a, b = (x[cols].astype({k: str for k in keys}).sort_values(keys or cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if c in keys:
            assert (a[c] == b[c]).all(), c
        else:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=2e-6, err_msg=c)


@pytest.mark.parametrize("name", ["trend_T01_T05", "volatility_V16_V20", "carry_C06_C10", "regime_R13_R17", "features_01", "barrier_labels", "backtest_daily", "tape_bars", "asof_limited", "label_uniqueness", "rank_ic"])
def test_against_sql(spark, duck, name):
    same(queries.queries()[name](spark, DATA).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


def test_registry_is_whole():
    divisions = pd.Series([d for d, _, _ in formulas.REGISTRY.values()]).value_counts()
    assert set(divisions.index) == set(formulas.DIVISIONS)
    # two regime formulas need linear algebra and are recursive.pca_signals
    assert divisions.sum() == 158 and divisions["regime"] == 18


def test_ewm_like_pandas():
    x = np.random.default_rng(0).standard_normal(200)
    x[[0, 5, 6, 90]] = np.nan
    for adjust in (True, False):
        np.testing.assert_allclose(ewm(x, 0.2, adjust), pd.Series(x).ewm(alpha=0.2, adjust=adjust).mean(), rtol=1e-12)


def test_acceptance_is_greedy():
    t = pd.DataFrame({"symbol": ["a", "b", "a", "c"], "i0": [1, 1, 3, 2], "i1": [5, 4, 6, 9]})
    assert recursive.accept_trades(t, slots=2, cooldown=2).symbol.tolist() == ["a", "b"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scores_do_not_look_ahead(spark):
    from pyspark.sql import functions as F

    from quantloom.plans.compile import Plan
    from quantloom.sources.adapters import panel

    p = panel(spark, DATA)
    plan = Plan({k: formulas.build(k, 14) for k in ("T01", "V10", "U05", "R16")}, "spark")
    whole = plan.apply(p).filter("bar_idx <= 200").toPandas().set_index(["symbol", "bar_idx"]).sort_index()
    part = plan.apply(p.filter(F.col("bar_idx") <= 200)).toPandas().set_index(["symbol", "bar_idx"]).sort_index()
    np.testing.assert_allclose(whole.astype(float), part.astype(float), atol=1e-9)


def test_pca_signals_at_every_bar(spark):
    """Against the formulas written out bar by bar, with refits that hold until the next one."""
    rng = np.random.default_rng(4)
    bars, names = 75, [f"s{i}" for i in range(6)]
    close = pd.DataFrame(np.exp(np.cumsum(rng.standard_normal((bars, 6)) * 0.05 + rng.standard_normal((bars, 1)) * 0.05, 0)), columns=names)
    close.iloc[30, 2] = np.nan
    grid = spark.createDataFrame([(c, t, None if np.isnan(close[c][t]) else float(close[c][t])) for t in range(bars) for c in names], "symbol string, bar_idx long, close double")
    got = recursive.pca_signals(grid, n=16, k=2, refit=5, lookback=16).toPandas()
    assert len(got) == bars * 6
    lr = np.log(close).diff()
    x = lr.fillna(0.0).to_numpy()
    z = lambda a: (a - np.nanmean(a)) / np.nanstd(a, ddof=1)
    res, load = [], []
    for t in range(16, bars):
        at = 16 + (t - 16) // 5 * 5
        w = x[at - 16 : at]
        v = np.linalg.eigh(np.cov(w.T))[1][:, ::-1].T[:2]
        flat = x[t] - x[t].mean()
        res.append(flat - v.T @ (v @ flat))
        load.append(v[0] * np.sign(v[0][np.abs(v[0]).argmax()]))
    cum = np.cumsum(res, axis=0)
    for t in range(bars):
        mine = got[got.bar_idx == t].set_index("symbol").loc[names]
        i = t - 16
        if i < 0:
            assert mine[["loading", "residual", "R12", "R19"]].isna().all(axis=None)
            continue
        np.testing.assert_allclose(mine.residual, res[i], atol=1e-7)
        np.testing.assert_allclose(mine.R19, -z(load[i]), atol=2e-5)
        if i >= 3:
            np.testing.assert_allclose(mine.R12, -z(cum[i] - cum[max(0, i - 7) : i + 1].mean(0)), atol=2e-5)
        else:
            assert mine.R12.isna().all()
        at = t - i % 2
        w = x[at - 16 : at]
        v = np.linalg.eigh(np.cov(w.T))[1][:, ::-1].T[:2]
        end = w[-1] - w.mean(0)
        np.testing.assert_allclose(mine.f_xcoin_pca_residual, z(np.where(lr.iloc[t].isna(), np.nan, v.T @ (v @ end) - end)), atol=2e-5)


def test_net_orders_of_every_bar(spark, duck):
    got = queries.queries()["net_orders_by_bar"](spark, DATA).toPandas()
    same(got, duck.execute(queries.oracle_sql()["net_orders_by_bar"]).df())
    same(got[got.bar_idx == 200].drop(columns="bar_idx"), queries.queries()["net_orders"](spark, DATA).toPandas())
    book = queries.queries()["quantile_book"](spark, DATA).toPandas()
    w = book.pivot(index="bar_idx", columns="symbol", values="w").reindex(range(book.bar_idx.min(), book.bar_idx.max() + 1)).fillna(0.0)
    moves = (w - w.shift(1, fill_value=0.0)).stack()
    moves = moves[moves.abs() > 1.1e-4]
    mine = got.set_index(["bar_idx", "symbol"]).delta
    assert len(got) > len(got[got.bar_idx == 200]) and set(moves.index) <= set(mine.index)
    np.testing.assert_allclose(mine.loc[moves.index], moves, atol=3e-6)

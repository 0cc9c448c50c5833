"""Backtests, inference, costs, archives and streams against plain loops; hand-written SQL is held in test_engine and by the driver."""

import itertools
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom import studies
from quantloom.operators import backtest as B
from quantloom.operators import execution as X
from quantloom.operators import inference as I
from quantloom.operators import recursive
from quantloom.research import harness as H
from quantloom.sources import archives
from quantloom.streaming import bars as S

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def grid():
    rng = np.random.default_rng(4)
    rows = []
    for s in "abcd":
        p = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 120)))
        for i, c in enumerate(p):
            rows.append((s, i, c * 0.999, c * 1.01, c * 0.985, c, 1e6, 0.0001, float(rng.normal())))
    return pd.DataFrame(rows, columns=["symbol", "bar_idx", "open", "high", "low", "close", "quote_volume", "funding", "score"])


@pytest.fixture(scope="module")
def frame(spark, grid):
    return spark.createDataFrame(grid)


def test_backtest(frame, grid):
    got = B.run_backtest(frame, B.Costs(0.0005, 1.0)).toPandas().sort_values("bar_idx")
    px, sig = (grid.pivot(index="bar_idx", columns="symbol", values=c).to_numpy() for c in ("close", "score"))
    held, equity = np.zeros(4), 1.0
    for t, row in enumerate(got.itertuples()):
        r = px[t] / px[t - 1] - 1 if t else np.zeros(4)
        w = sig[t - 2] / np.abs(sig[t - 2]).sum() if t > 1 else np.zeros(4)
        step = np.abs(w - held).sum()
        net = w @ r - step * 0.0006 - w.sum() * 0.0001
        equity *= 1 + net
        assert math.isclose(row.net_pnl, net, abs_tol=1e-12) and math.isclose(row.equity, equity, rel_tol=1e-9) and math.isclose(row.turnover, step, abs_tol=1e-12)
        held = w
    net = B.cost_sweep(frame, B.Costs(0.0005, 1.0)).orderBy("mult").toPandas()
    assert net.net.is_monotonic_decreasing and np.allclose(net.gross, net.gross[0])
    with pytest.raises(ValueError):
        B.run_backtest(frame, B.Costs(0.0005))


def test_an_oracle_of_the_next_bar_earns_nothing_in_advance(frame):
    """A signal that knows the next bar fills after it; one that knows the bar after next earns it."""
    w = B._bars()
    ahead = lambda k: F.signum(F.lead("close", k).over(w) / F.lead("close", k - 1).over(w) - 1)
    sharpe = lambda k: B.summary(B.run_backtest(frame.withColumn("score", ahead(k)), B.Costs(0.0, 0.0))).first()["sharpe_gross"]
    assert sharpe(2) > 1 and abs(sharpe(1)) < 0.5


def test_labels(frame, grid):
    cfg = B.Barriers(max_hold=9, window=8)
    ev = B.crossings(frame, B.Events(entry=1.0))
    got = B.label_events(frame, ev, cfg).toPandas().sort_values(["symbol", "i0"])
    sg = B.sigmas(frame, 8).toPandas()
    seen = 0
    for s, g in grid.groupby("symbol"):
        c, h, l, z = (g[k].to_numpy() for k in ("close", "high", "low", "score"))
        m = sg[sg.symbol == s].sort_values("bar_idx")
        up, down = z >= 1, z <= -1
        for t in range(len(c)):
            side = 1 if up[t] and not (t and up[t - 1]) else -1 if down[t] and not (t and down[t - 1]) else 0
            i = min(t + 1, len(c) - 1)
            if not side or i + 2 > len(c) - 1 or not m.blend.iloc[i] > 0:
                continue
            pt = m.blend.iloc[i] * 3
            sl = max(pt, m.rogers_satchell.iloc[i] * 3)
            end, hit, at = min(i + 9, len(c) - 1), 0, None
            for j in range(i + 1, end + 1):
                lose = l[j] <= c[i] * (1 - sl) if side > 0 else h[j] >= c[i] * (1 + sl)
                win = h[j] >= c[i] * (1 + pt) if side > 0 else l[j] <= c[i] * (1 - pt)
                if lose or win:
                    hit, at = -1 if lose else 1, j
                    break
            at = end if at is None else at
            ret = pt if hit == 1 else -sl if hit == -1 else side * (c[at] / c[i] - 1)
            row = got[(got.symbol == s) & (got.i0 == i)]
            assert (row.i1.iloc[0], row.barrier.iloc[0]) == (at, hit) and math.isclose(row.ret_gross.iloc[0], ret, rel_tol=1e-9)
            seen += 1
    assert seen == len(got) > 20


def test_barrier_chances():
    assert B.p_hit_upper(0, 1, 1, 3) == 0.75 and math.isnan(B.p_hit_upper(0, 0, 1, 1))
    rng, hits = np.random.default_rng(0), 0
    for _ in range(2000):
        x = 0.0
        while -1 < x < 1:
            x += 0.01 * 0.5 + 0.1 * rng.standard_normal()
        hits += x >= 1
    assert abs(hits / 2000 - B.p_hit_upper(0.5, 1, 1, 1)) < 0.05


def test_solved_barriers(spark):
    got = B.solve_barriers(spark.createDataFrame([("a", 0.002, 0.02), ("b", -0.001, 0.01), ("c", 0.0, 0.0)], "symbol string, mu double, sigma double")).toPandas().set_index("symbol")
    for s, mu, sigma in (("a", 0.002, 0.02), ("b", -0.001, 0.01)):
        scale = sigma * math.sqrt(12)
        best = max((round(B.expected_value(mu * 12, scale, a * scale, b * scale, 0.0015), 12), -a, -b) for a, b in itertools.product(B.GRID, B.GRID))
        assert (round(got.ev[s], 12), -got.pt_mult[s], -got.sl_mult[s]) == best
    assert got.pt_mult["c"] == 2 and got.ev.isna()["c"]


def test_folds(spark):
    rng = np.random.default_rng(1)
    t = [("s", int(i), int(i + rng.integers(1, 9))) for i in sorted(rng.choice(300, 61, replace=False))]
    d = spark.createDataFrame(t, "symbol string, i0 long, i1 long")
    got = I.purged_kfold(d).toPandas()
    gap = round(0.01 * max(z for _, _, z in t))
    for k, part in enumerate(np.array_split(np.arange(61), 5)):
        a, b = min(t[i][1] for i in part), max(t[i][2] for i in part)
        train = {t[i][1] for i in range(61) if i not in part and not (t[i][1] <= b and a <= t[i][2]) and not b < t[i][1] <= b + gap}
        f = got[got.fold == k]
        assert set(f[f.role == "train"].i0) == train and set(f[f.role == "test"].i0) == {t[i][1] for i in part}
    c = I.fold_counts(I.cpcv(d)).toPandas()
    assert len(c) == 15 and (c.leaked == 0).all() and (c[["train", "test", "purged", "embargo"]].sum(1) == 61).all()
    assert [(a[0], b[0], b[-1]) for a, b in I.walk_forward(10, 4, 2)] == [(0, 4, 5), (2, 6, 7), (4, 8, 9)]


def test_power(spark):
    x = np.random.default_rng(2).standard_normal(90).cumsum()
    got = I.autocorr_inflation(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "symbol string, bar_idx long, r double")).first()
    y, lags = x - x.mean(), math.ceil(4 * 0.9 ** (2 / 9))
    assert math.isclose(got["vif"], 1 + sum(2 * (1 - k / (lags + 1)) * (y[k:] @ y[:-k]) / (y @ y) for k in range(1, lags + 1)), rel_tol=1e-9)
    assert I.required_n_sharpe(0.1) == 785 and I.required_n_sharpe(0) is None and I.required_n_ic(0.05) == 3138
    assert I.overlap_deflation(4) == 0.25 and I.expected_max_t(1) == 0


def test_models():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 4)) ** 2
    worse = base + np.array([0, 0, 0, 1.0])
    c = I.model_confidence_set(worse, draws=200)
    assert 3 not in c["mcs"] and c["p_values"][3] < 0.05 and len(c["mcs"]) >= 2
    assert I.spa_test(worse[:, 3], base[:, :3], draws=200)["spa_p_value"] < 0.05 < I.spa_test(base[:, 0], worse[:, 3:], draws=200)["spa_p_value"]
    i = I.stationary_bootstrap(10_000, 10.0, rng)
    assert set(np.diff(i) % 10_000) >= {1} and abs(np.mean(np.diff(i) % 10_000 == 1) - 0.9) < 0.02
    y = np.arange(50.0)
    assert sorted(I.permuted_blocks(y, 8, rng)) == list(y) and len(I.circular_blocks(y, 8, rng)) == 50
    assert I.surrogate_threshold(I._correlation, y, y, draws=99, block=2)["p_value"] <= 0.02


def test_gamma_and_normal(spark):
    got = X.gamma_below(np.array([1.0, 3.0, 3.0, 10.0]), np.array([1.0, 2.0, 9.0, 12.0]))
    whole = lambda a, x: 1 - math.exp(-x) * sum(x**k / math.factorial(k) for k in range(a))
    assert np.allclose(got, [whole(1, 1.0), whole(3, 2.0), whole(3, 9.0), whole(10, 12.0)], atol=1e-12)
    x = spark.createDataFrame([(v,) for v in (-2.0, 0.0, 0.5, 3.0)], "x double").select("x", I.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) < 1e-7 for r in x)


def test_ladder_walk(spark):
    d = spark.createDataFrame([([1.0, 2.0], [100.0, 300.0], q) for q in (50.0, 100.0, 200.0, 400.0)], "bands array<double>, cumulative array<double>, q double")
    got = [r["s"] for r in d.select(X.walk_the_book(F.col("q")).alias("s")).collect()]
    # half a band; a band; a band and half the next; both and 100 beyond the last edge plus 5
    assert np.allclose(got, [25.0, 50.0, 100 * (50 + 100 * 1.25) / 200, 100 * (50 + 200 * 1.5 + 100 * 7) / 400])


def test_passive_fills(spark):
    rng = np.random.default_rng(5)
    t = np.cumsum(rng.exponential(2.0, 800))
    tape = [("s", float(a), i, float(100 + rng.normal()), float(rng.integers(1, 50)), int(rng.choice([-1, 1]))) for i, a in enumerate(t)]
    orders = [x for x in tape if x[2] % 9 == 0]
    got = X.passive_fills(spark.createDataFrame(tape, "symbol string, t double, seq long, price double, notional double, aggressor int"), spark.createDataFrame([(x[0], x[2], x[1], x[3]) for x in orders], "symbol string, order_id long, t double, price double"), queue=120.0, wait=20.0, look=15.0).toPandas().set_index("order_id")
    for _, t0, k, p0, _, _ in orders:
        run, tf = 0.0, None
        for x in tape:
            if t0 <= x[1] <= t0 + 20 and x[5] == -1:
                run += x[4]
                if run >= 120:
                    tf = x[1]
                    break
        at, base, most = (tf + 15, tf, 30) if tf is not None else (t0 + 20, t0, 40)
        later = [x for x in tape if x[1] >= at]
        move = -(later[0][3] / p0 - 1) * 1e4 if later and later[0][1] - base <= most else None
        assert got.filled[k] == (tf is not None)
        want = move if tf is not None or move is None else max(move, 0.0)
        assert (want is None and (math.isnan(got.move_bps[k]) or not got.filled[k] and got.move_bps[k] == 0)) or math.isclose(got.move_bps[k], want, abs_tol=1e-9)


def test_filters(spark, frame, grid):
    y = np.log(grid[grid.symbol == "a"].close.to_numpy())
    rv, level, var = np.var(np.diff(y)), y[0], 1.0
    got = recursive.local_level(frame).filter("symbol = 'a'").toPandas().sort_values("bar_idx")
    for v, row in zip(y, got.itertuples(), strict=True):
        var += 1e-5 * rv
        gain = var / (var + rv)
        level += gain * (v - level)
        var *= 1 - gain
        assert abs(row.level - level) < 1e-7
    r = np.random.default_rng(6).standard_normal(1500) * 0.01
    fit = X.fit_gjr(r)
    assert all(x >= 0 for x in fit) and abs(X.gjr_sigma(r, *fit, float(r.var())).mean() / 0.01 - 1) < 0.1
    assert recursive.expected_max_sharpe(1, 0.1) == 0.0


def test_archives(spark, tmp_path):
    body = "1700000000000,1,2,0.5,1.5,10,1700000059999,15,3,5,7,0\n"
    for name, text in (("ABC-1m-2023-11", "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore\n" + body), ("XYZ-1m-2025-01", body.replace("1700000000000", "1735689600000000") * 2)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.csv", text)
    got = archives.read(spark, str(tmp_path), "candles").orderBy("symbol").collect()
    assert [(r["symbol"], r["open_time"], r["close"], r["trades"]) for r in got] == [("ABC", 1700000000000, 1.5, 3), ("XYZ", 1735689600000, 1.5, 3)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "ABC-metrics-2024-01-01.csv").write_text("create_time,symbol,sum_open_interest,sum_open_interest_value,count_long_short_ratio,sum_taker_long_short_vol_ratio\n2024-01-01 00:05:00,ABC,5,50,1.1,0.9\n2024-01-01 00:10:00,ABC,6,60,1.2,0.8\nbad\n")
    m = archives.hourly_metrics(archives.read(spark, str(tmp_path / "m"), "metrics")).collect()
    assert [(r["oi_usd"], r["oi_contracts"], r["taker_lsr"]) for r in m] == [(60.0, 6.0, 0.8)]


def test_streams_like_batches(spark, tmp_path):
    """Bars of a stream read in several files are the batch's, up to the watermark; the filter goes on where it was."""
    src = S.events_as_trades(spark, "/root/testdata/sf0.001", streaming=False)
    src.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = S.drain(S.trade_bars(stream, late="30 days"), str(tmp_path / "bars")).toPandas()
    want = S.trade_bars(src).toPandas().set_index(["symbol", "bar"])
    for r in got.itertuples():
        assert math.isclose(want.notional[(r.symbol, r.bar)], r.notional) and want.close[(r.symbol, r.bar)] == r.close
    level = S.drain(S.online_level(S.events_as_trades(spark, "/root/testdata/sf0.001")), str(tmp_path / "level"))
    assert level.count() == src.filter("price > 0").count()


def test_causality(frame):
    ok = H.future_perturbation(frame, lambda d: B.momentum_score(d.drop("score")), [60]).first()
    bad = H.prefix_stability(frame, lambda d: B.returns(d).withColumnRenamed("forward", "score"), [60]).first()
    assert ok["passed"] and not bad["passed"]


def test_log(spark, tmp_path):
    log = H.Log(spark, str(tmp_path / "log"))
    a = log.add("grid", {"n": 1}, {"sharpe": 0.5})
    assert log.add("grid", {"n": 1}, {"sharpe": 0.7}) == a and log.add("grid", {"n": 2}, {}) != a
    assert log.latest().count() == 2 and log.trials().first()["trials"] == 2
    assert '0.7' in log.latest().filter(F.col("id") == a).first()["figures"]


@pytest.mark.parametrize("name", ["run_backtest", "sigma_labels", "purged_folds", "symbol_costs", "tape_bars_full", "stream_bars", "archive_trades", "symbols_union"])
def test_against_hand_written_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = studies.QUERIES[name](spark, DATA).toPandas(), con.execute(studies.SQL[name]).df()
    keys = [c for c in sorted(a.columns) if a[c].dtype.kind != "f"]
    a, b = (x[sorted(x.columns)].sort_values(keys).reset_index(drop=True) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=2e-6, err_msg=c)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_scaled_windows_keep_their_order():
    import inspect

    from quantloom.operators import formulas

    for name, (_, f, params) in formulas.REGISTRY.items():
        own = params if isinstance(params, dict) else {k: p.default for k, p in inspect.signature(f).parameters.items()}
        out = formulas.scaled(own, 14)
        windows = sorted((v, k) for k, v in own.items() if isinstance(v, int) and v >= 12)
        assert all(out[a] < out[b] for (x, a), (y, b) in itertools.pairwise(windows) if x < y), name


@pytest.fixture(scope="module")
def odd_events(tmp_path_factory):
    """Events with values of 0: alone, in runs, as an order's price and as the last of an hour and band; and null values."""
    import duckdb

    path = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * REPLACE (CASE WHEN event_id % 7 < 2 OR event_id BETWEEN 300 AND 340 THEN 0 WHEN event_id % 97 = 50 THEN NULL ELSE value END AS value) FROM '/root/testdata/sf0.001/events.parquet'")
    # a band that holds nothing but 0 on both sides of one hour
    con.execute("UPDATE events SET value = 0 WHERE date_trunc('day', ts) IN (SELECT date_trunc('day', min(ts)) + INTERVAL 2 DAY FROM events)")
    con.execute(f"COPY events TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["archive_quotes", "tape_bars_full", "depth_bars_full", "passive_fills", "maker_costs"])
def test_zeros_against_hand_written_sql(spark, odd_events, name):
    """Over 0, Spark raises and the SQL gives infinities and NaN: rows are the same, and so is which of these a value is."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{odd_events}/events.parquet'")
    key = lambda r: tuple("" if v is None else "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r)
    got = studies.QUERIES[name](spark, odd_events)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({studies.SQL[name]})").fetchall()
    assert sorted(map(key, got.collect())) == sorted(map(key, want))


REPEATED = {
    "rows twice": "SELECT * FROM {e} UNION ALL SELECT * FROM {e}",
    "other times": "SELECT * REPLACE (event_id % 300 AS event_id) FROM {e}",
    "other times, near": "SELECT event_id, ts + to_minutes(11 * k::INT) AS ts, user_id + 1500 * k AS user_id, event_type, value * 9 AS value, props FROM {e}, range(3) t(k)",
    "negative": "SELECT * REPLACE (event_id % 300 AS event_id, CASE WHEN event_id % 11 = 3 THEN -value ELSE 9 * value END AS value) FROM {e}",
    "nulls": "SELECT * REPLACE (CASE WHEN event_id % 6 > 0 THEN event_id % 400 END AS event_id, CASE WHEN event_id % 7 > 0 THEN ts END AS ts, CASE WHEN event_id % 11 > 0 THEN event_type END AS event_type) FROM {e}",
    "sums over the largest double": "SELECT * REPLACE (value * 1e305 AS value) FROM {e}",
}


@pytest.mark.parametrize("name", ["passive_fills", "maker_costs"])
@pytest.mark.parametrize("kind", REPEATED)
def test_orders_that_share_an_id_against_hand_written_sql(spark, tmp_path, kind, name):
    """Their fills, at the same times and at others, are those of the SQL, which lets them fill as one."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY ({REPEATED[kind].format(e="'/root/testdata/sf0.001/events.parquet'")}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    key = lambda r: tuple("" if v is None else "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r)
    got = studies.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({studies.SQL[name]})").fetchall()
    assert sorted(map(key, got.collect())) == sorted(map(key, want))


def test_first_reached_counts_trades_several_times():
    rng = np.random.default_rng(9)
    t, q = np.sort(rng.integers(0, 400, 900) * 0.5), rng.integers(1, 9, 900) * 0.1
    t0, times = rng.integers(0, 420, 300) * 0.5, rng.integers(1, 5, 300)
    for queue in (0.3, 0.7, 6.0, 100.0):
        got = X.first_reached(t0, t, q, queue, 30.0, times)
        for a, k, g in zip(t0, times, got, strict=True):
            inside = (t >= a) & (t <= a + 30)
            run = np.cumsum(np.repeat(q[inside], k))
            want = np.repeat(t[inside], k)[run >= queue]
            assert g == want[0] if len(want) else math.isnan(g)


def test_first_reached():
    """As a loop that adds up each order's own trades, where totals differ from that sum by rounding, and with values that fall."""
    rng = np.random.default_rng(8)
    t = np.sort(rng.integers(0, 400, 900) * 0.5)
    t0 = rng.integers(0, 420, 300) * 0.5
    for q in (rng.integers(1, 9, 900) * 0.1, rng.normal(0.3, 1.0, 900), np.zeros(900), np.where(np.arange(900) % 50 == 7, np.nan, 0.1)):
        for queue in (0.3, 0.7, 6.0, 2000.0):
            got = X.first_reached(t0, t, q, queue, 30.0)
            for a, g in zip(t0.tolist(), got.tolist(), strict=True):
                run, want = 0.0, None
                for b, v in zip(t.tolist(), q.tolist(), strict=True):
                    if a <= b <= a + 30:
                        run += v
                        if run >= queue or math.isnan(run):
                            want = b
                            break
                assert g == want or math.isnan(g) and want is None


def test_next_price_over_empty_stretches(spark):
    tape = [("a", 10.0, 1, 5.0), ("a", 10.0, 0, 4.0), ("a", 95.0, 2, None), ("a", 99.0, 3, 7.0), ("b", 50.0, 4, 9.0), (None, 20.0, 5, 1.0)]
    points = [(1, "a", 10.0), (2, "a", 10.5), (3, "a", 95.0), (4, "a", 99.5), (5, "b", 1.0), (6, None, 1.0), (7, "a", None)]
    d = X.next_price(spark.createDataFrame(points, "k long, symbol string, at double"), spark.createDataFrame(tape, "symbol string, t double, seq long, price double"), length=7.0)
    got = {r["k"]: (r["next_t"], r["next_price"]) for r in d.collect()}
    assert got == {1: (10.0, 4.0), 2: (95.0, 7.0), 3: (95.0, 7.0), 4: (None, None), 5: (50.0, 9.0), 6: (None, None), 7: (None, None)}

"""Queries of backtests, inference, costs and relational steps on the weekly panel, and SQL written by hand for them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import backtest as B
from quantloom.operators import execution as X
from quantloom.operators import inference as I
from quantloom.operators import relational as R
from quantloom.operators import tape
from quantloom.research import harness as H
from quantloom.sources import adapters, archives
from quantloom.streaming import bars as S

COSTS = B.Costs(taker_fee=0.00045, slippage_bps=1.0)
#: Gross weight of the book, and slots of trades: small, as weekly prices of these tables jump by multiples.
GROSS, SLOTS = 0.02, 400
TIERS = X.Tiers(first=1e7, second=1e6)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(d: DataFrame, digits: int = 6) -> DataFrame:
    return d.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.panel(spark, sf_dir).select("symbol", "bar_idx", "open", "high", "low", "close", "quote_volume", "funding")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.momentum_score(_panel(spark, sf_dir))


def _returns(d: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    return d.withColumn("r", F.log("close") - F.lag(F.log("close")).over(w))


_W = "WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)"
_BASE = f"""WITH panel AS MATERIALIZED (SELECT symbol, bar_idx, open, high, low, close, quote_volume, funding FROM {adapters.panel_sql()} p0),
moved AS (SELECT *, ln(close) - lag(ln(close), 12) OVER w AS mom, ln(close) - lag(ln(close)) OVER w AS r FROM panel {_W}),
scored AS MATERIALIZED (SELECT *, (mom - avg(mom) OVER (PARTITION BY bar_idx)) / nullif(stddev_samp(mom) OVER (PARTITION BY bar_idx), 0) AS score FROM moved)"""


def _round(cols: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({x}, {digits}) AS {k}" for k, x in cols.items())


# portfolio

_BOOK = f"""{_BASE},
held AS (SELECT symbol, bar_idx, coalesce(close / lag(close) OVER w - 1, 0) AS ret, coalesce(funding, 0) AS funding, coalesce(lag(score, 2) OVER w, 0) AS raw FROM scored {_W}),
scale AS (SELECT bar_idx, sum(abs(raw)) AS total FROM held GROUP BY bar_idx),
weights AS (SELECT h.*, CASE WHEN total > 0 THEN 0.02::DOUBLE * raw / total ELSE 0 END AS wt FROM held h JOIN scale USING (bar_idx)),
steps AS (SELECT *, abs(wt - coalesce(lag(wt) OVER w, 0)) AS dw FROM weights {_W}),
bars AS (SELECT bar_idx, sum(wt * ret) AS gross_pnl, sum(dw) AS turnover, -sum(wt * funding) AS funding_pnl, sum(dw) * CAST(0.00055 AS DOUBLE) AS cost FROM steps GROUP BY bar_idx),
net AS (SELECT *, gross_pnl - cost + funding_pnl AS net_pnl FROM bars),
curve AS (SELECT *, product(1 + net_pnl) OVER u AS equity, product(1 + gross_pnl) OVER u AS gross_equity FROM net WINDOW u AS (ORDER BY bar_idx)),
full_run AS (SELECT *, equity / max(equity) OVER (ORDER BY bar_idx) - 1 AS drawdown FROM curve)"""
_RUN = ("gross_pnl", "turnover", "cost", "funding_pnl", "net_pnl", "equity", "gross_equity", "drawdown")


@_query(f"{_BASE} SELECT symbol, bar_idx, round(coalesce(close / lag(close) OVER w - 1, 0), 6) AS backward, round(coalesce(lead(close) OVER w / close - 1, 0), 6) AS forward FROM panel {_W}")
def simple_returns(spark, sf_dir):
    return _rounded(B.returns(_panel(spark, sf_dir)))


@_query(f"{_BOOK} SELECT bar_idx, {_round({c: c for c in _RUN})} FROM full_run")
def run_backtest(spark, sf_dir):
    return _rounded(B.run_backtest(_scored(spark, sf_dir), COSTS, gross=GROSS).select("bar_idx", *_RUN))


@_query(f"""{_BOOK} SELECT round(avg(gross_pnl) / stddev_samp(gross_pnl), 6) AS sharpe_gross, round(avg(net_pnl) / stddev_samp(net_pnl), 6) AS sharpe_net,
round(pow(product(1 + net_pnl), 1.0::DOUBLE / count(*)) - 1, 6) AS mean_compound_net, round(sum(cost), 6) AS total_cost, round(sum(gross_pnl), 6) AS total_gross, round(sum(net_pnl), 6) AS total_net,
round(min(drawdown), 6) AS max_drawdown, count(*) AS n_bars FROM full_run""")
def backtest_summary(spark, sf_dir):
    return _rounded(B.summary(B.run_backtest(_scored(spark, sf_dir), COSTS, gross=GROSS)))


@_query(f"""{_BOOK}, m AS (SELECT unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS mult), x AS (SELECT mult, gross_pnl, gross_pnl - mult * cost + funding_pnl AS net FROM net CROSS JOIN m)
SELECT mult, round(sum(gross_pnl), 6) AS gross, round(sum(net), 6) AS net, round(avg(net) / stddev_samp(net), 6) AS sharpe_net FROM x GROUP BY mult""")
def cost_sweep(spark, sf_dir):
    return _rounded(B.cost_sweep(_scored(spark, sf_dir), COSTS, gross=GROSS))


# events


def _mean(x: str, n: int, f: str = "avg") -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {f}({x}) {frame} END"


_K = 0.34 / (1.34 + 13 / 11)
_SIGMA = f"""{_BASE},
parts AS (SELECT *, ln(open / lag(close) OVER w) AS jump, ln(close / open) AS body, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, ln(high / low) * ln(high / low) AS hl, r * r AS r2 FROM scored {_W}),
variances AS (SELECT *, {_mean("jump", 12, "var_samp")} AS vj, {_mean("body", 12, "var_samp")} AS vb, {_mean("rs", 12)} AS vr, {_mean("hl", 12)} AS vp,
  {_mean("r2", 2, "sum")} AS h1, {_mean("r2", 8, "sum")} AS h2, {_mean("r2", 36, "sum")} AS h3 FROM parts),
sigmas AS MATERIALIZED (SELECT *, CASE WHEN vj + vb + vr IS NOT NULL THEN sqrt(greatest(vj + {_K!r}::DOUBLE * vb + (1 - {_K!r}::DOUBLE) * vr, 0)) END AS yang_zhang, CASE WHEN vr IS NOT NULL THEN sqrt(greatest(vr, 0)) END AS rogers_satchell,
  CASE WHEN vp IS NOT NULL THEN sqrt(vp / (4 * ln(2))) END AS parkinson, CASE WHEN h1 + h2 + h3 IS NOT NULL THEN sqrt((0.36::DOUBLE * h1 + 0.36::DOUBLE * h2 / 4 + 0.28::DOUBLE * h3 / 18) / 2) END AS har_rv FROM variances),
blended AS MATERIALIZED (SELECT *, greatest(yang_zhang, rogers_satchell, parkinson) AS blend, max(bar_idx) OVER (PARTITION BY symbol) AS last_bar FROM sigmas),
flags AS (SELECT *, CASE WHEN score >= 1.5 THEN 1 WHEN score <= -1.5 THEN -1 ELSE 0 END AS flag FROM blended),
events AS (SELECT symbol, least(bar_idx + 1, last_bar) AS i0, flag::DOUBLE AS side FROM (SELECT *, coalesce(lag(flag) OVER w, 0) AS was FROM flags {_W}) q WHERE flag <> 0 AND flag <> was),
starts AS (SELECT e.symbol, e.i0, e.side, b.close AS p0, b.blend AS sigma, b.last_bar, least(e.i0 + 12, b.last_bar) AS vert, b.blend * sqrt(12) AS pt, greatest(b.blend * sqrt(12), coalesce(b.rogers_satchell, 0) * sqrt(12)) AS sl
  FROM events e JOIN blended b ON b.symbol = e.symbol AND b.bar_idx = e.i0 WHERE e.i0 + 2 <= b.last_bar AND b.blend > 0 AND b.close IS NOT NULL),
touches AS (SELECT s.symbol, s.i0, s.side, p.bar_idx, CASE WHEN (s.side > 0 AND p.low <= s.p0 * (1 - s.sl)) OR (s.side < 0 AND p.high >= s.p0 * (1 + s.sl)) THEN -1 WHEN (s.side > 0 AND p.high >= s.p0 * (1 + s.pt)) OR (s.side < 0 AND p.low <= s.p0 * (1 - s.pt)) THEN 1 END AS hit
  FROM starts s JOIN panel p ON p.symbol = s.symbol AND p.bar_idx > s.i0 AND p.bar_idx <= s.vert),
firsts AS (SELECT symbol, i0, side, min(bar_idx) AS bar_idx, arg_min(hit, bar_idx) AS hit FROM touches WHERE hit IS NOT NULL GROUP BY symbol, i0, side),
labels AS MATERIALIZED (SELECT s.symbol, s.i0, coalesce(f.bar_idx, s.vert) AS i1, s.side, CASE f.hit WHEN 1 THEN s.pt WHEN -1 THEN -s.sl ELSE s.side * (z.close / s.p0 - 1) END AS ret_gross, coalesce(f.hit, 0) AS barrier, coalesce(f.bar_idx, s.vert) - s.i0 AS hold, s.pt, s.sl, s.sigma
  FROM starts s LEFT JOIN firsts f ON f.symbol = s.symbol AND f.i0 = s.i0 AND f.side = s.side LEFT JOIN panel z ON z.symbol = s.symbol AND z.bar_idx = s.vert)"""
_SIGMAS = ("yang_zhang", "rogers_satchell", "parkinson", "har_rv", "blend")


@_query(f"{_SIGMA} SELECT symbol, bar_idx, {_round({c: c for c in _SIGMAS})} FROM blended")
def barrier_sigmas(spark, sf_dir):
    return _rounded(B.sigmas(_panel(spark, sf_dir)).select("symbol", "bar_idx", *_SIGMAS))


@_query(f"{_SIGMA} SELECT symbol, i0, side FROM events")
def threshold_events(spark, sf_dir):
    return B.crossings(_scored(spark, sf_dir))


def _labels(spark, sf_dir) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return B.label_events(scored, B.crossings(scored))


@_query(f"{_SIGMA} SELECT symbol, i0, i1, side, round(ret_gross, 6) AS ret_gross, CAST(barrier AS INTEGER) AS barrier, hold, {_round({c: c for c in ('pt', 'sl', 'sigma')})} FROM labels")
def sigma_labels(spark, sf_dir):
    return _rounded(_labels(spark, sf_dir))


_HELD = "spans AS (SELECT symbol, i0, unnest(generate_series(i0, i1)) AS bar FROM labels), busy AS (SELECT bar, count(*) AS n FROM spans GROUP BY bar)"


@_query(f"""{_SIGMA}, {_HELD}, u AS (SELECT symbol, i0, avg(1.0::DOUBLE / n) AS w FROM spans JOIN busy USING (bar) GROUP BY symbol, i0)
SELECT round(avg(w), 6) AS avg_uniqueness, round(1 / avg(w), 6) AS overlap_factor, (SELECT round(avg(n), 6) FROM busy) AS mean_concurrency FROM u""")
def label_overlap(spark, sf_dir):
    return _rounded(B.overlap(_labels(spark, sf_dir)))


@_query(f"""{_SIGMA}, t AS (SELECT *, ret_gross - 0.0015::DOUBLE AS ret_net, (ret_gross - 0.0015::DOUBLE) / 400 AS x FROM labels WHERE hold >= 2 AND ret_gross IS NOT NULL),
e AS (SELECT *, product(1 + x) OVER (ORDER BY i0, symbol ROWS UNBOUNDED PRECEDING) AS eq FROM t), dd AS (SELECT *, eq / max(eq) OVER (ORDER BY i0, symbol ROWS UNBOUNDED PRECEDING) - 1 AS d FROM e),
a AS (SELECT count(*) AS n_trades, (max(i1) - min(i0) + 1) * (168.0::DOUBLE / 8760) AS years, avg(CASE WHEN ret_net > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(ret_gross) * 10000 AS avg_ret_gross_bps, avg(ret_net) * 10000 AS avg_ret_net_bps, 15.0::DOUBLE AS avg_cost_bps,
  avg(ret_net) FILTER (ret_net > 0) / -avg(ret_net) FILTER (ret_net <= 0) AS payoff_ratio, sum(ret_net) FILTER (ret_net > 0) / -sum(ret_net) FILTER (ret_net <= 0) AS profit_factor, avg(x) AS mu, stddev_samp(x) AS sd, product(1 + x) - 1 AS total_return, min(d) AS max_drawdown, avg(hold) AS avg_hold_bars,
  count(*) FILTER (barrier = 1) AS tp_hits, count(*) FILTER (barrier = -1) AS sl_hits, count(*) FILTER (barrier = 0) AS time_exits FROM dd)
SELECT n_trades, tp_hits, sl_hits, time_exits, {_round({c: c for c in ("years", "win_rate", "avg_ret_gross_bps", "avg_ret_net_bps", "avg_cost_bps", "payoff_ratio", "profit_factor", "total_return", "max_drawdown", "avg_hold_bars")} | {"avg_hold_hours": "avg_hold_bars * 168", "trades_per_year": "n_trades / years", "expectancy_bps": "avg_ret_net_bps", "sharpe_ann": "mu * sqrt(n_trades / years) / sd"}, 4)} FROM a""")
def label_trade_stats(spark, sf_dir):
    t = _labels(spark, sf_dir).filter("hold >= 2 and ret_gross is not null").withColumn("cost", F.lit(0.0015)).withColumn("ret_net", F.col("ret_gross") - F.col("cost"))
    return _rounded(B.trade_stats(t, slots=SLOTS), 4)


@_query()
def event_backtest(spark, sf_dir):
    return _rounded(B.event_backtest(_scored(spark, sf_dir)))


@_query()
def event_trade_stats(spark, sf_dir):
    return _rounded(B.trade_stats(B.event_backtest(_scored(spark, sf_dir)), slots=SLOTS), 4)


_CLOSE = f"""{_SIGMA}, vol AS (SELECT symbol, bar_idx, close, last_bar, {_mean("r", 12, "stddev_samp")} AS v FROM blended),
cs AS (SELECT e.symbol, e.i0, e.side, v.close AS p0, v.v, least(e.i0 + 12, v.last_bar) AS vert FROM events e JOIN vol v ON v.symbol = e.symbol AND v.bar_idx = e.i0 WHERE v.close IS NOT NULL AND v.v > 0 AND e.i0 < v.last_bar),
cp AS (SELECT c.symbol, c.i0, c.side, c.v, p.bar_idx, c.side * (p.close / c.p0 - 1) AS x FROM cs c JOIN panel p ON p.symbol = c.symbol AND p.bar_idx > c.i0 AND p.bar_idx <= c.vert),
ch AS (SELECT symbol, i0, side, min(bar_idx) FILTER (abs(x) >= 2 * v) AS t, max(bar_idx) AS m FROM cp GROUP BY symbol, i0, side),
cl AS (SELECT h.symbol, h.i0, coalesce(h.t, h.m) AS i1, h.side, CASE WHEN h.t IS NULL THEN 0 WHEN p.x > 0 THEN 1 ELSE -1 END AS label, p.x AS ret FROM ch h JOIN cp p ON p.symbol = h.symbol AND p.i0 = h.i0 AND p.side = h.side AND p.bar_idx = coalesce(h.t, h.m))"""


def _close_labels(spark, sf_dir) -> DataFrame:
    d = _returns(_scored(spark, sf_dir))
    return B.close_barriers(d.withColumn("vol", B._full(F.col("r"), 12, F.stddev_samp)), B.crossings(d), vol="vol")


@_query(f"{_CLOSE} SELECT symbol, i0, i1, side, CAST(label AS INTEGER) AS label, CASE label WHEN 1 THEN 'pt' WHEN -1 THEN 'sl' ELSE 'vertical' END AS touch, round(ret, 6) AS ret FROM cl")
def close_barriers(spark, sf_dir):
    return _rounded(_close_labels(spark, sf_dir))


@_query(f"""{_CLOSE} SELECT {_round({"mean": "avg(ret)", "std": "stddev_samp(ret)", "skew": "skewness(ret) * (count(ret) - 2) / sqrt(count(ret) * (count(ret) - 1))", "p_up": "avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END)", "p_dn": "avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END)", "p_vertical": "avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END)", "q05": "quantile_cont(ret, 0.05)", "q95": "quantile_cont(ret, 0.95)"})} FROM cl WHERE ret IS NOT NULL""")
def payoff_distribution(spark, sf_dir):
    return _rounded(B.payoff(_close_labels(spark, sf_dir)))


@_query(f"""{_BASE}, st AS (SELECT symbol, avg(r) AS mu, stddev_samp(r) AS sigma FROM scored GROUP BY symbol), g AS (SELECT unnest(generate_series(2, 12)) * 0.25::DOUBLE AS v),
c AS (SELECT symbol, mu, sigma, a.v AS a, b.v AS b, mu * 12 AS m, sigma * sqrt(12) AS s FROM st CROSS JOIN g a CROSS JOIN g b),
p AS (SELECT *, greatest(0, least(1, (1 - exp(-2 * m / (s * s) * b * s)) / (1 - exp(-2 * m / (s * s) * (a + b) * s)))) AS p FROM c), v AS (SELECT *, p * a * s - (1 - p) * b * s - 0.0015::DOUBLE AS ev FROM p),
best AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(ev, 12) DESC, a, b) AS k FROM v)
SELECT symbol, {_round({"mu": "mu", "sigma": "sigma", "pt_mult": "a", "sl_mult": "b", "ev": "ev", "p_tp": "p"})} FROM best WHERE k = 1""")
def solve_barriers(spark, sf_dir):
    st = _returns(_panel(spark, sf_dir)).groupBy("symbol").agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sigma"))
    return _rounded(B.solve_barriers(st))


# folds, power, models

_FOLDS = """, parts_ AS (SELECT *, ntile({k}) OVER (ORDER BY i0, symbol, i1) - 1 AS part FROM labels), ends AS (SELECT part, min(i0) AS a, max(i1) AS b FROM parts_ GROUP BY part),
gap AS (SELECT round(0.01::DOUBLE * max(i1)) AS g FROM labels), sets AS ({sets}),
roles AS (SELECT s.fold, p.i0, p.i1, s.a, s.b, CASE WHEN p.part = s.x OR p.part = s.y THEN 'test' WHEN p.i0 <= s.b AND s.a <= p.i1 THEN 'purged' WHEN p.i0 > s.b AND p.i0 <= s.b + g THEN 'embargo' ELSE 'train' END AS role FROM parts_ p CROSS JOIN sets s CROSS JOIN gap)
SELECT fold, count(*) FILTER (role = 'train') AS train, count(*) FILTER (role = 'test') AS test, count(*) FILTER (role = 'purged') AS purged, count(*) FILTER (role = 'embargo') AS embargo, count(*) FILTER (role = 'train' AND i0 <= b AND a <= i1) AS leaked FROM roles GROUP BY fold"""


@_query(_SIGMA + _FOLDS.format(k=5, sets="SELECT CAST(part AS INTEGER) AS fold, part AS x, part AS y, a, b FROM ends"))
def purged_folds(spark, sf_dir):
    return I.fold_counts(I.purged_kfold(_labels(spark, sf_dir)))


@_query(_SIGMA + _FOLDS.format(k=6, sets="SELECT m.part || '-' || n.part AS fold, m.part AS x, n.part AS y, least(m.a, n.a) AS a, greatest(m.b, n.b) AS b FROM ends m JOIN ends n ON m.part < n.part"))
def combinatorial_folds(spark, sf_dir):
    return I.fold_counts(I.cpcv(_labels(spark, sf_dir)))


@_query(f"""{_BASE}, e AS (SELECT min(bar_idx) AS lo, max(bar_idx) - min(bar_idx) + 1 AS n FROM panel), k AS (SELECT lo, unnest(generate_series(0, (n - 130) // 26)) AS window_ FROM e)
SELECT window_ AS "window", lo + window_ * 26 AS train_from, lo + window_ * 26 + 103 AS train_to, lo + window_ * 26 + 104 AS test_from, lo + window_ * 26 + 129 AS test_to FROM k""")
def walk_forward_windows(spark, sf_dir):
    return I.walk_forward_bars(_panel(spark, sf_dir))


_NEED = I.required_n_sharpe(0.1)
_LAGS = ", ".join(f"lag(x, {k}) OVER u AS x{k}" for k in range(1, 21))
_RHO = " + ".join(f"CASE WHEN {k} <= lags THEN 2 * (1 - {k} / (lags + 1.0::DOUBLE)) * sum(x * x{k}) / sum(x * x) ELSE 0 END" for k in range(1, 21))


@_query(f"""{_BASE}, c AS (SELECT symbol, bar_idx, r - avg(r) OVER (PARTITION BY symbol) AS x FROM scored WHERE r IS NOT NULL), l AS (SELECT *, {_LAGS} FROM c WINDOW u AS (PARTITION BY symbol ORDER BY bar_idx)),
n AS (SELECT symbol, count(*) AS n, least(ceil(4 * pow(count(*) / 100.0::DOUBLE, 2 / 9.0::DOUBLE)), count(*) - 2) AS lags FROM c GROUP BY symbol),
v AS (SELECT symbol, any_value(n) AS n, greatest(1 + {_RHO.replace("lags", "any_value(lags)")}, 0.000001) AS vif FROM l JOIN n USING (symbol) GROUP BY symbol)
SELECT symbol, n, round(vif, 6) AS vif, 0.25::DOUBLE AS overlap, round(n * 0.25::DOUBLE / vif, 6) AS effective_n, {_NEED}::BIGINT AS required_n, n * 0.25::DOUBLE / vif >= {_NEED} AS powered FROM v""")
def power_verdict(spark, sf_dir):
    return _rounded(I.power_verdict(_returns(_panel(spark, sf_dir)), target=0.1, horizon=4))


@_query(f"""{_BASE}, f AS (SELECT symbol, bar_idx, r * r AS a, (r - 0.5::DOUBLE * lag(r) OVER w) * (r - 0.5::DOUBLE * lag(r) OVER w) AS b FROM scored {_W}), d AS (SELECT symbol, bar_idx, a - b AS d FROM f WHERE a - b IS NOT NULL),
c AS (SELECT *, d - avg(d) OVER (PARTITION BY symbol) AS x FROM d), l AS (SELECT *, lag(x) OVER u AS x1, lag(x, 2) OVER u AS x2 FROM c WINDOW u AS (PARTITION BY symbol ORDER BY bar_idx)),
v AS (SELECT symbol, count(*) AS n, avg(d) AS mean_diff, avg(x * x) + 4 / 3.0::DOUBLE * avg(x * x1) + 2 / 3.0::DOUBLE * avg(x * x2) AS lrv FROM l GROUP BY symbol),
s AS (SELECT *, CASE WHEN lrv <= 0 THEN 0 ELSE mean_diff / sqrt(lrv / n) END AS dm FROM v), t AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(dm)) AS t FROM s)
SELECT symbol, n, round(mean_diff, 6) AS mean_diff, round(dm, 6) AS dm_stat, round(CASE WHEN lrv <= 0 THEN 1 ELSE 2 * exp(-dm * dm / 2) / sqrt(2 * pi()) * ({"(" * 4}1.330274429::DOUBLE * t - 1.821255978::DOUBLE) * t + 1.781477937::DOUBLE) * t - 0.356563782::DOUBLE) * t + 0.319381530::DOUBLE) * t) END, 6) AS p_value FROM t""")
def model_losses(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    d = _returns(_panel(spark, sf_dir)).withColumns({"a": F.col("r") * F.col("r"), "b": F.pow(F.col("r") - 0.5 * F.lag("r").over(w), 2)})
    return _rounded(I.diebold_mariano(d, h=3))


@_query()
def model_sets(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    e = lambda k: F.pow(F.col("r") - F.lit(k) * F.lag("r").over(w), 2)
    d = _returns(_panel(spark, sf_dir)).withColumns({"bench": F.col("r") * F.col("r"), "half": e(0.5), "fade": e(-0.3), "same": e(1.0)})
    return I.compare_models(d, ["half", "fade", "same"], "bench", draws=200)


@_query()
def block_surrogates(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    d = _returns(_panel(spark, sf_dir)).withColumns({"x": F.lag("r").over(w), "y": F.col("r")})
    return I.surrogates(d)


# costs

_VOLUMES = f"{_BASE}, vols AS (SELECT symbol, stddev_samp(r) / sqrt(7) AS sigma_daily, avg(quote_volume) / 7 AS adv, avg((high - low) / close) * 1000 AS hs, sum(quote_volume) AS q FROM scored GROUP BY symbol)"
_CAL = f"""{_VOLUMES}, mid AS (SELECT quantile_cont(sigma_daily, 0.5) AS md FROM vols),
cal AS (SELECT symbol, coalesce(sigma_daily, md) AS sd, adv, CASE WHEN adv >= 1e7 THEN 1 WHEN adv >= 1e6 THEN 2 ELSE 3 END AS tier, CASE WHEN symbol < 'Brand#30' THEN hs END AS hsm, CASE WHEN symbol LIKE '%1' THEN 0.8::DOUBLE END AS pe, q, symbol > 'Brand#40' AS laddered FROM vols CROSS JOIN mid),
base AS (SELECT *, coalesce(hsm, CASE tier WHEN 1 THEN 0.4::DOUBLE WHEN 2 THEN 1.2::DOUBLE ELSE 4.0::DOUBLE END) AS hsp, CASE tier WHEN 1 THEN 0.92::DOUBLE WHEN 2 THEN 0.85::DOUBLE ELSE 0.72::DOUBLE END AS pt, 5000 * sd * sqrt(20000 / adv) AS hit FROM cal),
slip AS (SELECT *, greatest(0.75::DOUBLE, 0.35::DOUBLE * hsp) AS adverse,
  CASE WHEN laddered THEN greatest(0, 100 * (CASE WHEN 20000 <= q / 1e4 THEN 20000 * 0.5::DOUBLE * 20000 / (q / 1e4) ELSE q / 1e4 * 0.5::DOUBLE + CASE WHEN 20000 <= 3 * q / 1e4 THEN (20000 - q / 1e4) * (1 + (20000 - q / 1e4) / (2 * q / 1e4)) ELSE 2 * q / 1e4 * 2 + (20000 - 3 * q / 1e4) * 8 END END) / 20000 - hsp)
       WHEN 20000 <= adv * 1e-5 THEN 0 ELSE hsp * least(4, sqrt(20000 / greatest(adv * 1e-5, 1)) - 1) END AS rest, 0.5::DOUBLE + 0.5::DOUBLE / 1.4::DOUBLE AS pen FROM base),
fills AS (SELECT *, least(0.99::DOUBLE, greatest(0.05::DOUBLE, coalesce(pe, pt) * pen)) AS pf_e, least(0.99::DOUBLE, greatest(0.05::DOUBLE, pt * pen)) AS pf_x, 1.8::DOUBLE + adverse - hsp AS made, 4.5::DOUBLE + hsp + hit + rest AS taken FROM slip),
totals AS (SELECT *, greatest(pf_e * made + (1 - pf_e) * taken, 1.9::DOUBLE) AS e, greatest(pf_x * made + (1 - pf_x) * taken, 1.9::DOUBLE) AS x FROM fills)"""


def _calibrated(spark, sf_dir) -> DataFrame:
    """Half spreads measured for some symbols, fill chances for others, a ladder of two bands for others again."""
    d = _returns(_panel(spark, sf_dir)).groupBy("symbol").agg((F.stddev_samp("r") / 7**0.5).alias("sigma_daily"), (F.avg("quote_volume") / 7).alias("adv"), (F.avg((F.col("high") - F.col("low")) / F.col("close")) * 1000).alias("hs"), F.sum("quote_volume").alias("q"))
    s = F.col("symbol")
    ladder = F.when(s > "Brand#40", F.array(F.col("q") / 1e4, 3 * F.col("q") / 1e4))
    cal = d.select("symbol", F.when(s < "Brand#30", F.col("hs")).alias("half_spread_bps"), F.when(s.endswith("1"), 0.8).alias("p_fill_entry"), F.when(s > "Brand#40", F.array(F.lit(1.0), F.lit(3.0))).alias("bands"), ladder.alias("cumulative"))
    return X.calibrated(d.select("symbol", "sigma_daily", "adv"), cal, TIERS)


@_query(f"{_CAL} SELECT symbol, tier, {_round({'entry_bps': 'e', 'exit_bps': 'x', 'roundtrip_bps': 'e + x', 'oneway_bps': '(e + x) / 2', 'oneway': '(e + x) / 20000'})} FROM totals")
def symbol_costs(spark, sf_dir):
    return _rounded(X.symbol_costs(_calibrated(spark, sf_dir)))


@_query(f"""{_CAL} SELECT symbol, tier, {_round({"p_fill": "pf_e", "fee_bps": "CASE WHEN pf_e > 0.5 THEN 1.8::DOUBLE ELSE 4.5::DOUBLE END", "spread_bps": "hsp * (1 - pf_e) - hsp * pf_e", "impact_bps": "hit * (1 - pf_e)", "slippage_bps": "rest * (1 - pf_e)", "adverse_sel_bps": "adverse * pf_e", "total_bps": "e"})} FROM totals""")
def fill_costs(spark, sf_dir):
    d = X.fill_cost(_calibrated(spark, sf_dir))
    return _rounded(d.select("symbol", "tier", "p_fill", "fee_bps", "spread_bps", "impact_bps", "slippage_bps", "adverse_sel_bps", "total_bps"))


@_query()
def queue_fill_costs(spark, sf_dir):
    d = _calibrated(spark, sf_dir).withColumn("near_touch", F.col("adv") * 0.2).withColumn("p_fill_entry", F.lit(None).cast("double"))
    return _rounded(X.fill_cost(d).select("symbol", "tier", "p_fill", "total_bps"))


@_query(f"{_CAL} SELECT symbol, 4 AS n_slices, round(hit, 6) AS single_bps, round(hit / 2, 6) AS split_bps, round(hit / 2, 6) AS saving_bps FROM base")
def split_saving(spark, sf_dir):
    return _rounded(X.split_saving(_calibrated(spark, sf_dir)))


@_query(f"""{_CAL}, miss AS (SELECT symbol, e, greatest(taken, 4.6::DOUBLE) AS tk, (1 - pf_e) * (1 - least(0.99::DOUBLE, pf_e * 1.08::DOUBLE)) * (1 - least(0.99::DOUBLE, pf_e * 1.16::DOUBLE)) AS m FROM totals)
SELECT symbol, round(1 - m, 6) AS p_fill, round((1 - m) * e + m * tk, 6) AS cost_bps, CASE WHEN 1 - m >= 0.5 THEN 'maker' ELSE 'taker' END AS mode FROM miss""")
def ladder_plans(spark, sf_dir):
    return _rounded(X.plan_ladder(_calibrated(spark, sf_dir)))


_TAPE = """WITH tape AS (SELECT event_type AS symbol, event_id AS seq, epoch(ts)::DOUBLE AS t, value AS price, value * (1 + user_id % 7) AS notional, CASE WHEN user_id % 2 = 1 THEN -1 ELSE 1 END AS side FROM events),
orders AS (SELECT symbol, seq AS order_id, t AS t0, price AS p0 FROM tape WHERE seq % 5 = 0),
met AS (SELECT o.*, x.t, sum(x.notional) OVER (PARTITION BY o.symbol, o.order_id ORDER BY x.t, x.seq ROWS UNBOUNDED PRECEDING) AS run FROM orders o JOIN tape x ON x.symbol = o.symbol AND x.side = -1 AND x.t >= o.t0 AND x.t <= o.t0 + 86400),
hit AS (SELECT symbol, order_id, min(t) AS tf FROM met WHERE run >= 2000 GROUP BY symbol, order_id),
pts AS (SELECT o.*, h.tf, coalesce(h.tf + 43200, o.t0 + 86400) AS at_ FROM orders o LEFT JOIN hit h USING (symbol, order_id)),
nxt AS (SELECT p.symbol, p.order_id, min(x.t) AS nt, arg_min(x.price, (x.t, x.seq)) AS np FROM pts p JOIN tape x ON x.symbol = p.symbol AND x.t >= p.at_ GROUP BY p.symbol, p.order_id),
res AS (SELECT p.symbol, p.order_id, p.tf IS NOT NULL AS filled, p.tf - p.t0 AS latency, CASE WHEN n.nt - coalesce(p.tf, p.t0) <= CASE WHEN p.tf IS NULL THEN 172800 ELSE 86400 END THEN (1 - n.np / p.p0) * 10000 END AS move FROM pts p LEFT JOIN nxt n USING (symbol, order_id)),
fills AS (SELECT symbol, order_id, filled, latency, CASE WHEN filled THEN move ELSE greatest(move, 0) END AS move_bps FROM res)"""


def _fills(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    tape = e.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), t.alias("t"), F.col("value").alias("price"), (F.col("value") * (1 + F.col("user_id") % 7)).alias("notional"), F.when(F.col("user_id") % 2 == 1, -1).otherwise(1).alias("aggressor"))
    orders = tape.filter("seq % 5 = 0").select("symbol", F.col("seq").alias("order_id"), "t", "price")  # an order at every fifth trade
    return X.passive_fills(tape, orders, queue=2000.0, wait=86400.0, look=43200.0)


@_query(f"{_TAPE} SELECT symbol, order_id, filled, round(latency, 3) AS latency, round(CASE WHEN filled OR move_bps IS NOT NULL THEN move_bps ELSE 0 END, 4) AS move_bps FROM fills")
def passive_fills(spark, sf_dir):
    d = _fills(spark, sf_dir)
    return d.select("symbol", "order_id", "filled", F.round("latency", 3).alias("latency"), F.round("move_bps", 4).alias("move_bps"))


@_query(f"""{_TAPE}, g AS (SELECT symbol, count(*) AS n_orders, avg(CASE WHEN filled THEN 1.0 ELSE 0.0 END) AS p_fill, coalesce(avg(move_bps) FILTER (filled), 0) AS adverse_bps, coalesce(avg(coalesce(move_bps, 0)) FILTER (NOT filled), 0) AS wait_bps, quantile_cont(latency, 0.5) FILTER (filled) AS latency FROM fills GROUP BY symbol)
SELECT symbol, n_orders, {_round({c: c for c in ("p_fill", "adverse_bps", "wait_bps", "latency")} | {"oneway_bps": "p_fill * (1.8::DOUBLE + greatest(adverse_bps, 0.75::DOUBLE)) + (1 - p_fill) * (5.7::DOUBLE + wait_bps)", "taker_bps": "5.7::DOUBLE"}, 4)} FROM g""")
def maker_costs(spark, sf_dir):
    return _rounded(X.maker_cost(_fills(spark, sf_dir)), 4)


@_query(f"""{_BASE}, s AS (SELECT symbol, bar_idx, coalesce(r, 0) AS pnl, {_mean("r", 12, "stddev_samp")} * sqrt(52) AS sigma FROM scored),
t AS (SELECT symbol, bar_idx, pnl, coalesce(lag(CASE WHEN sigma > 0 THEN least(3, 0.1::DOUBLE / sigma) ELSE 0 END) OVER w, 0) AS weight FROM s {_W})
SELECT symbol, bar_idx, round(weight, 6) AS weight, round(pnl * weight, 6) AS scaled FROM t""")
def volatility_target(spark, sf_dir):
    d = _returns(_panel(spark, sf_dir))
    d = d.select("symbol", "bar_idx", F.coalesce("r", F.lit(0.0)).alias("pnl"), (B._full(F.col("r"), 12, F.stddev_samp) * 52**0.5).alias("sigma"))
    return _rounded(X.apply_target(d).select("symbol", "bar_idx", "weight", "scaled"))


@_query(f"""{_BASE}, v AS (SELECT symbol, bar_idx, coalesce(r, 0) AS v, row_number() OVER w - 1 AS k FROM scored {_W})
SELECT symbol, bar_idx, round(CASE WHEN k >= 60 THEN stddev_pop(v) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) END, 6) AS sigma FROM v""")
def rolling_sigma(spark, sf_dir):
    return _rounded(X.rolling_sigma(_returns(_panel(spark, sf_dir))).select("symbol", "bar_idx", "sigma"))


@_query()
def gjr_volatility(spark, sf_dir):
    return _rounded(X.gjr_by_symbol(_returns(_panel(spark, sf_dir))))


@_query()
def hedge_ratio(spark, sf_dir):
    p = _panel(spark, sf_dir)
    x = p.filter(F.col("symbol") == adapters.REF_SYMBOL).select("bar_idx", F.log("close").alias("x"))
    return _rounded(X.hedge_ratio(p.withColumn("y", F.log("close")).join(F.broadcast(x), "bar_idx", "left")))


QUERIES |= {k: (lambda spark, sf_dir, f=f: f(_panel(spark, sf_dir))) for k, (f, _) in R.STEPS.items()}
SQL |= {k: f"{_BASE} {sql}" for k, (_, sql) in R.STEPS.items()}

# tape, archives, streams, checks

_TRADES = """WITH t AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, (1 + user_id % 7)::DOUBLE AS qty, CASE WHEN user_id % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM events)"""
_TAPE_COLS = ("ofi_usd", "n_trades", "notional", "kyle_lambda", "vwap", "open", "high", "low", "close", "big_trade_imb", "trade_sign_ac1", "roll_spread_bps", "realised_vol", "buy_frac", "aggr_imb", "avg_trade_usd", "intensity", "ret", "twap_ret", "cum_delta")


@_query(f"""{_TRADES}, a AS (SELECT *, date_trunc('day', ts) AS bar, CAST(ts AS DATE) AS day, price * qty AS nz, s * sqrt(price * qty) AS x FROM t),
b AS (SELECT *, coalesce(price - lag(price) OVER d, 0) AS dp, lag(s) OVER r AS s1, ln(price / lag(price) OVER r) AS dl FROM a WINDOW d AS (PARTITION BY symbol, day ORDER BY ts, seq), r AS (PARTITION BY symbol, bar ORDER BY ts, seq)),
c AS (SELECT *, lag(dl) OVER (PARTITION BY symbol, bar ORDER BY ts, seq) AS dl1 FROM b), q AS (SELECT symbol, day, quantile_cont(nz, 0.9) AS p90, count(*) AS n_day FROM a GROUP BY symbol, day),
g AS (SELECT symbol, bar, sum(s * nz) AS ofi_usd, count(*)::DOUBLE AS n_trades, sum(nz) AS notional, CASE WHEN count(*) > 5 AND count(*) * sum(x * x) - sum(x) * sum(x) <> 0 THEN (count(*) * sum(x * dp) - sum(x) * sum(dp)) / (count(*) * sum(x * x) - sum(x) * sum(x)) END AS kyle_lambda, sum(price * nz) / sum(nz) AS vwap,
  first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, sum(s * nz) FILTER (nz >= p90) / sum(nz) FILTER (nz >= p90) AS big_trade_imb,
  CASE WHEN count(s1) > 4 AND 1 - avg(s) * avg(s) > 1e-9 THEN (avg(s * s1) - avg(s) * avg(s)) / (1 - avg(s) * avg(s)) END AS trade_sign_ac1,
  CASE WHEN count(dl * dl1) > 2 THEN CASE WHEN avg(dl * dl1) < 0 THEN 20000 * sqrt(-avg(dl * dl1)) ELSE 0 END END AS roll_spread_bps, CASE WHEN count(dl) > 2 THEN sqrt(avg(dl * dl)) END AS realised_vol, sum(nz) FILTER (s > 0) AS buy
  FROM c JOIN q USING (symbol, day) WHERE n_day >= 3 GROUP BY symbol, bar),
h AS (SELECT *, coalesce(buy, 0) / notional AS buy_frac, ofi_usd / notional AS aggr_imb, notional / n_trades AS avg_trade_usd, n_trades / 86400 AS intensity, ln(close / open) AS ret, ln(vwap / lag(vwap) OVER w) AS twap_ret, sum(ofi_usd) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS cum_delta FROM g WINDOW w AS (PARTITION BY symbol ORDER BY bar))
SELECT symbol, CAST(CAST(bar AS DATE) AS VARCHAR) AS bar, {_round({c: c for c in _TAPE_COLS}, 5)} FROM h""")
def tape_bars_full(spark, sf_dir):
    d = tape.tape_bars(S.events_as_trades(spark, sf_dir, streaming=False), minutes=1440, least=3)
    return _rounded(d.select("symbol", F.to_date("bar").cast("string").alias("bar"), *_TAPE_COLS), 5)


_DEPTH_COLS = ("depth_imb_1pct", "depth_imb_5pct", "imb_vol", "book_slope", "total_depth", "microprice_tilt", "depth_withdraw")


@_query(f"""WITH b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS dt, [-5, -1, 1, 5][1 + event_id % 4] AS p, value AS notional, value / (1 + user_id % 7) AS depth, event_id AS seq FROM events),
l AS (SELECT symbol, dt, p, arg_max(notional, seq) AS v, arg_max(depth, seq) AS d FROM b GROUP BY symbol, dt, p),
s AS (SELECT symbol, dt, max(v) FILTER (p = -1) AS b1, max(v) FILTER (p = 1) AS a1, max(v) FILTER (p = -5) AS b5, max(v) FILTER (p = 5) AS a5, max(d) FILTER (p = -1) AS db, max(d) FILTER (p = 1) AS da FROM l GROUP BY symbol, dt),
f AS (SELECT symbol, date_trunc('day', dt) AS bar, (b1 - a1) / (b1 + a1) AS i1, (b5 - a5) / (b5 + a5) AS i5, (b1 / b5 + a1 / a5) / 2 AS sl, b5 + a5 AS tot, (db - da) / (db + da) AS mp FROM s),
g AS (SELECT symbol, bar, avg(i1) AS depth_imb_1pct, avg(i5) AS depth_imb_5pct, stddev_samp(i1) AS imb_vol, quantile_cont(sl, 0.5) AS book_slope, avg(tot) AS total_depth, avg(mp) AS microprice_tilt, count(i1) AS n_snap FROM f GROUP BY symbol, bar),
h AS (SELECT *, total_depth / lag(total_depth) OVER (PARTITION BY symbol ORDER BY bar) - 1 AS depth_withdraw FROM g)
SELECT symbol, CAST(CAST(bar AS DATE) AS VARCHAR) AS bar, n_snap, {_round({c: c for c in _DEPTH_COLS})} FROM h WHERE n_snap > 0""")
def depth_bars_full(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    band = F.get(F.array(*[F.lit(float(x)) for x in (-5, -1, 1, 5)]), (F.col("event_id") % 4).cast("int"))
    d = e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("dt"), band.alias("percentage"), F.col("value").alias("notional"), (F.col("value") / (1 + F.col("user_id") % 7)).alias("depth"), F.col("event_id").alias("seq"))
    return _rounded(tape.depth_bars(d, minutes=1440).select("symbol", F.to_date("bar").cast("string").alias("bar"), "n_snap", *_DEPTH_COLS))


def _archive(spark, sf_dir, kind: str, line, header: str) -> DataFrame:
    """Events as lines of an archive of the kind, a header in every file and each line twice."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = e.select(F.concat(F.lit("/x/"), F.col("event_type"), F.lit(f"-{kind}-2024.csv")).alias("path"), F.lit(header).alias("header"), F.concat_ws(",", *[F.coalesce(x.cast("string"), F.lit("")) for x in line]).alias("line"))
    heads = lines.select("path", "header", F.col("header").alias("line")).distinct()
    return archives.parse(lines.unionByName(lines).unionByName(heads), kind)


@_query("SELECT event_type AS symbol, event_id AS agg_id, value AS price, (1 + user_id % 7)::DOUBLE AS qty, epoch_us(ts) // 1000 AS ts, user_id % 2 = 1 AS is_buyer_maker FROM events")
def archive_trades(spark, sf_dir):
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    # half of the files' times are in microseconds
    time = F.when(F.col("event_id") % 2 == 0, t * 1000).otherwise(t)
    line = [F.col("event_id"), F.col("value"), 1 + F.col("user_id") % 7, F.col("event_id"), F.col("event_id"), time, F.when(F.col("user_id") % 2 == 1, "True").otherwise("false")]
    return _archive(spark, sf_dir, "trades", line, "agg_trade_id,price,quantity,first,last,transact_time,is_buyer_maker").select("symbol", "agg_id", "price", "qty", "ts", "is_buyer_maker")


@_query("""WITH e AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, CASE WHEN user_id % 2 = 1 THEN 'SELL' ELSE 'BUY' END AS side, (1 + user_id % 7)::DOUBLE AS q, value AS p FROM events),
g AS (SELECT symbol, ts, coalesce(sum(q) FILTER (side = 'SELL'), 0) * 100 AS sold, coalesce(sum(q) FILTER (side = 'BUY'), 0) * 100 AS bought, count(*) AS n, sum(p * q) / sum(q) AS vwap FROM e GROUP BY symbol, ts),
h AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM g GROUP BY symbol)
SELECT h.symbol, epoch(h.ts)::BIGINT AS hour, coalesce(sold, 0)::DOUBLE AS sold, coalesce(bought, 0)::DOUBLE AS bought, coalesce(n, 0) AS n, round(vwap, 9) AS vwap, round((sold - bought) / nullif(sold + bought, 0), 6) AS imbalance FROM h LEFT JOIN g ON g.symbol = h.symbol AND g.ts = h.ts""")
def archive_liquidations(spark, sf_dir):
    line = [F.unix_millis(F.col("ts").cast("timestamp")), F.lit("x"), F.when(F.col("user_id") % 2 == 1, "SELL").otherwise("BUY"), F.col("value"), 1 + F.col("user_id") % 7]
    d = _archive(spark, sf_dir, "liquidations", line, "time,type,side,average_price,last_fill_quantity")
    return archives.hourly_liquidations(d).select("symbol", F.unix_seconds("ts").alias("hour"), "sold", "bought", "n", F.round("vwap", 9).alias("vwap"), F.round("imbalance", 6).alias("imbalance"))


@_query("""WITH q AS (SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) // 1000 AS t, value AS bid, value * (1 + (user_id % 5) * 0.001::DOUBLE) AS ask, (1 + user_id % 7) * value AS bq FROM events),
s AS (SELECT *, (ask - bid) / ((ask + bid) / 2) * 10000 AS sp, (t - lag(t) OVER (PARTITION BY symbol ORDER BY t, seq)) / 1000.0::DOUBLE AS gap FROM q)
SELECT symbol, count(*) AS n_updates, round(quantile_cont(sp, 0.5) FILTER (sp > 0 AND sp < 200), 5) AS spread_bps_median, round(quantile_cont(sp, 0.25) FILTER (sp > 0 AND sp < 200), 5) AS spread_bps_p25, round(quantile_cont(sp, 0.75) FILTER (sp > 0 AND sp < 200), 5) AS spread_bps_p75,
round(quantile_cont(bq, 0.5), 5) AS bid_notional_median, round(avg(gap) FILTER (gap >= 0 AND gap < 60), 5) AS mean_gap FROM s GROUP BY symbol""")
def archive_quotes(spark, sf_dir):
    ask = F.col("value") * (1 + (F.col("user_id") % 5) * 0.001)
    line = [F.col("event_id"), F.col("value"), 1 + F.col("user_id") % 7, ask, F.lit(1.0), F.unix_millis(F.col("ts").cast("timestamp")), F.lit(0)]
    d = archives.quote_stats(_archive(spark, sf_dir, "quotes", line, "update_id,best_bid_price,best_bid_qty,best_ask_price,best_ask_qty,transaction_time,event_time"))
    return d.select("symbol", "n_updates", *[F.round(c, 5).alias(c) for c in ("spread_bps_median", "spread_bps_p25", "spread_bps_p75", "bid_notional_median")], F.round("mean_gap", 5).alias("mean_gap"))


def _stream_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{path or 'file://' + tempfile.mkdtemp(prefix='quantloom-')}/stream-{uuid.uuid4().hex}"


@_query("""WITH t AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, value * (1 + user_id % 7) AS nz, user_id % 2 = 1 AS sold FROM events)
SELECT symbol, epoch(date_trunc('hour', ts))::BIGINT AS bar, count(*) AS n_trades, round(sum(nz), 5) AS notional, round(sum(CASE WHEN sold THEN -nz ELSE nz END), 5) AS ofi_usd, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close
FROM t GROUP BY symbol, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_bars(spark, sf_dir):
    d = S.drain(S.trade_bars(S.events_as_trades(spark, sf_dir)), _stream_dir(spark))
    return d.select("symbol", F.unix_seconds("bar").alias("bar"), "n_trades", F.round("notional", 5).alias("notional"), F.round("ofi_usd", 5).alias("ofi_usd"), "open", "high", "low", "close")


@_query()
def stream_level(spark, sf_dir):
    return _rounded(S.drain(S.online_level(S.events_as_trades(spark, sf_dir)), _stream_dir(spark)))


@_query()
def causality_checks(spark, sf_dir):
    """The score looks at no later bar; the forward return, as a counterexample, does."""
    p, bars = _panel(spark, sf_dir), [120, 200, 300]
    ahead = lambda d: B.returns(d).withColumnRenamed("forward", "score")
    out = None
    for name, f in (("score", B.momentum_score), ("forward", ahead)):
        for check, run in (("future", H.future_perturbation), ("prefix", H.prefix_stability)):
            d = run(p, f, bars).select(F.lit(name).alias("signal"), F.lit(check).alias("check"), "bar_idx", "passed")
            out = d if out is None else out.unionByName(d)
    return out


@_query()
def threshold_grid(spark, sf_dir):
    """Figures of the event backtest for a grid of thresholds and holding times, with verdicts and places."""
    p = _scored(spark, sf_dir)
    run = lambda entry, hold: B.trade_stats(B.event_backtest(p, B.Events(entry=entry, barriers=B.Barriers(max_hold=hold))), slots=SLOTS)
    return _rounded(H.rank_runs(H.Gates().judge(H.run_grid(run, {"entry": [1.5, 2.0], "hold": [6, 12]}))), 4)

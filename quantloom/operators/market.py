"""Bars, alignment, books, events, costs and statistics as declarative SQL that Spark plans; the same text, with the few
differences of dialect filled in, is the check in another engine. {panel}, {tape} and {ret} are sources."""

from __future__ import annotations

import re

from quantloom.sources.adapters import panel_sql

# Trades: a row of events; the side is sold by odd users.
TAPE = """(SELECT event_type AS symbol, ts, event_id AS seq, value AS price, CAST(1 + user_id % 7 AS DOUBLE) AS qty,
    CASE WHEN user_id % 2 = 1 THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS side, value * (1 + user_id % 7) AS nz,
    CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS bar FROM events)"""
RET = "(SELECT symbol, bar_idx, ts, open, high, low, close, quote_volume, funding, ln(close) - lag(ln(close), 1) OVER (PARTITION BY symbol ORDER BY bar_idx) AS r, lead(ln(close), 2) OVER (PARTITION BY symbol ORDER BY bar_idx) - lead(ln(close), 1) OVER (PARTITION BY symbol ORDER BY bar_idx) AS fwd FROM {panel} p0)"
#: A plain score for books and events: 12-bar momentum, standardised across symbols.
SCORE = "(SELECT *, (m - avg(m) OVER (PARTITION BY ts)) / nullif(stddev_samp(m) OVER (PARTITION BY ts), 0) AS score FROM (SELECT *, ln(close) - lag(ln(close), 12) OVER (PARTITION BY symbol ORDER BY bar_idx) AS m FROM {ret} r0) r1)"
BOOK = """(SELECT *, CASE WHEN k > 0.8 THEN 0.5 / nullif(sum(CASE WHEN k > 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY ts), 0)
    WHEN k <= 0.2 THEN -0.5 / nullif(sum(CASE WHEN k <= 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY ts), 0) ELSE 0 END AS w
    FROM (SELECT *, (rank() OVER (PARTITION BY ts ORDER BY score NULLS LAST) + (count(1) OVER (PARTITION BY ts, score) - 1) / 2.0) / nullif(count(score) OVER (PARTITION BY ts), 0) AS k FROM {score} s0 WHERE score IS NOT NULL) s1)"""
EVENTS = """(SELECT symbol, bar_idx + 1 AS i0, CASE WHEN score > 0 THEN 1 ELSE -1 END AS side FROM
    (SELECT *, coalesce(lag(hit, 1) OVER (PARTITION BY symbol ORDER BY bar_idx), 0) AS was FROM (SELECT *, CASE WHEN abs(score) >= 1.5 THEN 1 ELSE 0 END AS hit FROM {score} s0) s1) s2 WHERE hit = 1 AND was = 0)"""
_PATH = """(SELECT e.symbol, e.i0, e.side, b0.close AS p0, b.bar_idx AS i, b.close,
    CASE WHEN (e.side = 1 AND b.low <= b0.close * 0.9) OR (e.side = -1 AND b.high >= b0.close * 1.1) THEN 1 ELSE 0 END AS stop,
    CASE WHEN (e.side = 1 AND b.high >= b0.close * 1.1) OR (e.side = -1 AND b.low <= b0.close * 0.9) THEN 1 ELSE 0 END AS target
    FROM {events} e JOIN {panel} b0 ON b0.symbol = e.symbol AND b0.bar_idx = e.i0
    JOIN {panel} b ON b.symbol = e.symbol AND b.bar_idx > e.i0 AND b.bar_idx <= e.i0 + 12 WHERE b0.close IS NOT NULL)"""
TRADES = """(SELECT f.symbol, f.i0, f.side, coalesce(f.touch, f.last_i) AS i1, CASE WHEN f.touch IS NULL THEN 0 WHEN f.stopped = 1 THEN -1 ELSE 1 END AS barrier,
    CASE WHEN f.touch IS NULL THEN f.side * (f.last_close / f.p0 - 1) WHEN f.stopped = 1 THEN -0.1 ELSE 0.1 END AS ret
    FROM (SELECT g.symbol, g.i0, g.side, g.p0, g.touch, max(CASE WHEN p.i = g.touch THEN p.stop END) AS stopped, g.last_i, max(CASE WHEN p.i = g.last_i THEN p.close END) AS last_close
        FROM (SELECT symbol, i0, side, p0, min(CASE WHEN stop + target > 0 THEN i END) AS touch, max(CASE WHEN close IS NOT NULL THEN i END) AS last_i FROM {path} p1 GROUP BY symbol, i0, side, p0) g
        JOIN {path} p ON p.symbol = g.symbol AND p.i0 = g.i0 GROUP BY g.symbol, g.i0, g.side, g.p0, g.touch, g.last_i) f)"""
_TRADE_WINDOWS = """(SELECT t.*, CASE WHEN lag(bar, 1) OVER w = bar THEN lag(side, 1) OVER w END AS s1, price - lag(price, 1) OVER d AS dp,
    CASE WHEN lag(bar, 1) OVER w = bar AND price > 0 THEN ln(price / nullif(lag(price, 1) OVER w, 0)) END AS dl, {median_p90} AS p90
    FROM {tape} t WINDOW w AS (PARTITION BY symbol, bar ORDER BY ts, seq), d AS (PARTITION BY symbol, day ORDER BY ts, seq))"""

_Q: dict[str, str] = {
    "tape_bars": """SELECT symbol, CAST(bar AS STRING) AS bar, CAST(count(1) AS BIGINT) AS n_trades, round(sum(side * nz), 4) AS ofi_usd, round(sum(CASE WHEN side > 0 THEN nz ELSE 0 END) / nullif(sum(nz), 0), 6) AS buy_frac,
        round(sum(price * nz) / nullif(sum(nz), 0), 6) AS vwap, min(price) AS low, max(price) AS high, {first} AS open, {last} AS close, round(sum(nz), 4) AS notional,
        round(CASE WHEN count(s1) > 4 AND 1 - avg(CASE WHEN s1 IS NOT NULL THEN side END) * avg(CASE WHEN s1 IS NOT NULL THEN side END) > 0.000000001 THEN (avg(side * s1) - avg(side) * avg(side)) / nullif(1 - avg(side) * avg(side), 0) END, 6) AS sign_ac1,
        round(CASE WHEN count(dl) > 2 THEN sqrt(avg(dl * dl)) END, 6) AS realised_vol, round(sum(CASE WHEN nz >= p90 THEN side * nz ELSE 0 END) / nullif(sum(CASE WHEN nz >= p90 THEN nz ELSE 0 END), 0), 6) AS big_imb,
        round(CASE WHEN count(1) > 5 THEN (count(dp) * sum(dp * side * sqrt(nz)) - sum(dp) * sum(CASE WHEN dp IS NOT NULL THEN side * sqrt(nz) END)) / nullif(count(dp) * sum(CASE WHEN dp IS NOT NULL THEN nz END) - sum(CASE WHEN dp IS NOT NULL THEN side * sqrt(nz) END) * sum(CASE WHEN dp IS NOT NULL THEN side * sqrt(nz) END), 0) END, 6) AS kyle_lambda
        FROM {trade_windows} t GROUP BY symbol, bar""",
    "book_bars": """SELECT symbol, CAST(day AS STRING) AS day, CAST(count(1) AS BIGINT) AS n_snap, round(avg(imb1), 6) AS imb_1, round(stddev_samp(imb1), 6) AS imb_vol, round({median_tot}, 4) AS depth_median FROM
        (SELECT symbol, day, bar, (sum(CASE WHEN side > 0 AND qty <= 2 THEN nz ELSE 0 END) - sum(CASE WHEN side < 0 AND qty <= 2 THEN nz ELSE 0 END)) / nullif(sum(CASE WHEN qty <= 2 THEN nz END), 0) AS imb1, sum(nz) AS tot FROM {tape} t GROUP BY symbol, day, bar) s GROUP BY symbol, day""",
    "resample_left": """SELECT symbol, CAST(floor(bar_idx / 4.0) AS BIGINT) AS bucket, {first_open} AS open, max(high) AS high, min(low) AS low, {last_close} AS close, round(sum(volume), 4) AS volume FROM {panel} p WHERE close IS NOT NULL GROUP BY symbol, floor(bar_idx / 4.0)""",
    "resample_right": """SELECT symbol, CAST(ceil(bar_idx / 4.0) * 4 AS BIGINT) AS label, {first_open} AS open, max(high) AS high, min(low) AS low, {last_close} AS close, round(sum(volume), 4) AS volume FROM {panel} p WHERE close IS NOT NULL GROUP BY symbol, ceil(bar_idx / 4.0)""",
    "asof_unlimited": """SELECT symbol, bar_idx, {ffill} AS funding FROM (SELECT symbol, bar_idx, CASE WHEN bar_idx % 5 = 0 THEN round(funding, 10) END AS f FROM {panel} p) x""",
    "asof_limited": """SELECT symbol, bar_idx, {ffill3} AS funding FROM (SELECT symbol, bar_idx, CASE WHEN bar_idx % 5 = 0 THEN round(funding, 10) END AS f FROM {panel} p) x""",
    "universe_monthly": """SELECT month, nation, CAST(rank_ AS BIGINT) AS rank_, round(volume, 2) AS volume FROM (SELECT month, nation, volume, row_number() OVER (PARTITION BY month ORDER BY volume DESC, nation) AS rank_ FROM
        (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, c_nationkey AS nation, sum(o_totalprice) AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) v) x WHERE rank_ <= 10""",
    "quality_gate": """SELECT symbol, CAST(sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN close IS NULL AND was IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS gaps,
        CAST(sum(CASE WHEN high < greatest(open, close) OR low > least(open, close) THEN 1 ELSE 0 END) AS BIGINT) AS broken, CAST(sum(CASE WHEN close = was THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM (SELECT *, lag(close, 1) OVER (PARTITION BY symbol ORDER BY bar_idx) AS was FROM {panel} p) x GROUP BY symbol""",
    "mad_outliers": """SELECT a.symbol, CAST(sum(CASE WHEN abs(a.r - m.med) > 3 * 1.4826 * m.mad THEN 1 ELSE 0 END) AS BIGINT) AS outliers, round(max(m.mad), 6) AS mad FROM {ret} a JOIN
        (SELECT r2.symbol, max(med) AS med, {median_dev} AS mad FROM {ret} r2 JOIN (SELECT symbol, {median_r} AS med FROM {ret} r3 GROUP BY symbol) q ON q.symbol = r2.symbol GROUP BY r2.symbol) m ON m.symbol = a.symbol GROUP BY a.symbol""",
    "spread_corwin_schultz": """SELECT symbol, round(coalesce({median_s}, 0), 6) AS spread FROM (SELECT symbol, CASE WHEN 2 * (exp(a) - 1) / (1 + exp(a)) > 0 THEN 2 * (exp(a) - 1) / (1 + exp(a)) END AS s FROM
        (SELECT symbol, (sqrt(2 * b) - sqrt(b)) / 0.1715728752538097 - sqrt(g / 0.1715728752538097) AS a FROM (SELECT symbol, ln(high / low) * ln(high / low) + ln(h1 / l1) * ln(h1 / l1) AS b, ln(greatest(high, h1) / least(low, l1)) * ln(greatest(high, h1) / least(low, l1)) AS g
        FROM (SELECT *, lag(high, 1) OVER (PARTITION BY symbol ORDER BY bar_idx) AS h1, lag(low, 1) OVER (PARTITION BY symbol ORDER BY bar_idx) AS l1 FROM {panel} p) x WHERE h1 IS NOT NULL AND high IS NOT NULL) y) z) q GROUP BY symbol""",
    "spread_abdi_ranaldo": """SELECT symbol, round(sqrt(CASE WHEN 4 * avg((ln(close) - e) * (ln(close) - e1)) > 0 THEN 4 * avg((ln(close) - e) * (ln(close) - e1)) ELSE 0 END), 6) AS spread FROM
        (SELECT *, lead(e, 1) OVER (PARTITION BY symbol ORDER BY bar_idx) AS e1 FROM (SELECT symbol, bar_idx, close, (ln(high) + ln(low)) / 2 AS e FROM {panel} p) x) y GROUP BY symbol""",
    "spread_roll": """SELECT symbol, CAST(count(1) AS BIGINT) AS n, round(2 * sqrt(CASE WHEN covar_samp(r, r1) < 0 THEN -covar_samp(r, r1) ELSE 0 END), 6) AS spread FROM (SELECT symbol, r, lag(r, 1) OVER (PARTITION BY symbol ORDER BY bar_idx) AS r1 FROM {ret} x) y WHERE r IS NOT NULL AND r1 IS NOT NULL GROUP BY symbol""",
    "rank_ic": """SELECT CAST(count(ic) AS BIGINT) AS bars, round(avg(ic), 6) AS ic FROM (SELECT ts, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM (SELECT ts, CASE WHEN fwd IS NOT NULL THEN ra END AS a, CASE WHEN score IS NOT NULL THEN rb END AS b FROM
        (SELECT ts, score, fwd, rank() OVER (PARTITION BY ts ORDER BY score NULLS LAST) + 0.5 * count(1) OVER (PARTITION BY ts, score) AS ra, rank() OVER (PARTITION BY ts ORDER BY fwd NULLS LAST) + 0.5 * count(1) OVER (PARTITION BY ts, fwd) AS rb FROM {score} s) x WHERE score IS NOT NULL AND fwd IS NOT NULL) y GROUP BY ts) z""",
    "dispersion_and_move": """SELECT round({median_sd}, 6) AS dispersion FROM (SELECT ts, stddev_samp(fwd) AS sd FROM {ret} x GROUP BY ts) y""",
    "quantile_book": """SELECT symbol, bar_idx, round(w, 6) AS w FROM {book} b""",
    "backtest_daily": """SELECT bar_idx, round(sum(held * r), 6) AS gross, round(sum(abs(held - coalesce(prev, 0))), 6) AS turnover, round(sum(held * r) - 0.001 * sum(abs(held - coalesce(prev, 0))), 6) AS net, round(-sum(held * coalesce(funding, 0)), 8) AS funding FROM
        (SELECT *, lag(held, 1) OVER (PARTITION BY symbol ORDER BY bar_idx) AS prev FROM (SELECT p.symbol, p.bar_idx, coalesce(p.r, 0) AS r, p.funding, coalesce(lag(b.w, 2) OVER (PARTITION BY p.symbol ORDER BY p.bar_idx), 0) AS held FROM {ret} p LEFT JOIN {book} b ON b.symbol = p.symbol AND b.bar_idx = p.bar_idx) x) y GROUP BY bar_idx""",
    "signal_events": """SELECT symbol, CAST(i0 AS BIGINT) AS i0, CAST(side AS BIGINT) AS side FROM {events} e""",
    "barrier_labels": """SELECT symbol, CAST(i0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1, CAST(side AS BIGINT) AS side, CAST(barrier AS BIGINT) AS barrier, round(ret, 6) AS ret FROM {trades} t""",
    "label_uniqueness": """SELECT symbol, CAST(i0 AS BIGINT) AS i0, round(avg(1.0 / n), 6) AS uniqueness FROM (SELECT t.symbol, t.i0, t.bar, count(1) OVER (PARTITION BY t.bar) AS n FROM (SELECT symbol, i0, {span} AS bar FROM {trades} t0 WHERE i1 IS NOT NULL) t) x GROUP BY symbol, i0""",
    "trade_stats": """SELECT CAST(count(1) AS BIGINT) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS sd, round(avg(ret) / nullif(stddev_samp(ret) / sqrt(count(1)), 0), 6) AS t, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 4) AS win, round(avg(i1 - i0), 4) AS hold FROM {trades} t""",
    "barrier_payoff": """SELECT barrier AS barrier, CAST(count(1) AS BIGINT) AS n, round(avg(ret), 6) AS mean, round({q05}, 6) AS q05, round({q95}, 6) AS q95 FROM {trades} t GROUP BY barrier""",
    "purged_kfold": """SELECT f.fold AS fold, CAST(count(1) AS BIGINT) AS train FROM (SELECT CAST(fold AS BIGINT) AS fold, min(i0) AS a, max(i1) AS b FROM (SELECT *, ntile(5) OVER (ORDER BY i0, symbol) AS fold FROM {trades} t) x GROUP BY fold) f
        JOIN (SELECT *, ntile(5) OVER (ORDER BY i0, symbol) AS fold FROM {trades} t) t ON CAST(t.fold AS BIGINT) <> f.fold AND NOT (t.i0 <= f.b + 3 AND f.a <= t.i1) GROUP BY f.fold""",
    "sharpe_moments": """SELECT symbol, CAST(count(r) AS BIGINT) AS n, round(avg(r) / nullif(stddev_samp(r), 0), 6) AS sharpe, round({skew_pop}, 6) AS skew FROM {ret} x GROUP BY symbol""",
    "newey_west": """SELECT symbol, round(1 + 2 * (0.75 * avg(x * x1) + 0.5 * avg(x * x2) + 0.25 * avg(x * x3)) / nullif(avg(x * x), 0), 6) AS inflation FROM (SELECT symbol, x, lag(x, 1) OVER (PARTITION BY symbol ORDER BY bar_idx) AS x1, lag(x, 2) OVER (PARTITION BY symbol ORDER BY bar_idx) AS x2, lag(x, 3) OVER (PARTITION BY symbol ORDER BY bar_idx) AS x3
        FROM (SELECT symbol, bar_idx, r - avg(r) OVER (PARTITION BY symbol) AS x FROM {ret} q WHERE r IS NOT NULL) y) z GROUP BY symbol""",
    "max_drawdown": """SELECT symbol, round(min(e - peak), 6) AS drawdown FROM (SELECT symbol, e, max(e) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT symbol, bar_idx, sum(r) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS e FROM {ret} x) y) z GROUP BY symbol""",
    "ou_fit": """SELECT symbol, round(b, 6) AS phi, round(CASE WHEN b > 0 AND b < 1 THEN -ln(b) END, 6) AS kappa, round(CASE WHEN b > 0 AND b < 1 THEN 0.6931471805599453 / -ln(b) END, 4) AS half_life FROM (SELECT symbol, regr_slope(x, x1) AS b FROM (SELECT symbol, ln(close) AS x, lag(ln(close), 1) OVER (PARTITION BY symbol ORDER BY bar_idx) AS x1 FROM {panel} p) y GROUP BY symbol) z""",
    "pairs_correlation": """SELECT a.symbol AS a, b.symbol AS b, CAST(count(1) AS BIGINT) AS n, round(covar_samp(a.r, b.r) / nullif(stddev_samp(a.r) * stddev_samp(b.r), 0), 6) AS corr FROM {ret} a JOIN {ret} b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY a.symbol, b.symbol""",
    "ic_decay": """SELECT h AS h, CAST(count(1) AS BIGINT) AS n, round(covar_samp(score, f) / nullif(stddev_samp(score) * stddev_samp(f), 0), 6) AS ic FROM (SELECT CAST(1 AS BIGINT) AS h, score, lead(ln(close), 1) OVER (PARTITION BY symbol ORDER BY bar_idx) - ln(close) AS f FROM {score} s UNION ALL SELECT CAST(4 AS BIGINT), score, lead(ln(close), 4) OVER (PARTITION BY symbol ORDER BY bar_idx) - ln(close) FROM {score} s2
        UNION ALL SELECT CAST(12 AS BIGINT), score, lead(ln(close), 12) OVER (PARTITION BY symbol ORDER BY bar_idx) - ln(close) FROM {score} s3) x WHERE score IS NOT NULL AND f IS NOT NULL GROUP BY h""",
    "regime_attribution": """SELECT CASE WHEN mk > 0 THEN 'up' ELSE 'down' END AS regime, CAST(count(1) AS BIGINT) AS n, round(avg(x.fwd * x.w), 8) AS mean FROM (SELECT b.ts, b.fwd, b.w, m.mk FROM {book} b JOIN (SELECT ts, avg(r) AS mk FROM {ret} q GROUP BY ts) m ON m.ts = b.ts WHERE b.fwd IS NOT NULL) x GROUP BY CASE WHEN mk > 0 THEN 'up' ELSE 'down' END""",
    "cost_model": """SELECT symbol, tier, round(half_spread, 4) AS half_spread, round(10000 * 0.5 * sd * sqrt(10000 / nullif(adv, 0)), 4) AS impact_bps, round(0.7 * (1.8 + greatest(0.75, 0.35 * half_spread) - half_spread) + 0.3 * (4.5 + half_spread + 10000 * 0.5 * sd * sqrt(10000 / nullif(adv, 0))), 4) AS cost_bps FROM
        (SELECT symbol, adv, sd, CASE WHEN adv >= 1000000 THEN 1 WHEN adv >= 100000 THEN 2 ELSE 3 END AS tier, CASE WHEN adv >= 1000000 THEN 0.4 WHEN adv >= 100000 THEN 1.2 ELSE 4.0 END AS half_spread FROM (SELECT symbol, avg(quote_volume) AS adv, stddev_samp(r) AS sd FROM {ret} x GROUP BY symbol) y) z""",
    "net_orders": """SELECT symbol, round(target - current, 6) AS delta, CASE WHEN current = 0 THEN 'open' WHEN target = 0 THEN 'close' WHEN target * current < 0 THEN 'flip' ELSE 'resize' END AS kind FROM (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.w, 0) AS target, coalesce(b.w, 0) AS current
        FROM (SELECT symbol, w FROM {book} b0 WHERE bar_idx = 200) a FULL OUTER JOIN (SELECT symbol, w FROM {book} b1 WHERE bar_idx = 199) b ON a.symbol = b.symbol) x WHERE abs(target - current) > 0.0001""",
    "net_orders_by_bar": """SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, round(target - current, 6) AS delta, CASE WHEN current = 0 THEN 'open' WHEN target = 0 THEN 'close' WHEN target * current < 0 THEN 'flip' ELSE 'resize' END AS kind FROM (SELECT symbol, bar_idx, target, coalesce(lag(target, 1) OVER (PARTITION BY symbol ORDER BY bar_idx), 0) AS current
        FROM (SELECT p.symbol, p.bar_idx, coalesce(b.w, 0) AS target FROM {panel} p LEFT JOIN {book} b ON b.symbol = p.symbol AND b.bar_idx = p.bar_idx) x) y WHERE abs(target - current) > 0.0001""",
    "eligible_universe": """SELECT symbol, bar_idx FROM (SELECT symbol, bar_idx, avg(quote_volume) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS adv, count(close) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS listed FROM {panel} p) x WHERE adv >= 500000 AND listed >= 30""",
    "hourly_flow": """SELECT symbol, CAST(bar AS STRING) AS bar, round(sum(CASE WHEN side < 0 THEN nz ELSE 0 END), 4) AS sold, round(sum(CASE WHEN side > 0 THEN nz ELSE 0 END), 4) AS bought, round(sum(side * nz) / nullif(sum(nz), 0), 6) AS imbalance FROM {tape} t GROUP BY symbol, bar""",
}

_W = "OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {} AND CURRENT ROW)"
_DIALECT = {
    "spark": {
        "first": "min_by(price, struct(ts, seq))", "last": "max_by(price, struct(ts, seq))", "first_open": "min_by(open, bar_idx)", "last_close": "max_by(close, bar_idx)", "median_p90": "percentile(nz, 0.9D) OVER (PARTITION BY symbol, day)",
        "ffill": "last_value(f) IGNORE NULLS " + _W.format("UNBOUNDED PRECEDING"), "ffill3": "last_value(f) IGNORE NULLS " + _W.format("3 PRECEDING"), "span": "explode(sequence(i0, i1))", "skew_pop": "skewness(r)",
        **{k: f"percentile({x}, {q}D)" for k, x, q in (("median_tot", "tot", 0.5), ("median_dev", "abs(r2.r - q.med)", 0.5), ("median_r", "r3.r", 0.5), ("median_s", "s", 0.5), ("median_sd", "sd", 0.5), ("q05", "ret", 0.05), ("q95", "ret", 0.95))},
    },
    "duck": {
        "first": "first(price ORDER BY ts, seq)", "last": "last(price ORDER BY ts, seq)", "first_open": "first(open ORDER BY bar_idx)", "last_close": "last(close ORDER BY bar_idx)", "median_p90": "quantile_cont(nz, 0.9) OVER (PARTITION BY symbol, day)",
        "ffill": "last_value(f IGNORE NULLS) " + _W.format("UNBOUNDED PRECEDING"), "ffill3": "last_value(f IGNORE NULLS) " + _W.format("3 PRECEDING"), "span": "unnest(generate_series(i0, i1))",
        "skew_pop": "skewness(r) * (count(r) - 2) / sqrt(count(r) * (count(r) - 1))",
        **{k: f"quantile_cont({x}, {q})" for k, x, q in (("median_tot", "tot", 0.5), ("median_dev", "abs(r2.r - q.med)", 0.5), ("median_r", "r3.r", 0.5), ("median_s", "s", 0.5), ("median_sd", "sd", 0.5), ("q05", "ret", 0.05), ("q95", "ret", 0.95))},
    },
}
#: Sources that the queries name, outermost last, so that each is replaced by text with the earlier ones in it.
_PARTS = (("trades", TRADES), ("path", _PATH), ("events", EVENTS), ("book", BOOK), ("score", SCORE), ("ret", RET), ("trade_windows", _TRADE_WINDOWS), ("tape", TAPE))


_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def text(name: str, dialect: str, panel: str) -> str:
    """The query in Spark's or DuckDB's SQL; panel: the name of a view, or a subquery."""
    out = _Q[name]
    for part, body in _PARTS:
        out = out.replace("{" + part + "}", body)
    for key, body in _DIALECT[dialect].items():
        out = out.replace("{" + key + "}", body)
    out = _DECIMAL.sub(r"\1D" if dialect == "spark" else r"CAST(\1 AS DOUBLE)", out).replace("{panel}", panel)
    return out.replace("AS STRING", "AS VARCHAR") if dialect == "duck" else out


NAMES = tuple(_Q)


def duck_sql(name: str) -> str:
    """Shared subqueries once, as common table expressions."""
    double = lambda q: _DECIMAL.sub(r"CAST(\1 AS DOUBLE)", q)
    out, ctes = double(_Q[name]), []
    need = [p for p, _ in _PARTS]
    used: list[str] = []

    def visit(q: str) -> None:
        for p in need:
            if "{" + p + "}" in q and p not in used:
                visit(dict(_PARTS)[p])
                used.append(p)

    visit(out)
    if "{panel}" in out or any("{panel}" in dict(_PARTS)[p] for p in used):
        ctes.append(f"panel_ AS (SELECT * FROM {panel_sql()} x)")
    ctes += [f"{p}_ AS {double(dict(_PARTS)[p])}" for p in used]
    sql = (f"WITH {', '.join(ctes)} " if ctes else "") + out
    for p in [*need, "panel"]:
        sql = sql.replace("{" + p + "}", p + "_")
    for key, body in _DIALECT["duck"].items():
        sql = sql.replace("{" + key + "}", body)
    return sql.replace("AS STRING", "AS VARCHAR")

"""Panel, native, tape, open-interest, liquidation and term-structure signals beside the divisions."""

from __future__ import annotations

from quantloom.functions.expr import CORR, EW, MAX, MED, MIN, RANK, SK, SLOPE, SUM, L, M, Node, S, V, X, absx, clip, col, d, flag, half, lag, neg, op, pos, sgn, sqrt0, tanh, where, where_null, xm

from .formulas import REGISTRY, _semivar, aggr, ac1, beta, bf, big, c, f, h, index, kyle, l, mark, mkt, n_trades, notional, o, oi, ofi, pr, qv, r, ref, roll_bps, rs_hurst, tbb, v, variance_ratio, vwap

FEATURES: dict[str, Node] = {}
G = 14  # hourly windows are divided by this on the weekly grid


def _w(n: int) -> int:
    return max(4, n // G) if n > 30 else n


def _std(x, n):
    return S(x, n, max(3, half(n)))


def _sum(x, n):
    return SUM(x, n, max(2, half(n)))


def mixed_beta(n: int) -> Node:
    """Population covariance over sample variance, as the panel features have it."""
    mp = max(2, half(n))
    return (M(r * mkt, n, mp) - M(r, n, mp) * M(mkt, n, mp)) / V(mkt, n, mp)


def rsi(x, n):
    up, dn = EW(pos(d(x, 1)), alpha=1 / n, adjust=False), EW(pos(-d(x, 1)), alpha=1 / n, adjust=False)
    return 100.0 - 100.0 / (1.0 + up / dn)


def _micro_z(x, n):
    return clip((x - M(x, n, max(5, n // 4))) / S(x, n, max(5, n // 4)), -4.0, 4.0)


_long, _mid, _short = _w(336), _w(168), _w(504)
_br = clip(tbb / v, 0.0, 1.0)
_e = r - mixed_beta(_long) * mkt
_sv = (2.0 * _br - 1.0) * op("sqrt({0})", qv)
_hist = (EW(L(c), 12, adjust=False) - EW(L(c), 26, adjust=False)) - EW(EW(L(c), 12, adjust=False) - EW(L(c), 26, adjust=False), 9, adjust=False)
_mom = lag(L(c), 1) - lag(L(c), 1 + _mid)
_disp = Node("cs", "stddev_samp({0})", (r,))
_fwd = 20
_loi = L(oi)

FEATURES |= {
    "f_xsec_momentum": X(_mom),
    "f_xsec_st_reversal": -X(c / lag(c, 1) - 1.0),
    "f_xsec_low_vol": -X(_std(r, _mid)),
    "f_xsec_idio_vol": -X(_std(_e, _long)),
    "f_xsec_amihud": X(L(M(absx(r) / qv, _mid, half(_mid)))),
    "f_xsec_max": -X(MAX(r, _short, half(_short))),
    "f_xsec_skew": -X(SK(r, _short, half(_short))),
    "f_xsec_52w_high": X(c / MAX(c, 52, 17)),
    "f_xsec_volume_trend": X(L(_sum(qv, _mid) / _sum(qv, _w(720)) * (720 / 168))),
    "f_xsec_turnover_reversal": -X(_sum(qv, _mid)),
    "f_xsec_residual_momentum": X(M(lag(_e, 1), _long, half(_long)) / _std(lag(_e, 1), _long)),
    "f_fund_carry": -X(f),
    "f_fund_momentum": X(M(f, 21, 10)),
    "f_fund_zscore": -((f - M(f, _w(720), _w(720) // 3)) / S(f, _w(720), _w(720) // 3)),
    "f_fund_accel": -X(d(f, 3)),
    "f_flow_imb_momentum": X(M(_br - 0.5, 24, 12)),
    "f_flow_imb_reversal": -X(M(_br - 0.5, 4, 1)),
    "f_flow_signed_vol": X(_sum((2.0 * _br - 1.0) * qv, 24)),
    "f_flow_kyle_lambda": -X(M(r * _sv, _mid, half(_mid)) / M(_sv * _sv, _mid, half(_mid))),
    "f_xcoin_btc_leadlag": X(beta(r, ref, _long, 7) * ref),
    "f_xcoin_peer_return": X(M(r, 6, 1) - xm(M(r, 6, 1))),
    "f_xcoin_spillover_momentum": X(_mom - xm(_mom * CORR(r, mkt, _long, half(_long)))),
    "f_xcoin_dispersion_switch": X(where(_disp > MED(_disp, _w(720), 14), d(L(c), _mid), -d(L(c), _mid))),
    "f_dir_rsi": -X(rsi(c, 14) - 50.0),
    "f_dir_macd": X(_hist),
    "f_dir_ma_cross": X(M(c, 10) / M(c, 50) - 1.0),
    "f_dir_bollinger_z": -X((c - M(c, 20)) / (2.0 * S(c, 20))),
    "f_dir_trend_r2": X(sgn(SLOPE(L(c), 30)) * CORR(L(c), col("CAST(bar_idx AS DOUBLE)"), 30) * CORR(L(c), col("CAST(bar_idx AS DOUBLE)"), 30)),
    "f_dir_donchian_pos": X((c - MIN(l, 20)) / (MAX(h, 20) - MIN(l, 20))),
    "f_transform_hurst": X(rs_hurst(r, 60, 20) - 0.5),
    "f_dep_variance_ratio": X(variance_ratio(r, 5, 60) - 1.0),
    "f_dep_autocorr1": X(CORR(r, lag(r, 1), 44)),
    "f_path_mfe_mae": X((MAX(h, _fwd) / lag(c, _fwd) - 1.0) / (1.0 - MIN(l, _fwd) / lag(c, _fwd) + 1e-9)),
    "f_multi_tf_agreement": X(sgn(d(L(c), 3)) + sgn(d(L(c), 7)) + sgn(d(L(c), 21)) + sgn(d(L(c), 45))),
    "f_multi_fast_slow": X(d(L(c), 7) - d(L(c), 45)),
    "f_vol_yang_zhang": -X(sqrt0(M(pos(0.5 * L(h / l) * L(h / l) / 2.772588722239781 + 0.5 * (0.5 * L(h / l) * L(h / l) - 0.3862943611198906 * L(c / o) * L(c / o))), 20))),
    "f_vol_semivar_skew": _semivar(20, -1.0, 1e-12),
    "f_liq_kyle_bar": -X(M(r * _sv, 30, 15) / M(_sv * _sv, 30, 15)),
    "f_state_vol_regime_mom": X(where(S(r, 20) > MED(S(r, 20), 120, 40), -d(L(c), 20), d(L(c), 20))),
    "f060_leverage_ratio": -X(L(oi * c / M(qv, _mid, half(_mid)))),
    "f061_oi_divergence": X(sgn(d(oi, 24)) * sgn(d(c, 24)) * absx(oi / lag(oi, 24) - 1.0) * sgn(d(c, 24))),
    "f062_funding_level": -X(M(f, 1, 1)),
    "f063_funding_momentum": X(M(f - M(f, 72, 36), 24, 1)),
    "f064_term_structure": -X(M(mark - index, 8, 1)),
    "f065_xvenue_funding": -X(M(f - pr, 6, 1)),
    "f066_liq_cascade": -X(pos(_micro_z(op("ln(1 + {0})", col("liq_total") / oi), _w(336))) * sgn(d(c, 6))),
    "f067_liq_imbalance": X(M((col("liq_long") - col("liq_short")) / (col("liq_long") + col("liq_short")), 12, 1)),
    "f068_liq_magnet": X(pos(0.05 - absx(c / M(c, 24, 12) - 1.0)) * pos(oi / lag(oi, 24) - 1.0) * sgn(d(c, 24))),
    "f070_basis_carry": -X(M(f * 1095.0, 3, 1)),
    "m_ofi_momentum": tanh(0.7 * _micro_z(SUM(ofi, 6, 1), 40)),
    "m_ofi_reversal": -tanh(0.7 * _micro_z(ofi, 40)),
    "m_aggr_imb_persist": tanh(3.0 * M(aggr, 8, 2)),
    "m_cum_delta_slope": tanh(2.0 * (SUM(ofi, 12, 1) / (SUM(notional, 12, 2) + 1e-9))),
    "m_big_trade_follow": tanh(2.0 * M(big, 4, 1)),
    "m_vwap_tilt": tanh(0.8 * _micro_z((c - vwap) / c, 40)),
    "m_vwap_reversion": -tanh(0.8 * _micro_z((c - vwap) / c, 40)),
    "m_kyle_lambda_fade": -sgn(SUM(r, 3, 1)) * flag(_micro_z(kyle, 60) > 1.0),
    "m_spread_regime_fade": -sgn(r) * flag(_micro_z(roll_bps, 60) > 1.0),
    "m_signac_momentum": sgn(SUM(r, 6, 1)) * flag(M(ac1, 20, 5) > 0.45),
    "m_intensity_breakout": pos(tanh(0.8 * (n_trades / M(n_trades, 30, 5) - 1.0))) * sgn(ofi),
    "m_ofi_plus_vwap": tanh(0.5 * (_micro_z(SUM(ofi, 6, 1), 40) + _micro_z((c - vwap) / c, 40))),
    "oi_leverage_state": -X(L(oi * c / M(qv, 12, 6))),
    "oi_accel_rev": -X(d(d(_loi, 12), 12)),
    "liq_sell_spike": clip(_micro_z(op("ln(1 + {0})", col("liq_long")), 40), -5.0, 5.0),
    "liq_imb_reversal": M((col("liq_long") - col("liq_short")) / (col("liq_long") + col("liq_short")), 3, 1),
    "liq_intensity_rev": _micro_z(op("ln(1 + {0})", col("liq_total")), 40) * -sgn(SUM(r, 4)),
    "term_fade": -M(_micro_z(mark / index - 1.0, 52), 24, 1),
    "term_follow": d(_micro_z(mark / index - 1.0, 52), 24),
    "term_revert": -M(mark / index - 1.0 - M(mark / index - 1.0, 52, 8), 24, 1),
    "feat_momentum": d(L(c), 20),
    "feat_xsec_rank": RANK(d(L(c), 20)),
    "feat_vol": op("sqrt({0})", EW(r * r, alpha=2 / 51, adjust=False)),
}
#: Features whose SQL twin is not expressible: recursions without adjustment and lambda-based windows.
NO_SQL = {"f_dir_rsi", "f_dir_macd", "f_transform_hurst", "feat_vol"}
__all__ = ["FEATURES", "NO_SQL", "REGISTRY", "bf", "neg", "where_null"]

"""Recursive indicators against plain definitions on small series."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import recursive as R

RNG = np.random.default_rng(5)
CLOSE = 100 * np.exp(np.cumsum(RNG.normal(0, 0.02, 200)))
HIGH, LOW = CLOSE * (1 + RNG.random(200) / 50), CLOSE * (1 - RNG.random(200) / 50)


@pytest.mark.parametrize("n", [5, 20])
def test_ema_is_a_weighted_sum(n):
    k, out = 2 / (n + 1), R.ema(CLOSE, n)
    assert np.isnan(out[: n - 1]).all()
    for t in (n - 1, n, n + 7, 199):
        steps = t - (n - 1)
        weights = k * (1 - k) ** np.arange(steps)
        assert out[t] == pytest.approx((1 - k) ** steps * CLOSE[:n].mean() + (weights * CLOSE[t : t - steps : -1]).sum())


def test_macd_begins_with_its_signal():
    out = R.macd_line(CLOSE, 12, 26)
    assert np.isnan(out[:33]).all() and not np.isnan(out[33:]).any()


def test_rsi_bounds_and_extremes():
    assert np.nanmax(R.rsi(np.arange(1.0, 40), 14)) == 100 and np.nanmin(R.rsi(np.arange(40.0, 1, -1), 14)) == 0
    assert np.nanmax(R.rsi(np.ones(30), 14)) == 0
    out = R.rsi(CLOSE, 14)
    assert np.isnan(out[:14]).all() and ((out[14:] >= 0) & (out[14:] <= 100)).all()


def test_atr_of_a_constant_range():
    close = np.full(40, 10.0)
    out = R.wilder(R.true_range(close + 1, close - 1, close), 14, 1)
    assert np.isnan(out[:14]).all() and np.allclose(out[14:], 2)


def test_adx_of_a_straight_trend():
    out = R.adx(np.arange(60) + 1.0, np.arange(60) + 0.0, np.arange(60) + 0.5, 10)
    assert np.isnan(out[:19]).all() and np.allclose(out[19:], 100)
    assert R.adx(HIGH[:15], LOW[:15], CLOSE[:15], 10).tolist() == pytest.approx([np.nan] * 15, nan_ok=True)


def test_kama_follows_a_straight_line_fast_and_noise_slowly():
    line = np.arange(100.0)
    assert abs(R.kama(line, 10)[-1] - line[-1]) < 2
    noise = 50 + np.where(np.arange(100) % 2, 1.0, -1.0)
    out = R.kama(noise, 10)[10:]
    assert np.abs(np.diff(out)).max() < 0.01


def test_sar_stays_on_the_other_side():
    out = R.parabolic_sar(np.arange(1.0, 41), np.arange(0.0, 40))
    assert np.isnan(out[0]) and (out[1:] <= np.arange(0.0, 40)[1:]).all() and (np.diff(out[1:]) >= 0).all()
    out = R.parabolic_sar(HIGH, LOW)
    below = out[1:] <= LOW[1:]
    above = out[1:] >= HIGH[1:]
    assert (below | above).all()


def test_hilbert_period_of_a_sine():
    t = np.arange(400)
    line, period = R.hilbert(100 + 5 * np.sin(2 * np.pi * t / 20))
    assert np.isnan(line[:63]).all() and np.isnan(period[:32]).all()
    assert abs(period[-100:].mean() - 20) < 1.5 and np.abs(line[-100:] - 100).max() < 2


def test_stochastic_flat_series_is_zero():
    k, d = R.stochastic(np.ones(20), 5, 3)
    assert np.isnan(k[:6]).all() and (k[6:] == 0).all() and (d[6:] == 0).all()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(1, 1e4), min_size=0, max_size=90))
def test_any_series_gives_every_column(values):
    x = np.array(values, float)
    frame = pd.DataFrame({"symbol": 1, "trade_date": pd.date_range("2020-01-01", periods=len(x)), "high": x * 1.01, "low": x * 0.99, "close": x})
    out = R.compute(frame)
    assert list(out.columns) == ["symbol", "trade_date", *R.RECURSIVE] and len(out) == len(x)


def test_recursions_without_a_join(spark, small):
    from pyspark.sql import functions as F

    from tidemark.operators.clustering import profiles
    from tidemark.plans.indicators import KEYS, featured_bars
    from tidemark.schema import PCA_INPUT
    from tidemark.sources import adapters

    bars, wanted = adapters.bars(spark, small), ["RSI14", "KAMA10", "HT_DCPERIOD"]
    joined = bars.join(R.recursive_indicators(bars, wanted), KEYS).select(*KEYS, "close", *wanted).orderBy(*KEYS).collect()
    assert R.with_recursive(bars, wanted).select(*KEYS, "close", *wanted).orderBy(*KEYS).collect() == joined
    found = profiles(featured_bars(spark, small), list(PCA_INPUT))
    assert found._jdf.queryExecution().executedPlan().toString().count("+- Exchange hashpartitioning") == 1
    days = bars.groupBy("symbol").agg(F.countDistinct("trade_date").alias("n_days")).collect()
    assert sorted(found.select("symbol", "n_days").collect()) == sorted(days)

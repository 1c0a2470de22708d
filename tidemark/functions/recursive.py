"""Indicators whose value depends on the one before, back to the first bar.

One grouped pass computes all of them: a symbol's bars go to one Arrow group, arrays in, arrays out. The recursions are
sequential by definition; a symbol's history is the unit of work, so its length bounds a task.
"""

from __future__ import annotations

import math

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Periods of the indicators.
EMA_PERIODS = (5, 10, 15, 20)
MACD_PERIODS = ((5, 10), (5, 20), (10, 20), (15, 20), (12, 26))
MACD_SIGNAL = 9
RSI_PERIODS = (14, 8)
ADX_PERIODS = (5, 10, 20)
KAMA_PERIODS = (10, 20, 30)
ATR_PERIOD = 14
STOCH_RSI = (14, 5, 3)
SAR_STEP, SAR_LIMIT = 0.02, 0.2


def _blank(n: int) -> np.ndarray:
    return np.full(n, np.nan)


def ema(x: np.ndarray, n: int, seed_at: int | None = None) -> np.ndarray:
    """Exponential average, seeded at place ``seed_at`` (default n - 1) with the mean of the n values up to it."""
    at = n - 1 if seed_at is None else seed_at
    out = _blank(len(x))
    if len(x) <= at:
        return out
    k = 2 / (n + 1)
    value = x[at - n + 1 : at + 1].mean()
    out[at] = value
    for i in range(at + 1, len(x)):
        value += k * (x[i] - value)
        out[i] = value
    return out


def macd_line(x: np.ndarray, fast: int, slow: int, signal: int = MACD_SIGNAL) -> np.ndarray:
    """Fast minus slow average, both seeded where the slow one begins; shown once the signal line has begun, too."""
    out = ema(x, fast, slow - 1) - ema(x, slow)
    out[: slow - 1 + signal - 1] = np.nan
    return out


def wilder(x: np.ndarray, n: int, first: int) -> np.ndarray:
    """Wilder's average: the mean of x[first : first + n], then (n - 1) parts old and one new."""
    out = _blank(len(x))
    at = first + n - 1
    if len(x) <= at:
        return out
    value = x[first : at + 1].mean()
    out[at] = value
    for i in range(at + 1, len(x)):
        value = (value * (n - 1) + x[i]) / n
        out[i] = value
    return out


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """100 a / b; 0 where b is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(b), np.nan, np.where(b == 0, 0.0, 100 * a / b))


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    change = np.diff(close, prepend=np.nan)
    gain, loss = wilder(np.maximum(change, 0), n, 1), wilder(np.maximum(-change, 0), n, 1)
    return _share(gain, gain + loss)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    return np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    """Average directional index; its sums begin with n - 1 bars and decay by an n-th, as Wilder's worksheet has it."""
    out = _blank(len(close))
    if len(close) < 2 * n:
        return out
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    moves = np.stack([plus, minus, true_range(high, low, close)])
    sums = moves[:, 1:n].sum(axis=1)
    dx = _blank(len(close))
    for i in range(n, len(close)):
        sums = sums - sums / n + moves[:, i]
        p, m, t = sums
        if t:
            both = p + m
            dx[i] = 100 * abs(p - m) / both if both else (dx[i - 1] if i > n else 0.0)
        else:
            dx[i] = dx[i - 1] if i > n else 0.0
    out[:] = wilder(dx, n, n)
    return out


def kama(x: np.ndarray, n: int) -> np.ndarray:
    """Kaufman's adaptive average: its speed follows how straight the last n changes were."""
    out = _blank(len(x))
    if len(x) <= n:
        return out
    quick, slow = 2 / 3, 2 / 31
    steps = np.abs(np.diff(x))
    value = x[n - 1]
    for i in range(n, len(x)):
        path = steps[i - n : i].sum()
        way = abs(x[i] - x[i - n])
        straight = 1.0 if path <= way or path == 0 else way / path
        value += (straight * (quick - slow) + slow) ** 2 * (x[i] - value)
        out[i] = value
    return out


def parabolic_sar(high: np.ndarray, low: np.ndarray, step: float = SAR_STEP, limit: float = SAR_LIMIT) -> np.ndarray:
    """Wilder's stop and reverse: it starts short if the second bar falls further than it rises."""
    n = len(high)
    out = _blank(n)
    if n < 2:
        return out
    rise, fall = high[1] - high[0], low[0] - low[1]
    rising = not (fall > rise and fall > 0)
    stop, extreme, speed = (low[0], high[1], step) if rising else (high[0], low[1], step)
    low_prev, high_prev = low[1], high[1]  # the first comparison is of the second bar with itself
    for i in range(1, n):
        lo, hi = low[i], high[i]
        if rising:
            if lo <= stop:  # reversed: the extreme becomes the stop
                rising = False
                stop = max(extreme, high_prev, hi)
                out[i] = stop
                speed, extreme = step, lo
                stop = max(stop + speed * (extreme - stop), high_prev, hi)
            else:
                out[i] = stop
                if hi > extreme:
                    extreme, speed = hi, min(speed + step, limit)
                stop = min(stop + speed * (extreme - stop), low_prev, lo)
        elif hi >= stop:
            rising = True
            stop = min(extreme, low_prev, lo)
            out[i] = stop
            speed, extreme = step, hi
            stop = min(stop + speed * (extreme - stop), low_prev, lo)
        else:
            out[i] = stop
            if lo < extreme:
                extreme, speed = lo, min(speed + step, limit)
            stop = max(stop + speed * (extreme - stop), high_prev, hi)
        low_prev, high_prev = lo, hi
    return out


def hilbert(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ehlers' instantaneous trendline and dominant cycle period, by the homodyne discriminator.

    The price is smoothed over four bars, detrended and split into in-phase and quadrature parts by seven-tap Hilbert
    filters whose gain follows the last period; the angle between successive phasors gives the period.
    """
    n = len(x)
    line, period_out = _blank(n), _blank(n)
    if not n:
        return line, period_out
    smooth = np.convolve(x, [0.4, 0.3, 0.2, 0.1])[:n]
    detrended, quadrature, in_phase = np.zeros(n), np.zeros(n), np.zeros(n)
    ji, jq = np.zeros(n), np.zeros(n)
    i2 = q2 = re = im = period = smooth_period = 0.0
    trend = np.zeros(n)
    sums = np.concatenate([[0.0], np.cumsum(x)])

    def filtered(values: np.ndarray, i: int, gain: float) -> float:
        return gain * (0.0962 * values[i] + 0.5769 * values[i - 2] - 0.5769 * values[i - 4] - 0.0962 * values[i - 6])

    for i in range(n):
        if i >= 12:
            gain = 0.075 * period + 0.54
            detrended[i] = filtered(smooth, i, gain)
            quadrature[i] = filtered(detrended, i, gain)
            in_phase[i] = detrended[i - 3]
            ji[i], jq[i] = filtered(in_phase, i, gain), filtered(quadrature, i, gain)
            last_i2, last_q2 = i2, q2
            i2 = 0.2 * (in_phase[i] - jq[i]) + 0.8 * i2
            q2 = 0.2 * (quadrature[i] + ji[i]) + 0.8 * q2
            re = 0.2 * (i2 * last_i2 + q2 * last_q2) + 0.8 * re
            im = 0.2 * (i2 * last_q2 - q2 * last_i2) + 0.8 * im
            before = period
            if re and im and (turn := math.atan(im / re)):
                period = 2 * math.pi / turn
            if before:
                period = min(max(period, 0.67 * before), 1.5 * before)
            period = min(max(period, 6.0), 50.0)
            period = 0.2 * period + 0.8 * before
            smooth_period = 0.33 * period + 0.67 * smooth_period
        whole = int(smooth_period + 0.5)
        taken = min(whole, i + 1)
        trend[i] = (sums[i + 1] - sums[i + 1 - taken]) / taken if taken else x[i]
        if i >= 32:
            period_out[i] = smooth_period
        if i >= 63:
            line[i] = 0.4 * trend[i] + 0.3 * trend[i - 1] + 0.2 * trend[i - 2] + 0.1 * trend[i - 3]
    return line, period_out


def stochastic(x: np.ndarray, k: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of a series in its range of the last k, and the mean of the last d such places; both from where both exist."""
    frame = pd.Series(x)
    low, high = frame.rolling(k).min().to_numpy(), frame.rolling(k).max().to_numpy()
    raw = _share(x - low, high - low)
    smooth = pd.Series(raw).rolling(d).mean().to_numpy()
    return np.where(np.isnan(smooth), np.nan, raw), smooth


def compute(frame: pd.DataFrame, wanted: tuple[str, ...] | None = None) -> pd.DataFrame:
    """The wanted recursive indicators of one symbol's bars, by default all; what nobody asks for is not computed."""
    frame = frame.sort_values("trade_date")
    high, low, close = (frame[c].to_numpy(float) for c in ("high", "low", "close"))
    n, k, d = STOCH_RSI
    ways = {f"ema{n}": lambda n=n: ema(close, n) for n in EMA_PERIODS}
    ways |= {f"macd{f}{s}": lambda f=f, s=s: macd_line(close, f, s) for f, s in MACD_PERIODS}
    ways |= {f"RSI{n}": lambda n=n: rsi(close, n) for n in RSI_PERIODS}
    ways |= {f"ADX{n}": lambda n=n: adx(high, low, close, n) for n in ADX_PERIODS}
    ways |= {f"KAMA{n}": lambda n=n: kama(close, n) for n in KAMA_PERIODS}
    ways |= {"SAR": lambda: parabolic_sar(high, low), "ATR": lambda: wilder(true_range(high, low, close), ATR_PERIOD, 1)}
    stoch, wave = cache(lambda: stochastic(rsi(close, n), k, d)), cache(lambda: hilbert(close))
    ways |= {"fastksr": lambda: stoch()[0], "fastdsr": lambda: stoch()[1], "HT_TRENDLINE": lambda: wave()[0], "HT_DCPERIOD": lambda: wave()[1]}
    out = {"symbol": frame["symbol"].to_numpy(), "trade_date": frame["trade_date"].to_numpy()}
    return pd.DataFrame(out | {c: ways[c]() for c in wanted or RECURSIVE}).replace({np.nan: None})


RECURSIVE = (
    *[f"ema{n}" for n in EMA_PERIODS], *[f"macd{f}{s}" for f, s in MACD_PERIODS], *[f"RSI{n}" for n in RSI_PERIODS],
    *[f"ADX{n}" for n in ADX_PERIODS], *[f"KAMA{n}" for n in KAMA_PERIODS], "SAR", "ATR", "fastksr", "fastdsr", "HT_TRENDLINE", "HT_DCPERIOD",
)


def recursive_indicators(bars: DataFrame, columns: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """``symbol, trade_date`` and the recursive indicators ``columns``, by default all."""
    wanted = tuple(columns or RECURSIVE)
    schema = f"symbol {dict(bars.dtypes)['symbol']}, trade_date date, " + ", ".join(f"{c} double" for c in wanted)
    return bars.select("symbol", "trade_date", "high", "low", "close").groupBy("symbol").applyInPandas(lambda frame: compute(frame, wanted), schema)


def with_recursive(bars: DataFrame, columns: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """``bars`` with the recursive indicators ``columns``, by default all, without a join.

    A symbol's bars are one row of arrays while its recursions run, and rows again after that. The key stays the column that
    it was, so the result is still dealt by symbol: windows by symbol that follow need no shuffle.
    """
    wanted = tuple(columns or RECURSIVE)
    kept = [c for c in bars.columns if c != "symbol"]

    @F.pandas_udf("array<array<double>>")
    def lines(day: pd.Series, high: pd.Series, low: pd.Series, close: pd.Series) -> list:
        found = compute(pd.DataFrame({"symbol": 0, "trade_date": day[0], "high": high[0], "low": low[0], "close": close[0]}), wanted)
        return [found[c].tolist() for c in wanted]

    packed = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("trade_date", *[c for c in kept if c != "trade_date"]))).alias("_bars"))
    # a window of one row: of what runs Python, Spark knows of windows alone that their rows stay where they are
    given = [F.col("_bars.trade_date"), *[F.col(f"_bars.{c}").cast("array<double>") for c in ("high", "low", "close")]]
    ran = packed.withColumn("_lines", lines(*given).over(Window.partitionBy("symbol")))
    rows = ran.select("symbol", F.explode(F.arrays_zip("_bars", *[F.get("_lines", F.lit(k)).alias(c) for k, c in enumerate(wanted)])).alias("_row"))
    return rows.select("symbol", *[F.col(f"_row._bars.{c}").alias(c) for c in kept], *[F.col(f"_row.{c}").alias(c) for c in wanted])

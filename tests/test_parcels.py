import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import histories, parcels
from tidemark.plans import similarity
from tidemark.sources import adapters

SCHEMA = "symbol long, trade_date date, amount double, quantity double, major long, minor int"


def listed(df):
    return sorted((tuple(map(str, r)) for r in df.select("symbol", "trade_date", "close", "volume").collect()))


def by_rows(trades):
    """The same by rows: bars, then histories."""
    c = F.col
    return histories.histories(adapters.daily_bars(trades, c("symbol"), c("trade_date"), F.try_divide("amount", "quantity"), c("quantity"), [c("major"), c("minor")]).select("symbol", "trade_date", "close", "volume"))


def test_parcels_give_the_histories_of_rows(spark, small):
    assert listed(similarity._histories(spark, small)) == listed(histories.histories(similarity._closes(spark, small)))


@pytest.mark.parametrize("rows", [1, 3, 1 << 19])
def test_odd_trades(spark, rows):
    d, inf, nan = dt.date(1999, 1, 1), float("inf"), float("nan")
    given = [
        (1, d, 10.5, 2.0, 5, 1), (1, d, 11.0, 2.0, 5, 2), (1, d, 99.0, 1.0, None, 9), (1, d, 98.0, 3.0, 4, None), (1, dt.date(1969, 12, 30), 1 / 3, 0.7, 1, 1),
        (1, None, 3.0, 1.0, 1, 1), (1, None, 4.0, 1.0, 2, 1), (None, d, 5.0, 2.0, 1, 1), (None, d, 6.0, 2.0, 1, 1), (2, d, None, 2.0, 1, 1), (2, d, 3.0, None, 1, 1),
        (2, d, 3.0, 0.0, 9, 9), (3, d, -0.0, 4.0, 1, 1), (4, d, nan, 2.0, 1, 1), (5, d, inf, 2.0, 1, 1), (5, d, 1e300, 1e-5, 1, 0), (-7, d, 1e17, 2.0, -3, 1), (-7, d, 2.0, 2.0, -4, 1), (1 << 62, d, 0.07, 0.29, 1 << 62, 1),
    ]
    trades = spark.createDataFrame(given, SCHEMA).repartition(3)
    got = parcels.histories_of_trades(trades, rows=rows)
    assert listed(got) == listed(by_rows(trades)) and [t for _, t in got.dtypes] == [t for _, t in by_rows(trades).dtypes]
    assert parcels.histories_of_trades(trades.limit(0)).count() == 0


def test_a_packed_trade_takes_a_third_of_a_row():
    """Rows of line items took some 30 bytes of the shuffle."""
    rng, n = np.random.default_rng(3), 20_000
    symbol = np.sort(rng.integers(0, 1000, n))
    day = rng.integers(8036, 10561, n)
    day = day[np.lexsort((day, symbol))]
    quantity = rng.integers(1, 51, n).astype(float)
    columns = {"symbol": symbol, "trade_date": day, "major": rng.integers(0, 150_000, n), "minor": rng.integers(1, 8, n), "amount": np.round(quantity * rng.uniform(900, 2100, n), 2), "quantity": quantity}
    value = parcels.packed(columns)
    assert len(value) < 12 * n
    back = parcels.unpacked(value)
    assert all((back[c].view(np.int64) == x.view(np.int64)).all() for c, x in columns.items())


def test_histories_shuffle_parcels_only(spark, small):
    """Trades used to be shuffled as rows of six columns."""
    plan = similarity._histories(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan

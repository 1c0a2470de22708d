"""How the query modules register what they have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is there already")
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def rounded(value: Column, digits: int = 4) -> Column:
    """``value`` rounded half up in double arithmetic, as the oracles do it; NaN becomes NULL."""
    scale = float(10**digits)
    return F.floor(F.nanvl(value, F.lit(None).cast("double")) * scale + 0.5) / scale


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[rounded(F.col(n), digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])

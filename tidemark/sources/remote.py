"""A remote price source as a Python data source: symbols are its partitions, requests are limited and retried.

What fetches a symbol's rows is a plug-in, named ``module:function``, so nothing here needs a network.
"""

from __future__ import annotations

import importlib
import re
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds and requests of a window; a minute's and an hour's by default.
LIMITS = ((60.0, 18), (3600.0, 1000))
DEFAULT_WAIT, PAD = 65.0, 1.0


class RateLimiter:
    """Sliding windows: ``acquire`` returns when a request may go. Clock and sleep can be replaced in tests."""

    def __init__(self, limits: Sequence[tuple[float, int]] = LIMITS, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.limits, self.clock, self.sleep = limits, clock, sleep
        self.sent: deque[float] = deque()

    def wait(self) -> float:
        """Seconds until the next request may go."""
        now, needed = self.clock(), 0.0
        for span, most in self.limits:
            recent = [t for t in self.sent if now - t < span]
            if len(recent) >= most:
                needed = max(needed, recent[-most] + span - now + PAD)
        return needed

    def acquire(self) -> None:
        while (seconds := self.wait()) > 0:
            self.sleep(seconds)
        self.sent.append(self.clock())
        longest = max(span for span, _ in self.limits)
        while self.sent and self.clock() - self.sent[0] > longest:
            self.sent.popleft()


def told_wait(message: str) -> float:
    """The seconds that an error message asks for, and five more; a default where it names none."""
    found = re.search(r"(\d+)\s*(?:s\b|sec|second|giây)", message, re.IGNORECASE)
    return float(found[1]) + 5 if found else DEFAULT_WAIT


def with_retry(call: Callable[[], object], attempts: int = 5, limited: Callable[[Exception], bool] = lambda e: "limit" in str(e).lower(), sleep: Callable[[float], None] = time.sleep):
    """``call()``; a limit waits as told, another error 1, 2, 4 .. seconds; the last error is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception as error:
            if k == attempts - 1:
                raise
            sleep(told_wait(str(error)) if limited(error) else float(2**k))


def parse_symbols(text: str, every: Callable[[], list[str]], default: Sequence[str], read: Callable[[str], str] | None = None) -> list[str]:
    """A symbol list: empty for the default, ``all``, ``@file`` with one a line, or comma-separated; upper case, in order, each once."""
    if not text:
        found = list(default)
    elif text.lower() == "all":
        found = every()
    elif text.startswith("@"):
        found = [line for line in (read or (lambda p: open(p).read()))(text[1:]).splitlines() if not line.lstrip().startswith("#")]
    else:
        found = text.split(",")
    return list(dict.fromkeys(s.strip().upper() for s in found if s.strip()))


def crawl(symbols: Sequence[str], fetch: Callable[[str], list[tuple]], limiter: RateLimiter | None = None, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> tuple[dict[str, list[tuple]], dict[str, str]]:
    """Rows by symbol, and for each symbol that could not be fetched the last error: one that fails does not stop the others."""
    limiter = limiter or RateLimiter(sleep=sleep)
    rows, failed = {}, {}

    def one(symbol: str) -> list[tuple]:
        limiter.acquire()
        return list(fetch(symbol))

    for symbol in dict.fromkeys(symbols):
        try:
            rows[symbol] = with_retry(lambda symbol=symbol: one(symbol), attempts, sleep=sleep)
        except Exception as error:
            failed[symbol] = f"{type(error).__name__}: {error}"
    return rows, failed


class _Symbol(InputPartition):
    def __init__(self, symbol: str):
        self.symbol = symbol


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s) for s in parse_symbols(self.options.get("symbols", ""), list, ())] or [_Symbol("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.symbol:
            return
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        limiter = RateLimiter()
        limiter.acquire()
        for row in with_retry(lambda: list(fetch(partition.symbol, self.options.get("interval", "1m")))):
            yield (partition.symbol, *row)


class RemotePrices(DataSource):
    """``spark.read.format("remote_prices").option("fetch", "module:function").option("symbols", "A,B")``."""

    @classmethod
    def name(cls) -> str:
        return "remote_prices"

    def schema(self) -> str:
        return "stock_symbol string, time string, open string, high string, low string, close string, volume string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def normalise(raw: DataFrame, offset: str = "+07:00", least: int = 30) -> DataFrame:
    """Fetched rows as ticks: numbers where they are, time with its offset; without a close, or from a symbol of fewer than ``least`` rows, none."""
    number: Callable[[str], Column] = lambda c: F.col(c).try_cast("double")
    stamp = F.date_format(F.try_to_timestamp(F.col("time")), f"yyyy-MM-dd HH:mm:ss'{offset}'")
    known = raw.select("stock_symbol", stamp.alias("date"), *[number(c).alias(c) for c in ("close", "high", "low", "open")], F.col("volume").try_cast("double").cast("long").alias("volume")).filter("close IS NOT NULL AND date IS NOT NULL")
    return known.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("stock_symbol"))).filter(F.col("_n") >= least).drop("_n")

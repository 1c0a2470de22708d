"""Histories from trades: the one shuffle sends parcels of packed columns instead of rows.

A trade is a row of 56 bytes to a shuffle, of which some 30 stay when it is compressed. Here a task sorts the trades that
it reads by symbol and day and packs those of each part of the symbols column by column, as differences and whole numbers
where they are such, into one compressed value; the part's task unpacks them and makes bars and histories at once.
Everything is exact: numbers that are not whole after scaling are packed as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trades that a task sorts and packs at once, and about as many that one part has.
ROWS = 1 << 19
#: Stand for unknown symbols and places, and for unknown days: before all others.
NO_PLACE, NO_DAY = np.iinfo(np.int64).min, np.iinfo(np.int32).min
WHOLE = ("symbol", "trade_date", "major", "minor")
SCALED = {"amount": 100.0, "quantity": 100.0}
CODEC = "zstd"


def _number(column: pa.Array, unknown: int) -> np.ndarray:
    whole = column.cast(pa.int32()) if pa.types.is_date(column.type) else column
    return whole.cast(pa.int64()).fill_null(unknown).to_numpy(zero_copy_only=False)


def _whole(x: np.ndarray, scale: float) -> np.ndarray | None:
    """``x`` as whole numbers from which division by ``scale`` gives the same doubles; None where it would not."""
    with np.errstate(all="ignore"):
        out = np.rint(x * scale)
        if not (np.abs(out) < 1 << 53).all():  # NaN and infinity, too
            return None
    out = out.astype(np.int64)  # which has no negative zero
    return out if ((out / scale).view(np.int64) == x.view(np.int64)).all() else None


def packed(columns: dict[str, np.ndarray]) -> bytes:
    """The columns of some trades as one compressed value: whole numbers as differences, bytes of equal place together."""
    flags, rows = 0, []
    for c in WHOLE:
        rows.append(np.diff(columns[c], prepend=np.int64(0)))
    for bit, (c, scale) in enumerate(SCALED.items()):
        x = _whole(columns[c], scale)
        flags |= (x is None) << bit
        rows.append(columns[c].view(np.int64) if x is None else x)
    n = len(rows[0])
    planes = np.ascontiguousarray(np.stack(rows)).view(np.uint8).reshape(len(rows), n, 8).transpose(0, 2, 1)
    return np.array([n, flags], np.int64).tobytes() + pa.compress(planes.tobytes(), CODEC, asbytes=True)


def unpacked(value: bytes) -> dict[str, np.ndarray]:
    n, flags = np.frombuffer(value[:16], np.int64).tolist()
    names = [*WHOLE, *SCALED]
    planes = np.frombuffer(pa.decompress(value[16:], 8 * n * len(names), CODEC, asbytes=True), np.uint8).reshape(len(names), 8, n)
    rows = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(len(names), n)
    out = {c: np.cumsum(rows[k]) for k, c in enumerate(WHOLE)}
    for bit, (c, scale) in enumerate(SCALED.items()):
        x = rows[len(WHOLE) + bit]
        out[c] = x.view(np.float64) if flags >> bit & 1 else x / scale
    return out


def _sent(batches: Iterator[pa.RecordBatch], parts: int, rows: int) -> Iterator[pa.RecordBatch]:
    """``part, parcel`` of the trades that have a price."""

    def parcels(waiting: list[dict]) -> Iterator[pa.RecordBatch]:
        columns = {c: np.concatenate([w[c] for w in waiting]) for c in waiting[0]}
        part = ((columns["symbol"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
        order = np.lexsort((columns["trade_date"], columns["symbol"], part))
        part, columns = part[order], {c: x[order] for c, x in columns.items()}
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for lo, hi in zip(cuts, [*cuts[1:], len(part)], strict=True):
            value = packed({c: x[lo:hi] for c, x in columns.items()})
            yield pa.RecordBatch.from_arrays([pa.array([int(part[lo])], pa.int32()), pa.array([value], pa.binary())], ["part", "parcel"])

    waiting, n = [], 0
    for batch in batches:
        amount, quantity = batch.column("amount"), batch.column("quantity")
        priced = amount.is_valid().to_numpy(zero_copy_only=False) & quantity.is_valid().to_numpy(zero_copy_only=False) & (quantity.fill_null(0.0).to_numpy(zero_copy_only=False) != 0)
        if not priced.any():
            continue
        columns = {c: _number(batch.column(c), NO_DAY if c == "trade_date" else NO_PLACE)[priced] for c in WHOLE}
        waiting.append(columns | {c: batch.column(c).fill_null(0.0).to_numpy(zero_copy_only=False)[priced] for c in SCALED})
        n += len(waiting[-1]["symbol"])
        if n >= rows:
            yield from parcels(waiting)
            waiting, n = [], 0
    if n:
        yield from parcels(waiting)


def _received(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histories of all the symbols of a part."""
    found = [unpacked(v) for batch in batches for v in batch.column("parcel").to_pylist()]
    if not found:
        return
    columns = {c: np.concatenate([f.pop(c) for f in found]) for c in (*WHOLE, *SCALED)}
    with np.errstate(all="ignore"):
        price = columns.pop("amount") / columns["quantity"]
    order = np.lexsort((price, columns["minor"], columns["major"], columns["trade_date"], columns["symbol"]))
    symbol, day, quantity, price = columns["symbol"][order], columns["trade_date"][order], columns["quantity"][order], price[order]
    first = np.flatnonzero(np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (day[1:] != day[:-1])]))
    volume, close = np.add.reduceat(quantity, first), price[np.append(first[1:], len(price)) - 1]
    symbol, day = symbol[first], day[first]
    starts = np.append(np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])), len(symbol))
    named = symbol[starts[:-1]]
    for lo in range(0, len(named), 256):  # symbols at once
        ends = starts[lo : lo + 257]
        days, offsets = slice(ends[0], ends[-1]), pa.array((ends - ends[0]).astype(np.int32))
        dates = pa.array(day[days].astype(np.int32), pa.int32(), mask=day[days] == NO_DAY).cast(pa.date32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (dates, pa.array(close[days]), pa.array(volume[days]))]
        some = named[lo : lo + 256]
        yield pa.RecordBatch.from_arrays([pa.array(some, mask=some == NO_PLACE), *lists], ["symbol", "trade_date", "close", "volume"])


def histories_of_trades(trades: DataFrame, rows: int = ROWS) -> DataFrame:
    """What ``histories`` gives of the ``daily_bars`` of ``trades`` with ``symbol, trade_date, amount, quantity, major, minor``.

    A price is an amount per quantity; trades without one are ignored. A day closes with the price of its last trade by
    ``major`` and ``minor``, then by price, unknown places first.
    """
    slim = trades.select(
        *[F.col(c).cast("long").alias(c) for c in ("symbol", "major", "minor")], F.col("trade_date").cast("date").alias("trade_date"),
        *[F.col(c).cast("double").alias(c) for c in SCALED],
    )
    parts = max(int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-trades.count() // rows))
    sent = slim.mapInArrow(lambda batches: _sent(batches, parts, rows), "part int, parcel binary")
    return sent.repartitionById(parts, "part").mapInArrow(_received, "symbol long, trade_date array<date>, close array<double>, volume array<double>")

"""Array arithmetic as higher-order column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import let

TINY = 1e-12


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; NULL for vectors that are missing, empty or of different lengths."""
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), total(F.zip_with(a, b, lambda x, y: x * y)))


def doubles(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def unit(values: Column) -> Column:
    """``values`` over their length; zeros where it is tiny."""

    def scaled(xs: Column) -> Column:
        size = F.sqrt(total(F.transform(xs, lambda x: x * x)))
        return let(size, lambda s: F.transform(xs, lambda x: F.when(s > TINY, x / F.greatest(s, F.lit(TINY))).otherwise(0.0)))

    return let(values, scaled)


def z_scores(values: Column) -> Column:
    """Deviations from the mean in population standard deviations; zeros for a flat series."""

    def scaled(xs: Column) -> Column:
        def by(mean: Column) -> Column:
            spread = F.sqrt(total(F.transform(xs, lambda x: (x - mean) * (x - mean))) / F.nullif(F.size(xs), F.lit(0)))
            return let(spread, lambda sd: F.transform(xs, lambda x: F.when(sd > TINY, (x - mean) / F.greatest(sd, F.lit(TINY))).otherwise(0.0)))

        return let(total(xs) / F.nullif(F.size(xs), F.lit(0)), by)

    return let(values, scaled)


def hyperplanes(dim: int, n_bits: int, seed: int) -> np.ndarray:
    """Gaussian normals, one a bit, the same for every market that is compared."""
    return np.random.RandomState(seed).randn(n_bits, dim)


def literal(matrix: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in matrix])


def with_bit_buckets(items: DataFrame, planes: np.ndarray, band_bits: int, column: str = "vector") -> DataFrame:
    """``items`` with ``band_buckets``, as ``bit_buckets`` gives them, one matrix product for each Arrow batch."""
    n_bands = len(planes) // band_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column(column).to_pylist(), float).reshape(batch.num_rows, -1)
            bits = np.where(rows @ planes.T >= 0, "1", "0") if batch.num_rows else np.empty((0, len(planes)), str)
            keys = [[f"{b}:{''.join(row[b * band_bits : (b + 1) * band_bits])}" for b in range(n_bands)] for row in bits]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.string()))], [*batch.schema.names, "band_buckets"])

    return items.mapInArrow(run, T.StructType([*items.schema.fields, T.StructField("band_buckets", T.ArrayType(T.StringType()))]))


def bit_buckets(vector: Column, planes: np.ndarray, band_bits: int) -> Column:
    """``"band:bits"`` of each band; a bit is 1 where the vector lies on the plane's side or on the plane."""
    n_bands = len(planes) // band_bits

    def bits(v: Column) -> Column:
        signs = F.transform(literal(planes), lambda p: F.when(total(F.zip_with(p, v, lambda x, y: x * y)) >= 0, "1").otherwise("0"))
        return F.array_join(signs, "")

    def keys(text: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda b: F.concat(b.cast("string"), F.lit(":"), F.substring(text, b * band_bits + 1, F.lit(band_bits))))

    return let(vector, lambda v: let(bits(v), keys))

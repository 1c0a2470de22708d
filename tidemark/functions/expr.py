"""Ways of composing column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once however often ``body`` names it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

"""Random numbers as column expressions: a draw depends on its number and its stream alone, so it is the same on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(number: Column, stream: int) -> Column:
    """Between 0 and 1, both excluded: the upper 53 bits of a hash of the number and the stream."""
    return (F.shiftrightunsigned(F.xxhash64(number.cast("long"), F.lit(stream).cast("long")), 11) + 0.5) / float(1 << 53)


def normal(number: Column, stream: int) -> Column:
    """Standard normal, by Box and Muller from two uniform draws; it stays inside generated code."""
    return F.sqrt(-2 * F.log(uniform(number, 2 * stream))) * F.cos(2 * math.pi * uniform(number, 2 * stream + 1))

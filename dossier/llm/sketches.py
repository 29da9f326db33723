"""Distance of sketches that hold a parity of their items in every bit, as arrays of 64-bit numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def turned_bits(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ, the larger folded once; null where one is missing or more than twice the other."""

    def folded(a: Column, other: Column) -> Column:
        half = F.size(other)
        halves = F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(a) == 2 * half, halves).otherwise(a)

    bits = F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.when(x.isNotNull() & y.isNotNull(), F.aggregate(bits, F.lit(0), lambda total, one: total + one))

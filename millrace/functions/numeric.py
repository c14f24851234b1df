"""Low-discrepancy points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def radical_inverse(index: Column, base: int, digits: int) -> Column:
    """The index's digits in ``base`` mirrored at the point; ``digits`` of them."""
    powers = F.array(*[F.lit(base**k).cast("bigint") for k in range(digits + 1)])

    def add(total, k):
        low = F.pmod(index, F.element_at(powers, k + 1)) - F.pmod(index, F.element_at(powers, k))
        return total + (low / F.element_at(powers, k)) / F.element_at(powers, k + 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), F.lit(0.0), add)


def halton_inside(index: Column, digits2: int = 40, digits3: int = 25) -> Column:
    """Whether the index's Halton point (bases 2 and 3) lies in the circle inscribed in the unit square.

    Indexes of more digits are an error: 40 and 25 digits are enough below 847,288,609,443.
    """
    most = min(2**digits2, 3**digits3) - 1
    index = F.when(index.between(0, most), index).otherwise(F.raise_error(F.lit(f"an index must be from 0 to {most}")).cast("bigint"))
    x, y = radical_inverse(index, 2, digits2) - 0.5, radical_inverse(index, 3, digits3) - 0.5
    return x * x + y * y <= 0.25

"""Hierarchical interval bins as column expressions.

Level k of ``depth`` has 8 ** k bins; a span belongs to the smallest bin that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SHIFT, DEPTH = 14, 8
TABIX_DEPTH = 5


def _first(level: int) -> int:
    return ((1 << 3 * level) - 1) // 7


def bin_of(start: Column, end: Column, depth: int = DEPTH, min_shift: int = MIN_SHIFT) -> Column:
    """The bin of a 1-based inclusive span."""
    out = F.lit(0).cast("long")
    for level in range(1, depth + 1):
        shift = min_shift + 3 * (depth - level)
        lo, hi = F.shiftright(start - 1, shift), F.shiftright(end - 1, shift)
        out = F.when(lo == hi, lo + _first(level)).otherwise(out)
    return out


def bins_overlapping(start: Column, end: Column, depth: int = DEPTH, min_shift: int = MIN_SHIFT) -> Column:
    """All bins that can hold a span overlapping this one."""
    levels = []
    for level in range(depth + 1):
        shift = min_shift + 3 * (depth - level)
        levels.append(F.sequence(F.shiftright(start - 1, shift) + _first(level), F.shiftright(end - 1, shift) + _first(level)))
    return F.flatten(F.array(*levels))


def overlapping(lo: int, hi: int, bin_column: str = "bin", start: str = "start", end: str = "end") -> Column:
    """Rows that overlap a span, told by their bin first: on each level the bins from that of
    lo to that of hi, whose rows begin no earlier than the first of them."""
    near = F.lit(False)
    for level in range(DEPTH + 1):
        shift = MIN_SHIFT + 3 * (DEPTH - level)
        a, b = (lo - 1) >> shift, (hi - 1) >> shift
        near = near | (F.col(bin_column).between(_first(level) + a, _first(level) + b) & (F.col(start) > (a << shift)))
    return near & (F.col(start) <= hi) & (F.col(end) >= lo)

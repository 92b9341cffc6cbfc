"""Pages of a table by descending key, found by counting ranges of keys.

Sorting to reach page p would keep and move p pages of rows. Here the keys are cut into ranges, counted
in one pass, and the counts added up from the top tell which ranges hold the page; a range that
is still large is cut again. Only the last range is sorted, and its bounds reach the scan as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 256
# rows of a range that are sorted rather than cut again
MOST_SORTED = 100_000


@dataclass(frozen=True)
class KeyRange:
    """Rows with low <= key < high, None for no bound. NULL keys are below all others."""

    low: object = None
    high: object = None

    def holds(self, key: str) -> Column:
        condition = F.lit(True) if self.high is None else F.col(key) < F.lit(self.high)
        if self.low is not None:
            return condition & (F.col(key) >= F.lit(self.low))
        return condition | F.col(key).isNull()


def _cuts(rows: DataFrame, key: str) -> list:
    """Keys that cut the rows into ranges of about one size: those of the least hashes."""
    drawn = rows.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key)).limit(RANGES - 1)
    return sorted({r[0] for r in drawn.collect()})


def page_range(
    rows: DataFrame, key: str, skip: int, limit: int, most_sorted: int = MOST_SORTED
) -> tuple[KeyRange, int, int]:
    """The range that holds the page, the rows to skip within it, and the number of all rows."""
    keys = rows.select(key)
    total = left = keys.count()
    found = KeyRange()
    while left > most_sorted:
        inside = keys.where(found.holds(key))
        cuts = _cuts(inside, key)
        if not cuts:
            break
        place = F.size(F.filter(F.lit(cuts), lambda cut: cut <= F.col(key)))
        counts = dict(inside.groupBy(place.alias("place")).count().collect())
        above, wanted = 0, []
        for i in range(len(cuts), -1, -1):
            n = counts.get(i, 0)
            if above + n > skip and above < skip + limit and n:
                wanted.append((i, above))
            above += n
        if not wanted:  # beyond the last row
            return KeyRange(low=cuts[-1], high=cuts[-1]), 0, total
        top, lowest = wanted[0], wanted[-1][0]
        held = sum(counts.get(i, 0) for i in range(lowest, top[0] + 1))
        if held == left:
            break
        found = KeyRange(
            low=cuts[lowest - 1] if lowest else found.low,
            high=cuts[top[0]] if top[0] < len(cuts) else found.high,
        )
        skip, left = skip - top[1], held
    return found, skip, total


def page_of(
    rows: DataFrame, key: str, page: int, limit: int, most_sorted: int = MOST_SORTED
) -> tuple[DataFrame, int]:
    """One page by ``key`` descending, and the number of all rows."""
    found, skip, total = page_range(rows, key, (page - 1) * limit, limit, most_sorted)
    return rows.where(found.holds(key)).orderBy(F.desc(key)).offset(skip).limit(limit), total

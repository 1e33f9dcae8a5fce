"""Bounded samples whose rows depend on their values only."""

import math

from pyspark.sql import DataFrame, functions as F

#: Values of the hash that the first cut looks at.
SPAN = 1 << 24


def drawn(df: DataFrame, most: int, *keys: str, total: int | None = None) -> list:
    """The rows with the smallest hashes of `keys`, `most` of them at most.

    A first cut by the hash leaves about twice as many in the whole table, so
    tasks send a few rows each, however large the table is. Rows of equal keys
    stand or fall together, so with many of these there may be fewer rows.
    """
    total = df.count() if total is None else total
    if not total:
        return []
    place = F.pmod(F.xxhash64(*keys), F.lit(SPAN))
    few = df.where(place < math.ceil(min(1.0, (2 * most + 50) / total) * SPAN))
    return few.orderBy(place, *keys).limit(most).collect()

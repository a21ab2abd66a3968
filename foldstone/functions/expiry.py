"""Write-time expiry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAX = (1 << 63) - 1


def expired(write_ms: Column, ttl_ms: int, now_ms: Column) -> Column:
    """ttl > 0 and write_ms + ttl <= now; the sum saturates, and TTL <= 0 never expires, nor does what has no write time."""
    if ttl_ms <= 0:
        return F.lit(False)
    return F.when(write_ms.isNull() | (write_ms > _MAX - ttl_ms), F.lit(False)).otherwise(write_ms + ttl_ms <= now_ms)


def live_elements(elements: Column, alive) -> Column:
    """Elements of a list for which alive(element) holds."""
    return F.filter(elements, alive)


def tail_from_first(elements: Column, wanted) -> Column:
    """The list from its first element for which wanted(element) holds; empty if there is none."""
    first = F.array_position(F.transform(elements, wanted), F.lit(True))
    return F.when(first > 0, F.slice(elements, first.cast("int"), F.size(elements))).otherwise(F.slice(elements, 1, 0))

"""List state: APPEND adds, PUT restarts the list, DELETE empties it.

The last reset of a key is an aggregate that combines map-side; the log is then
joined with it, so a key with a third of the log is split by the skew join
instead of passing through one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.functions import expiry


def live_elements(ops: DataFrame, *by: str, ttl_ms: int = -1, now_ms: Column | None = None) -> DataFrame:
    """The rows of ops that are list elements now; each expires by its own write time.

    An append behind a delete, or behind elements that have all expired, starts a new list.
    """
    by = list(by or ("key",))
    resets = ops.where(F.col("op").isin("PUT", "DELETE")).groupBy(*by).agg(F.max("seq").alias("reset_seq"))
    rows = ops.where(F.col("op") != "DELETE").join(resets, by, "left").where(F.col("reset_seq").isNull() | (F.col("seq") >= F.col("reset_seq"))).drop("reset_seq")
    return rows if now_ms is None else rows.where(~expiry.expired(F.col("write_ms"), ttl_ms, now_ms))


def list_state(elements: DataFrame, *by: str, order: tuple[str, ...] = ()) -> DataFrame:
    """(key, elements array) in order of (seq, pos), or of seq where there is no pos. A place seen twice counts once."""
    by, order = by or ("key",), order or (("seq", "pos") if "pos" in elements.columns else ("seq",))
    place = lambda e: F.struct(*[e[c] for c in order])
    found = elements.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "value"))).alias("__e"))
    once = F.filter("__e", lambda e, i: (i == 0) | (place(e) != place(F.get(F.col("__e"), i - 1))))
    return found.select(*by, F.transform(once, lambda e: e["value"]).alias("elements"))


def remove_first(elements: Column, value: Column) -> Column:
    """Without the first element equal to value; empty lists are to be dropped by the caller."""
    at = F.array_position(elements, value).cast("int")
    return F.when(at > 0, F.concat(F.slice(elements, F.lit(1), at - 1), F.slice(elements, at + 1, F.size(elements)))).otherwise(elements)


def remove_equal(elements: Column, values: Column) -> Column:
    """Without every element that values holds; duplicates of the others stay."""
    return F.filter(elements, lambda e: ~F.array_contains(values, e))


def non_empty(state: DataFrame) -> DataFrame:
    return state.where(F.size("elements") > 0)


def multi_get(keys: DataFrame, state: DataFrame, *by: str) -> DataFrame:
    by = list(by or ("key",))
    return non_empty(state).join(keys.select(*by).dropna().distinct(), by, "left_semi")

"""Key groups, order-preserving hashes, subtask and bucket ranges, as column arithmetic.

Raw hashes are non-negative 31-bit integers held in BIGINT; M is the maximum
parallelism (1 to 32768), P a parallelism, B a number of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS, MOST_GROUPS = 31, 1 << 15
SPACE = 1 << HASH_BITS


def _check(m: int) -> None:
    if not 1 <= m <= MOST_GROUPS:
        raise ValueError(f"the maximum parallelism must be 1 to {MOST_GROUPS}")


def raw_hash(key: Column) -> Column:
    """A multiplicative hash of an integer key of any size, the same in every engine; reduced first, so nothing overflows."""
    return F.pmod(F.pmod(key, F.lit(SPACE)) * F.lit(2654435761), F.lit(SPACE))


def bytes_hash(key: Column) -> Column:
    """The hash of a string (UTF-8) or binary key: from 1, 31 times what there is plus the next byte, modulo 2^31."""
    digits = F.hex(key)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(key), F.lit(1))), lambda i: F.substring(digits, 2 * i - 1, F.lit(2)))
    held = F.filter(each, lambda x: x != "")
    return F.when(key.isNotNull(), F.aggregate(held, F.lit(1).cast("long"), lambda h, x: F.pmod(h * 31 + F.conv(x, 16, 10).cast("long"), F.lit(SPACE))))


def composite_hash(*keys: Column) -> Column:
    """The hash of several keys, each a string or binary, with their lengths between them so that borders count."""
    parts = [p for k in keys for p in (F.octet_length(k).cast("string"), F.lit(":"), F.hex(k))]
    return bytes_hash(F.concat(*parts))


def key_group(raw: Column, m: int) -> Column:
    _check(m)
    return F.pmod(raw, F.lit(m))


def encode(raw: Column, m: int) -> Column:
    """Hashes sorted by their code are sorted by (key group, quotient)."""
    _check(m)
    base, extra = divmod(SPACE, m)
    group = key_group(raw, m)
    return (group * base + F.least(group, F.lit(extra)) + F.floor(raw / m)).cast("long")


def encode_pow2(raw: Column, m: int) -> Column:
    """encode() for a power of two: the group's bits move to the front."""
    _check(m)
    bits = m.bit_length() - 1
    if 1 << bits != m:
        raise ValueError("not a power of two")
    return F.shiftleft(key_group(raw, m), HASH_BITS - bits).bitwiseOR(F.shiftrightunsigned(raw, bits))


def decode(code: Column, m: int) -> Column:
    """The key group of a code."""
    _check(m)
    base, extra = divmod(SPACE, m)
    long_span = extra * (base + 1)
    return F.when(code < long_span, F.floor(code / (base + 1))).otherwise(F.floor((code - long_span) / base) + extra).cast("long")


def subtask_of(group: Column, m: int, p: int) -> Column:
    return F.floor(group * p / m).cast("long")


def subtask_range(i: Column, m: int, p: int) -> tuple[Column, Column]:
    """First and last key group of subtask i of p."""
    return F.ceil(i * m / p).cast("long"), (F.ceil((i + 1) * m / p) - 1).cast("long")


def group_start(group: Column, m: int) -> Column:
    """Smallest code of a key group; of group m, one past the largest code."""
    base, extra = divmod(SPACE, m)
    return group * base + F.least(group, F.lit(extra))


def _quotient(a: Column, b: Column) -> Column:
    """Integer division of non-negative longs, exact while the quotient stays below 2^50."""
    return F.round((a - F.pmod(a, b)) / b).cast("long")


def bucket(code: Column, start: Column, span: Column, b: int) -> Column:
    """Bucket of a code inside a task whose codes are start … start + span - 1."""
    return _quotient((code - start) * F.lit(b).cast("long"), span)


def bucket_range(k: Column, start: Column, span: Column, b: int) -> tuple[Column, Column]:
    """First and last code of bucket k: the inverse of bucket()."""
    at = lambda x: start + _quotient(x.cast("long") * span + (b - 1), F.lit(b).cast("long"))
    return at(k), at(k + 1) - 1

import pytest
from pyspark.sql import functions as F

from foldstone.functions import keygroups as k

#: Maximum parallelism, raw hash, code.
GOLDEN = [(3, 1, 0x2AAAAAAB), (129, 0x12345678, 0x0C0C5014), (30000, 0x12345678, 0x54E3F50C), (32767, 0x7FFFFFFF, 0x00020005)]


@pytest.mark.parametrize("m, raw, code", GOLDEN)
def test_golden_codes(spark, m, raw, code):
    row = spark.range(1).select(k.encode(F.lit(raw).cast("long"), m).alias("c")).first()
    assert row.c == code


@pytest.mark.parametrize("m", [1, 2, 3, 128, 129, 30000, 32767, 32768])
def test_codes_sort_by_group_and_decode(spark, m):
    raw = spark.range(4000).select(k.raw_hash(F.col("id") * 7919 + 13).alias("raw")).union(spark.sql("SELECT CAST(0 AS BIGINT) UNION ALL SELECT CAST(2147483647 AS BIGINT)"))
    rows = raw.distinct().select("raw", k.key_group(F.col("raw"), m).alias("kg"), k.encode(F.col("raw"), m).alias("code")).withColumn("back", k.decode(F.col("code"), m)).collect()
    assert all(r.back == r.kg == r.raw % m for r in rows)
    assert [r.raw for r in sorted(rows, key=lambda r: r.code)] == [r.raw for r in sorted(rows, key=lambda r: (r.kg, r.raw))]
    assert all(0 <= r.code < 1 << 31 for r in rows)


@pytest.mark.parametrize("m", [1, 2, 128, 32768])
def test_power_of_two_is_the_general_code(spark, m):
    raw = spark.range(1000).select(k.raw_hash(F.col("id")).alias("raw"))
    assert raw.where(k.encode(F.col("raw"), m) != k.encode_pow2(F.col("raw"), m)).count() == 0


@pytest.mark.parametrize("m, p", [(128, 1), (128, 3), (128, 5), (7, 7), (32768, 11)])
def test_subtask_ranges_tile_the_groups(spark, m, p):
    lo, hi = k.subtask_range(F.col("id"), m, p)
    ranges = spark.range(p).select(lo.alias("lo"), hi.alias("hi")).orderBy("lo").collect()
    assert [g for r in ranges for g in range(r.lo, r.hi + 1)] == list(range(m))
    owners = {r.g: r.t for r in spark.range(m).select(F.col("id").alias("g"), k.subtask_of(F.col("id"), m, p).alias("t")).collect()}
    assert all(ranges[t].lo <= g <= ranges[t].hi for g, t in owners.items())


#: Codes of a task that owns groups 8 to 15 of 1024, and their buckets of 1024.
BUCKETS = [(16777216, 0), (16793599, 0), (16793600, 1), (25165823, 511), (25165824, 512), (33554431, 1023)]


def test_buckets_and_their_ranges(spark):
    start, span = F.lit(16777216).cast("long"), F.lit(16777216).cast("long")
    codes = spark.createDataFrame(BUCKETS, "code long, expected long")
    at = codes.withColumn("b", k.bucket(F.col("code"), start, span, 1024))
    lo, hi = k.bucket_range(F.col("b"), start, span, 1024)
    for r in at.select("code", "expected", "b", lo.alias("lo"), hi.alias("hi")).collect():
        assert r.b == r.expected and r.lo <= r.code <= r.hi and r.hi - r.lo == 16383


def test_uneven_bucket_ranges_invert_the_map(spark):
    start, span, b = 715827883, 715827883, 341
    rows = spark.range(b).select("id", *[c.alias(n) for c, n in zip(k.bucket_range(F.col("id"), F.lit(start), F.lit(span), b), ("lo", "hi"))])
    ends = rows.select("id", F.explode(F.array("lo", "hi")).alias("code"))
    assert ends.where(k.bucket(F.col("code"), F.lit(start), F.lit(span), b) != F.col("id")).count() == 0


def test_keys_of_any_size_and_type(spark):
    rows = spark.createDataFrame([(2**63 - 1,), (-(2**63),), (4 * 10**9,), (-1,), (7,)], "key long").select("key", k.raw_hash(F.col("key")).alias("raw")).collect()
    assert all(r.raw == (r.key * 2654435761) % k.SPACE for r in rows)
    texts = ["", "a", "é🙂", "x" * 300]

    def by_hand(raw):
        h = 1
        for b in raw:
            h = (31 * h + b) % k.SPACE
        return h

    found = spark.createDataFrame([(t, bytearray(t.encode())) for t in texts] + [(None, None)], "t string, b binary").select("t", k.bytes_hash(F.col("t")).alias("x"), k.bytes_hash(F.col("b")).alias("y")).collect()
    assert all(r.x == r.y == (None if r.t is None else by_hand(r.t.encode())) for r in found)
    pair = spark.createDataFrame([("ab", "c"), ("a", "bc")], "p string, q string").select(k.composite_hash(F.col("p"), F.col("q")).alias("h")).collect()
    assert pair[0].h != pair[1].h


def test_limits():
    for m in (0, 32769):
        with pytest.raises(ValueError):
            k.key_group(F.lit(1), m)
    with pytest.raises(ValueError):
        k.encode_pow2(F.lit(1), 3)

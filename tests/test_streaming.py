"""Live state over several micro-batches: equal to the fold, readable from the checkpoint, restorable."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from foldstone.operators import lists, values
from foldstone.sources import items, logs
from foldstone.streaming import live

SCHEMA = "key long, op string, value double, seq long"


def run_stream(spark, folder, out, checkpoint, processor, schema=SCHEMA, initial=None):
    ops = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = live.run(ops, processor, initial).writeStream.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", checkpoint)
    query = query.trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return query


def split(ops, folder):
    for part in (ops.where("seq < 400"), ops.where("seq >= 400")):
        part.coalesce(1).write.mode("append").parquet(folder)


def latest(spark, out):
    return spark.read.parquet(out).groupBy("key").agg(F.max_by(F.struct("*"), "batch").alias("r")).select("r.*")


def test_value_state_over_batches(spark, sf_dir, tmp_path):
    ops = logs.null_rules(logs.event_ops(logs.table(spark, sf_dir, "events")), "value").select("key", "op", "value", "seq")
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    split(ops, folder)
    query = run_stream(spark, folder, out, checkpoint, live.ValueProcessor())
    expected = {r.key: r.value for r in values.value_state(ops.withColumn("write_ms", F.lit(0))).collect()}
    assert {r.key: r.value for r in latest(spark, out).collect() if r.value is not None} == expected
    saved = items.read_live_state(spark, checkpoint, "value")
    assert {r.key.key: r.value.value for r in saved.collect()} == expected
    assert live.progress(query)["rows"] >= len(expected)
    # restore: the saved items start a new query, and later writes win
    initial = saved.select(F.col("key.key").alias("key"), F.lit("PUT").alias("op"), F.col("value.value").alias("value"), F.lit(0).cast("long").alias("seq"))
    later = ops.sparkSession.createDataFrame([(next(iter(expected)), "PUT", -1.0, 1), (10**6, "PUT", -2.0, 2)], SCHEMA)
    restored = {r.key: r.value for r in live.run(later, live.ValueProcessor(), initial).collect()}
    assert restored[next(iter(expected))] == -1.0 and restored[10**6] == -2.0


def test_list_state_over_batches(spark, sf_dir, tmp_path):
    ops = logs.null_rules(logs.event_ops(logs.table(spark, sf_dir, "events"), "list"), "list").select("key", "op", "value", "seq", "write_ms")
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    split(ops.drop("write_ms"), folder)
    run_stream(spark, folder, out, checkpoint, live.ListProcessor())
    expected = {r.key: r.elements for r in lists.list_state(lists.live_elements(ops)).collect()}
    assert {r.key: r.elements for r in latest(spark, out).collect() if r.elements} == expected


def test_timers_fire_in_event_time(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "key long, ts_ms long, op string, seq long, at timestamp"
    rows = [(1, 60_000, "ADD", 1, 10), (1, 60_000, "ADD", 2, 10), (2, 60_000, "ADD", 3, 10), (2, 60_000, "REMOVE", 4, 10), (3, 10**9, "ADD", 5, 10)]
    # the watermark of a batch comes from the batches before it
    later, last = [(9, 10**9, "ADD", 6, 600)], [(9, 2 * 10**9, "ADD", 7, 601)]
    for part in (rows, later, last):
        spark.createDataFrame(part, "key long, ts_ms long, op string, seq long, at_s long").withColumn("at", F.timestamp_seconds("at_s")).drop("at_s").coalesce(1).write.mode("append").parquet(folder)
    ops = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("at", "0 seconds")
    fired = live.run(ops, live.TimerProcessor(), time_mode="eventTime")
    query = fired.writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(out)).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(1, 60_000)]


class Store:
    """A state of one key in memory that counts its calls."""

    def __init__(self, kind):
        self.kind, self.calls = kind, 0
        self.clear()

    def clear(self):
        self.calls += 1
        self.now = {"value": None, "list": [], "map": {}}[self.kind]

    def get(self):
        self.calls += 1
        return self.now if self.kind == "value" else iter(self.now)

    def exists(self):
        self.calls += 1
        return bool(self.now)

    def update(self, value):
        self.calls += 1
        self.now = value

    def put(self, elements):
        self.calls += 1
        self.now = list(elements)

    def appendList(self, elements):
        self.calls += 1
        self.now = self.now + list(elements)

    def appendValue(self, element):
        self.appendList([element])

    def iterator(self):
        self.calls += 1
        return iter(self.now.items())

    def containsKey(self, key):
        self.calls += 1
        return key in self.now

    def updateValue(self, key, value):
        self.calls += 1
        self.now = {**self.now, key: value}

    def removeKey(self, key):
        self.calls += 1
        self.now = {k: v for k, v in self.now.items() if k != key}


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Store("value"))

    def getListState(self, name, *_):
        return self.states.setdefault(name, Store("list"))

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Store("map"))

    def calls(self):
        return sum(s.calls for s in self.states.values())


PROCESSORS = [(live.ValueProcessor, ()), (live.ReducingProcessor, (max,)), (live.AggregatingProcessor, ()), (live.ListProcessor, ()), (live.MapProcessor, ())]


@pytest.mark.parametrize("kind, args", PROCESSORS, ids=[k.__name__ for k, _ in PROCESSORS])
def test_calls_to_the_store_do_not_grow_with_a_batch(kind, args):
    """1,000 operations in one batch, in batches of 250 and one by one leave the same state and report."""

    def op(i):
        # deletes of a subkey, of the whole, and none in the last batch of 250
        return Row(key=7, op="DELETE" if i < 750 and i % 90 == 5 else "APPEND" if i % 4 else "PUT" if i % 60 == 0 else "APPEND", subkey=None if i % 180 == 5 else i % 5, value=None if i % 11 == 3 else float(i), seq=i)

    ops = [op(i) for i in range(1000)]
    ends = {}
    for size in (1000, 250, 1):
        handle, processor = Handle(), kind(*args)
        processor.init(handle)
        before = handle.calls()
        for start in range(0, 1000, size):
            part = ops[start : start + size]
            reported = [*processor.handleInputRows((7,), iter(part[::-1] + part[:3]), None)]
        if size > 1:
            assert handle.calls() - before <= 12 * (1000 // size)
        ends[size] = reported, {name: state.now for name, state in handle.states.items()}
    assert ends[1000] == ends[250] == ends[1]


@pytest.mark.parametrize("processor", [live.MapProcessor(), live.ReducingProcessor(max)], ids=["map", "reduce"])
def test_state_with_deletes_over_batches(spark, tmp_path, processor):
    rows = [(1, "PUT", 1, 5.0, 1), (1, "PUT", 2, 6.0, 2), (2, "PUT", 1, 9.0, 3), (3, "PUT", 1, 4.0, 4), (4, "PUT", 1, 3.0, 5)]
    later = [(1, "DELETE", 1, None, 11), (1, "PUT", 3, 2.0, 12), (2, "DELETE", None, None, 13), (2, "PUT", 4, 1.0, 14), (3, "DELETE", 1, None, 15), (4, "PUT", 1, 7.0, 16), (5, "DELETE", None, None, 17)]
    last = [(1, "PUT", 2, 8.0, 21), (2, "PUT", 4, 0.0, 2), (3, "DELETE", 9, None, 22), (4, "DELETE", None, None, 23)]
    schema = "key long, op string, subkey int, value double, seq long"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for part in (rows, later, last):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    run_stream(spark, folder, out, checkpoint, processor, schema)
    if isinstance(processor, live.MapProcessor):
        assert {r.key: r.entries for r in latest(spark, out).collect()} == {1: {2: 8.0, 3: 2.0}, 2: {4: 1.0}, 3: {}, 4: {}, 5: {}}
    else:
        assert {r.key: r.value for r in latest(spark, out).collect()} == {1: 8.0, 2: 1.0, 3: None, 4: None, 5: None}


def test_map_entries_are_stored_many_in_a_call():
    """1,000 entries of a key take a few calls, and so does a change of some of them later; what is left is the whole map."""
    handle, processor = Handle(), live.MapProcessor()
    processor.init(handle)
    seq, expected = iter(range(10**6)), {}

    def batch(subkeys, op="PUT"):
        rows = [Row(key=7, op=op, subkey=k, value=None if op == "DELETE" else float(k), seq=next(seq)) for k in subkeys]
        before = handle.calls()
        (reported,) = processor.handleInputRows((7,), iter(rows), None)
        expected.update({k: float(k) for k in subkeys}) if op == "PUT" else [expected.pop(k, None) for k in subkeys]
        assert reported["entries"] == expected
        return handle.calls() - before

    spread = [k * 1_000_003 % 2**32 - 2**31 for k in range(1000)]
    assert batch(spread) <= 20
    assert batch(spread[:3]) <= 6
    assert batch(spread[10:], "DELETE") <= 24
    assert batch([2**31 - 1, -(2**31), 0]) <= 4
    assert batch(list(expected), "DELETE") <= 6
    assert batch(spread[:5]) <= 5


def test_large_maps_over_batches(spark, tmp_path):
    """Buckets of the real store, grown, partly changed and shrunk, one of them by a clear of the whole map."""
    schema = "key long, op string, subkey int, value double, seq long"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    first = [(key, "PUT", k, float(k), k) for key in (1, 2) for k in range(700)]
    second = [(1, "PUT", 5, -5.0, 1000), (1, "DELETE", 6, None, 1001), (2, "DELETE", None, None, 1002), (2, "PUT", 9, 9.5, 1003)]
    third = [(1, "DELETE", k, None, 2000 + k) for k in range(10, 700)]
    for part in (first, second, third):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    run_stream(spark, folder, out, checkpoint, live.MapProcessor(), schema)
    assert {r.key: r.entries for r in latest(spark, out).collect()} == {1: {**{k: float(k) for k in range(10) if k != 6}, 5: -5.0}, 2: {9: 9.5}}

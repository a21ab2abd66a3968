"""State kinds live: the operations of a log applied to keyed state as they arrive.

One stateful operator per kind, on transformWithState and the RocksDB state
store. Operations of a key are applied by sequence number inside a micro-batch
and those not newer than what the key has seen are ignored, so a replayed batch
changes nothing. After a batch each touched key reports its state. Folding the
same log as a batch gives the same answer.

A call to the store is a round trip between two processes. So the operations of
a batch change a copy of their key's state: what they need of it is read once,
nothing of a key not seen before, and what they leave is written once.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """RocksDB as the state store; also starts the coordinator that batch queries with state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    _ = spark.streams.active


class _HeldValue:
    """A value state within one batch of one key."""

    def __init__(self, state):
        self.state = state

    def begin(self, fresh: bool) -> None:
        self.fresh, self.known, self.changed, self.value = fresh, fresh, False, None

    def get(self) -> tuple | None:
        if not self.known:
            self.known, self.value = True, self.state.get()
        return self.value

    def update(self, value: tuple | None) -> None:
        self.known, self.changed, self.value = True, True, value

    def clear(self) -> None:
        self.update(None)

    def commit(self) -> None:
        if self.changed and self.value is not None:
            self.state.update(self.value)
        elif self.changed and not self.fresh:
            self.state.clear()


class _HeldList:
    """A list state within one batch of one key."""

    CHUNK = 10_000  # elements in a message

    def __init__(self, state):
        self.state = state

    def begin(self, fresh: bool) -> None:
        self.fresh, self.reset, self.added = fresh, False, []

    def get(self) -> list[tuple]:
        return [*(() if self.fresh or self.reset else self.state.get()), *self.added]

    def put(self, elements: list[tuple]) -> None:
        self.reset, self.added = True, list(elements)

    def appendValue(self, element: tuple) -> None:
        self.added.append(element)

    def clear(self) -> None:
        self.put([])

    def commit(self) -> None:
        if self.reset and not self.fresh:
            self.state.clear()
        for start in range(0, len(self.added), self.CHUNK):
            self.state.appendList(self.added[start : start + self.CHUNK])


class _HeldMap:
    """A map state within one batch of one key."""

    def __init__(self, state):
        self.state = state

    def begin(self, fresh: bool) -> None:
        self.fresh, self.known, self.reset, self.entries, self.stored, self.touched = fresh, fresh, False, {}, set(), set()

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        self._read()
        return iter(self.entries.items())

    def updateValue(self, key: tuple, value: tuple) -> None:
        self._read()
        self.entries[key] = value
        self.touched.add(key)

    def removeKey(self, key: tuple) -> None:
        self._read()
        self.entries.pop(key, None)
        self.touched.add(key)

    def clear(self) -> None:
        self.known, self.reset, self.entries, self.stored, self.touched = True, True, {}, set(), set()

    def commit(self) -> None:
        if self.reset and not self.fresh:
            self.state.clear()
        for key in self.touched:
            if key in self.entries:
                self.state.updateValue(key, self.entries[key])
            elif key in self.stored:
                self.state.removeKey(key)

    def _read(self) -> None:
        if not self.known:
            self.known, self.entries = True, dict(self.state.iterator())
            self.stored = set(self.entries)


class _HeldPackedMap:
    """A map of ints to doubles within one batch of one key, stored in buckets of many entries.

    The store has no call for several entries of a map. So an entry of the stored map is a bucket: the sorted subkeys of
    one hash range next to their values. There are as many buckets as bring at most BUCKET entries to each on average,
    by the number of entries alone; only buckets that the batch touched are written, or all where their number changes.
    """

    BUCKET = 128

    def __init__(self, state):
        self.state = state

    def begin(self, fresh: bool) -> None:
        self.fresh, self.known, self.reset, self.entries, self.stored, self.touched = fresh, fresh, False, {}, set(), set()
        self.bits = 0

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        self._read()
        return (((k,), (v,)) for k, v in self.entries.items())

    def updateValue(self, key: tuple, value: tuple) -> None:
        self._read()
        self.entries[key[0]] = value[0]
        self.touched.add(key[0])

    def removeKey(self, key: tuple) -> None:
        self._read()
        self.entries.pop(key[0], None)
        self.touched.add(key[0])

    def clear(self) -> None:
        self.known, self.reset, self.entries, self.stored, self.touched = True, True, {}, set(), set()

    def commit(self) -> None:
        if self.reset and not self.fresh:
            self.state.clear()
        if not self.touched:
            return
        bits = self._bits(len(self.entries))
        whole = bits != self.bits or not self.stored
        buckets = {} if whole else {self._bucket(subkey, bits): [] for subkey in self.touched}
        for subkey in sorted(self.entries):
            at = self._bucket(subkey, bits)
            if whole:
                buckets.setdefault(at, []).append(subkey)
            elif at in buckets:
                buckets[at].append(subkey)
        for at, subkeys in buckets.items():
            if subkeys:
                self.state.updateValue((at,), (subkeys, [self.entries[k] for k in subkeys]))
        for at in self.stored if whole else self.stored & buckets.keys():
            if not buckets.get(at):
                self.state.removeKey((at,))

    def _bits(self, n: int) -> int:
        return (max(n - 1, 0) // self.BUCKET).bit_length()

    @staticmethod
    def _bucket(subkey: int, bits: int) -> int:
        return (subkey * 2654435761 & 0xFFFFFFFF) >> (32 - bits)

    def _read(self) -> None:
        if not self.known:
            self.known = True
            for (at,), (subkeys, values) in self.state.iterator():
                self.stored.add(at)
                self.entries.update(zip(subkeys, values))
            self.bits = self._bits(len(self.entries))


class _Processor(StatefulProcessor):
    """Applies operations in order; open() gives the kind's state."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "seq long")
        self.held = self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> _HeldValue | _HeldList | _HeldMap | _HeldPackedMap:
        raise NotImplementedError

    def apply(self, op: Row) -> None:
        raise NotImplementedError

    def report(self, key) -> Iterator[Row]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ops, seen = list(rows), self.seen.get()
        at = ops[0].__fields__.index("seq")
        last = -1 if seen is None else seen[0]
        self.held.begin(fresh=seen is None)
        for op in sorted(ops, key=itemgetter(at)):
            if op[at] > last:
                last = op[at]
                self.apply(op)
        reported = list(self.report(key[0]))
        self.held.commit()
        if seen != (last,):
            self.seen.update((last,))
        yield from reported

    def restore(self, item: Row) -> None:
        self.apply(item)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Restored items: applied as writes older than any other, so a first write numbered 0 counts."""
        self.held.begin(fresh=False)
        self.restore(initialState)
        self.held.commit()
        self.seen.update((-1,))

    def close(self) -> None:
        pass


class ValueProcessor(_Processor):
    OUTPUT = "key long, value double"

    def open(self, handle):
        self.value = _HeldValue(handle.getValueState("value", "value double", self.ttl_ms))
        return self.value

    def apply(self, op):
        if op["op"] == "DELETE" or op["value"] is None:
            self.value.clear()
        else:
            self.value.update((op["value"],))

    def report(self, key):
        yield Row(key=key, value=now[0] if (now := self.value.get()) else None)


class ReducingProcessor(ValueProcessor):
    """function(old, new) over put values; a delete clears."""

    def __init__(self, function, ttl_ms=None):
        super().__init__(ttl_ms)
        self.function = function

    def apply(self, op):
        if op["op"] == "DELETE":
            self.value.clear()
        elif op["value"] is not None:
            self.value.update((self.function(now[0], op["value"]) if (now := self.value.get()) else op["value"],))


class AggregatingProcessor(_Processor):
    """Any aggregate: create() gives an accumulator (a tuple of `schema`), add(acc, value) the next one, result(acc) a double.

    By default sum and count, with their ratio as the result.
    """

    OUTPUT = "key long, value double"

    def __init__(self, create=lambda: (0.0, 0), add=lambda acc, value: (acc[0] + value, acc[1] + 1), result=lambda acc: acc[0] / acc[1], schema="total double, n long", ttl_ms=None):
        super().__init__(ttl_ms)
        self.create, self.add, self.result, self.schema = create, add, result, schema

    def open(self, handle):
        self.acc = _HeldValue(handle.getValueState("acc", self.schema, self.ttl_ms))
        return self.acc

    def apply(self, op):
        if op["op"] == "DELETE":
            self.acc.clear()
        elif op["value"] is not None:
            self.acc.update(tuple(self.add(self.create() if (now := self.acc.get()) is None else now, op["value"])))

    def report(self, key):
        yield Row(key=key, value=None if (now := self.acc.get()) is None else self.result(now))


class ListProcessor(_Processor):
    """Restored from whole lists (key, elements)."""

    OUTPUT = "key long, elements array<double>"

    def restore(self, item):
        if item["elements"]:
            self.elements.put([(e,) for e in item["elements"]])

    def open(self, handle):
        self.elements = _HeldList(handle.getListState("elements", "value double", self.ttl_ms))
        return self.elements

    def apply(self, op):
        if op["op"] == "DELETE":
            self.elements.clear()
        elif op["value"] is None:
            return
        elif op["op"] == "PUT":
            self.elements.put([(op["value"],)])
        else:
            self.elements.appendValue((op["value"],))

    def report(self, key):
        yield Row(key=key, elements=[e[0] for e in self.elements.get()])


class MapProcessor(_Processor):
    """A DELETE without subkey clears the map. Entries that expire are stored one by one, as each has its own time; others in buckets."""

    OUTPUT = "key long, entries map<int,double>"

    def open(self, handle):
        if not self.ttl_ms:
            self.entries = _HeldPackedMap(handle.getMapState("entries", "bucket int", "subkeys array<int>, values array<double>"))
            return self.entries
        self.entries = _HeldMap(handle.getMapState("entries", "subkey int", "value double", self.ttl_ms))
        return self.entries

    def apply(self, op):
        if op["op"] == "DELETE":
            if op["subkey"] is None:
                self.entries.clear()
            else:
                self.entries.removeKey((op["subkey"],))
        elif op["subkey"] is not None and op["value"] is not None:
            self.entries.updateValue((op["subkey"],), (op["value"],))

    def report(self, key):
        yield Row(key=key, entries={k[0]: v[0] for k, v in self.entries.iterator()})


class TimerProcessor(StatefulProcessor):
    """Event-time timers: ADD registers, REMOVE deletes, and each fires once the watermark passes it."""

    OUTPUT = "key long, fired_ms long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        pending = set(self.handle.listTimers())
        for op in sorted(rows, key=lambda r: r["seq"]):
            at = op["ts_ms"]
            if op["op"] == "ADD" and at not in pending:
                self.handle.registerTimer(at)
                pending.add(at)
            elif op["op"] == "REMOVE" and at in pending:
                self.handle.deleteTimer(at)
                pending.discard(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield Row(key=key[0], fired_ms=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def run(ops: DataFrame, processor: StatefulProcessor, initial: DataFrame | None = None, time_mode: str = "none") -> DataFrame:
    """Live state of ops by key, batch or streaming. initial: items to start from, with the columns of ops."""
    prepare(ops.sparkSession)
    grouped = ops.groupBy("key")
    return grouped.transformWithState(
        statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode="Update" if time_mode == "none" else "Append", timeMode=time_mode,
        initialState=None if initial is None else initial.groupBy("key"),
    )


def progress(query) -> dict[str, int]:
    """Rows, updates, memory and late rows of a running query's state operators, summed."""
    last = query.lastProgress
    fields = {"numRowsTotal": "rows", "numRowsUpdated": "updated", "numRowsRemoved": "removed", "memoryUsedBytes": "memory_bytes", "numRowsDroppedByWatermark": "late"}
    return {name: sum(int(getattr(op, field) or 0) for op in (last.stateOperators if last else [])) for field, name in fields.items()}

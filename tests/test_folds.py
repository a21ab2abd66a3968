"""Folds, live state and a sequential model over random logs; null rules; the edge cases of each kind."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldstone.functions import expiry
from foldstone.operators import aggregates, lists, maps, snapshots, timers, values
from foldstone.plans.spec import IncompatibleState, StateSpec
from foldstone.sources import items, logs
from foldstone.streaming import live

OPS = "key long, ns string, subkey int, op string, value double, seq long, write_ms long"


def random_log(seed, n=600, kinds=("PUT", "APPEND", "DELETE"), weights=(0.4, 0.45, 0.15)):
    r = random.Random(seed)
    return [(r.randrange(30), f"n{r.randrange(4)}", r.randrange(12), r.choices(kinds, weights)[0], float(r.randrange(50)), i, i * 10) for i in range(1, n + 1)]


def replay_values(log):
    state = {}
    for key, _, _, op, value, *_ in log:
        if op == "DELETE":
            state.pop(key, None)
        else:
            state[key] = value
    return state


def replay_lists(log):
    state = {}
    for key, _, _, op, value, *_ in log:
        if op == "DELETE":
            state.pop(key, None)
        elif op == "PUT":
            state[key] = [value]
        else:
            state.setdefault(key, []).append(value)
    return state


def replay_maps(log):
    state = {}
    for key, _, sub, op, value, *_ in log:
        if op == "DELETE" and sub is None:
            state.pop(key, None)
        elif op == "DELETE":
            state.get(key, {}).pop(sub, None)
        else:
            state.setdefault(key, {})[sub] = value
    return {k: v for k, v in state.items() if v}


@pytest.mark.parametrize("seed", [1, 2])
def test_value_fold_and_live_match_the_model(spark, seed):
    log = random_log(seed, kinds=("PUT", "DELETE"), weights=(0.8, 0.2))
    ops = spark.createDataFrame(log, OPS)
    expected = replay_values(log)
    assert {r.key: r.value for r in values.value_state(ops).collect()} == expected
    assert {r.key: r.value for r in live.run(ops.select("key", "op", "value", "seq"), live.ValueProcessor()).collect() if r.value is not None} == expected


@pytest.mark.parametrize("seed", [3, 4])
def test_list_fold_and_live_match_the_model(spark, seed):
    log = random_log(seed)
    ops = spark.createDataFrame(log, OPS)
    expected = replay_lists(log)
    assert {r.key: r.elements for r in lists.list_state(lists.live_elements(ops)).collect()} == expected
    assert {r.key: r.elements for r in live.run(ops.select("key", "op", "value", "seq"), live.ListProcessor()).collect() if r.elements} == expected


@pytest.mark.parametrize("seed", [5, 6])
def test_map_fold_and_live_match_the_model(spark, seed):
    r = random.Random(seed)
    log = [(k, ns, None if op == "DELETE" and r.random() < 0.3 else sub, op, v, s, w) for k, ns, sub, op, v, s, w in random_log(seed, kinds=("PUT", "DELETE"), weights=(0.85, 0.15))]
    ops = spark.createDataFrame(log, OPS)
    expected = replay_maps(log)
    assert {r.key: r.entries for r in maps.whole_maps(maps.entries(ops)).collect()} == expected
    found = live.run(ops.select("key", "subkey", "op", "value", "seq"), live.MapProcessor())
    assert {r.key: r.entries for r in found.collect() if r.entries} == expected


def test_reduce_and_aggregate_live_match_folds(spark):
    log = random_log(7, kinds=("PUT",), weights=(1,))
    ops = spark.createDataFrame(log, OPS)
    folded = {r.key: r.value for r in aggregates.reduce_in_order(ops, lambda old, new: old * 0.5 + new).collect()}
    found = {r.key: r.value for r in live.run(ops.select("key", "op", "value", "seq"), live.ReducingProcessor(lambda old, new: old * 0.5 + new)).collect()}
    assert found == folded
    means = {r.key: r.value for r in live.run(ops.select("key", "op", "value", "seq"), live.AggregatingProcessor()).collect()}
    assert means == pytest.approx({r.key: r.m for r in ops.groupBy("key").agg(F.avg("value").alias("m")).collect()})


def elements(spark, log):
    ops = spark.createDataFrame([(1, "n", 0, op, float(v), i, i) for i, (op, v) in enumerate(log, 1)], OPS)
    found = lists.list_state(lists.live_elements(ops)).collect()
    return found[0].elements if found else None


@pytest.mark.parametrize(
    "log, expected",
    [
        ([("APPEND", 1), ("APPEND", 2)], [1, 2]),
        ([("PUT", 1), ("APPEND", 2), ("DELETE", 0), ("APPEND", 3)], [3]),
        ([("DELETE", 0)], None),
        ([("PUT", 1), ("APPEND", 2)], [1, 2]),
        ([("APPEND", 1), ("PUT", 2)], [2]),
        ([("PUT", 1), ("DELETE", 0)], None),
    ],
)
def test_merge_algebra(spark, log, expected):
    assert elements(spark, log) == expected


def test_a_sequence_number_seen_twice_counts_once(spark):
    ops = spark.createDataFrame([(1, "n", 0, "APPEND", 1.0, 1, 1)] * 2 + [(1, "n", 0, "APPEND", 1.0, 2, 2)], OPS)
    assert lists.list_state(lists.live_elements(ops)).first().elements == [1.0, 1.0]


def test_bulk_appends_keep_equal_elements(spark):
    batches = spark.createDataFrame([(1, [1.0, 1.0, 2.0], 1), (1, [1.0, None], 2), (1, [], 3), (1, [9.0, 1.0], 4)], "key long, elements array<double>, seq long")
    ops = logs.list_appends(batches)
    assert lists.list_state(lists.live_elements(ops)).first().elements == [1.0, 1.0, 2.0, 9.0, 1.0]
    assert lists.list_state(lists.live_elements(ops.union(ops))).first().elements == [1.0, 1.0, 2.0, 9.0, 1.0]


def test_restore_keeps_values_lists_and_timers_under_ttl(spark):
    log = [(k, f"n{k % 2}", None, "PUT", float(k), k, 10 * k) for k in range(1, 9)]
    ops = spark.createDataFrame(log, OPS)
    kept = values.value_state(ops)
    spec = StateSpec("v", "VALUE", T.LongType(), T.DoubleType())
    group = F.lit(0)
    back = values.value_state(snapshots.as_ops(snapshots.items(kept, spec, group), "double"))
    alive = lambda df: {r.key for r in df.where(~expiry.expired(F.col("write_ms"), 40, F.lit(90))).collect()}
    assert alive(back) == alive(kept) == {6, 7, 8}
    bulk = values.put_all(ops, spark.createDataFrame([(50, 5.0, 99)], "key long, value double, seq long"))
    assert 50 in alive(values.value_state(bulk))
    state = spark.createDataFrame([(1, "a", [1.0, 1.0, 2.0]), (1, "b", [3.0])], "key long, ns string, elements array<double>")
    rows = snapshots.items(state, StateSpec("l", "SUB_LIST", T.LongType(), T.DoubleType(), namespace=T.StringType()), group)
    again = lists.list_state(lists.live_elements(snapshots.as_list_ops(rows, "double"), "key", "ns"), "key", "ns")
    assert {(r.key, r.ns): r.elements for r in again.collect()} == {(1, "a"): [1.0, 1.0, 2.0], (1, "b"): [3.0]}
    due = spark.createDataFrame([(0, 5, 1), (0, 7, 2)], "kg int, ts_ms long, key long")
    found = timers.pending(snapshots.as_timer_ops(snapshots.items(due, StateSpec("t", "PQ", T.LongType(), T.LongType()), group)), group)
    assert {(r.ts_ms, r.key) for r in found.collect()} == {(5, 1), (7, 2)}


def test_restore_dispatch(spark):
    later = spark.createDataFrame([(1, "PUT", 2.0, 1, 5)], "key long, op string, value double, seq long, write_ms long")
    saved = snapshots.items(values.value_state(later.withColumn("key", F.lit(9).cast("long"))), StateSpec("v", "VALUE", T.LongType(), T.DoubleType()), F.lit(0))
    keys = lambda df: {r.key for r in values.value_state(df).collect()}
    assert keys(snapshots.restore_from(None, [], later)) == {1}
    assert keys(snapshots.restore_from("savepoint", [saved], later)) == {1, 9}
    assert keys(snapshots.restore_from("incremental", [later.withColumn("key", F.lit(7).cast("long"))], later)) == {1, 7}
    with pytest.raises(ValueError):
        snapshots.restore_from("native", [], later)


def test_operators_refuse_what_a_kind_refuses(spark):
    state = spark.createDataFrame([(1, "a", 1.0)], "key long, ns string, value double")
    plain = StateSpec("v", "VALUE", T.LongType(), T.DoubleType())
    of_lists = StateSpec("l", "SUB_LIST", T.LongType(), T.DoubleType(), namespace=T.StringType())
    for refused in (lambda: aggregates.merge_namespaces(state, F.lit("t"), {"value": F.sum("value")}, plain), lambda: values.remove_all(state, state, spec=of_lists), lambda: values.namespaces_as_map(state, of_lists)):
        with pytest.raises(NotImplementedError):
            refused()


def test_live_restore_and_ttl(spark):
    ops = spark.createDataFrame([(1, "APPEND", 9.0, 0), (2, "APPEND", 5.0, 0)], "key long, op string, value double, seq long")
    initial = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "key long, elements array<double>")
    assert {r.key: r.elements for r in live.run(ops, live.ListProcessor(), initial).collect()} == {1: [1.0, 2.0, 3.0, 9.0], 2: [5.0]}
    most = live.AggregatingProcessor(lambda: (0.0,), lambda acc, x: (max(acc[0], x),), lambda acc: acc[0], "most double")
    assert {r.key: r.value for r in live.run(ops, most).collect()} == {1: 9.0, 2: 5.0}


def test_timers_in_many_ranges(spark):
    r = random.Random(4)
    rows = [(0, r.randrange(10**10), k) for k in range(300)]
    found = timers.placed(spark.createDataFrame(rows, "kg int, ts_ms long, key long")).orderBy("place").collect()
    assert [(x.ts_ms, x.key) for x in found] == sorted((t, k) for _, t, k in rows) and [x.place for x in found] == list(range(1, 301))
    ops = [(k, r.randrange(1000), "ADD", k * 5000) for k in range(100)]
    head, expected = None, []
    for k, t, _, _ in ops:
        expected.append(head is None or (t, k) < head)
        head = min(head or (t, k), (t, k))
    out = timers.head_changes(spark.createDataFrame(ops, "key long, ts_ms long, op string, seq long"), F.lit(0)).orderBy("seq").collect()
    assert [x.head_changed for x in out] == expected
    added = timers.add_all(spark.createDataFrame([(1, 5, "ADD", 1)], "key long, ts_ms long, op string, seq long"), spark.createDataFrame([(2, 6)], "key long, ts_ms long"), 9)
    held = timers.pending(added, F.col("key"))
    asked = spark.createDataFrame([(1,), (2,), (3,)], "kg long")
    assert {x.kg: x.empty for x in timers.is_empty(asked, held).collect()} == {1: False, 2: False, 3: True}


def test_null_rules(spark):
    ops = spark.createDataFrame([(1, "n", 1, "PUT", 1.0, 1, 1), (1, "n", None, "PUT", 2.0, 2, 2), (1, "n", 1, "PUT", None, 3, 3), (None, "n", 1, "PUT", 1.0, 4, 4)], OPS)
    assert values.value_state(logs.null_rules(ops, "value")).count() == 0
    assert [(r.key, r.subkey, r.value) for r in maps.entries(logs.null_rules(ops, "map")).collect()] == [(1, 1, 1.0)]
    assert lists.list_state(lists.live_elements(logs.null_rules(ops.withColumn("op", F.lit("APPEND")), "list"))).first().elements == [1.0, 2.0]


@pytest.mark.parametrize("namespaced, expected", [(False, {1: [1.0], 2: [5.0], 4: [3.0, 4.0]}), (True, {2: [5.0], 4: [3.0, 4.0]})])
def test_whole_list_updates(spark, namespaced, expected):
    updates = spark.createDataFrame(
        [(1, [1.0], 1), (1, None, 2), (2, [5.0], 1), (2, [6.0, None], 2), (3, [1.0], 1), (3, [], 2), (4, [3.0, 4.0], 1)], "key long, elements array<double>, seq long"
    )
    ops = logs.list_updates(updates, namespaced)
    assert {r.key: r.elements for r in lists.list_state(lists.live_elements(ops), order=("seq", "pos")).collect()} == expected


def test_removing_elements(spark):
    row = spark.createDataFrame([(["a", "b", "a"],)], "elements array<string>").select(
        lists.remove_first(F.col("elements"), F.lit("a")).alias("one"), lists.remove_equal(F.col("elements"), F.array(F.lit("a"))).alias("all"),
        lists.remove_first(F.col("elements"), F.lit("z")).alias("none"), expiry.tail_from_first(F.col("elements"), lambda x: x == "b").alias("tail"),
    ).first()
    assert (row.one, row.all, row.none, row.tail) == (["b", "a"], ["b"], ["a", "b", "a"], ["b", "a"])


@pytest.mark.parametrize("write_ms, ttl, now, gone", [(90, 10, 100, True), (91, 10, 100, False), (0, 0, 100, False), (0, -1, 100, False), ((1 << 63) - 5, 10, 100, False)])
def test_expiry_boundary(spark, write_ms, ttl, now, gone):
    assert spark.range(1).select(expiry.expired(F.lit(write_ms).cast("long"), ttl, F.lit(now)).alias("x")).first().x is gone


def test_append_over_expired_elements_starts_anew(spark):
    ops = spark.createDataFrame([(1, "n", 0, "PUT", 1.0, 1, 0), (1, "n", 0, "APPEND", 2.0, 2, 100)], OPS)
    assert lists.list_state(lists.live_elements(ops, ttl_ms=50, now_ms=F.lit(120))).first().elements == [2.0]


def test_merging_namespaces(spark):
    state = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "t", 4.0), (2, "a", 8.0), (3, "x", 16.0)], "key long, ns string, value double")
    target = F.when(F.col("ns").isin("a", "b", "t"), "t").otherwise(F.col("ns"))
    merged = aggregates.merge_namespaces(state, target, {"value": F.sum("value")}).collect()
    assert {(r.key, r.ns): r.value for r in merged} == {(1, "t"): 7.0, (2, "t"): 8.0, (3, "x"): 16.0}
    as_lists = state.select("key", "ns", F.array("value").alias("elements"))
    assert {(r.key, r.ns): r.elements for r in aggregates.merge_lists(as_lists, target).collect()}[1, "t"] == [1.0, 2.0, 4.0]


def test_timer_set_semantics(spark):
    ops = spark.createDataFrame([(1, 5, "ADD", 1), (1, 5, "ADD", 2), (2, 5, "ADD", 3), (3, 1, "REMOVE", 4), (1, 9, "ADD", 5), (1, 9, "REMOVE", 6)], "key long, ts_ms long, op string, seq long")
    pending = timers.pending(ops, F.lit(0))
    assert [(r.ts_ms, r.key) for r in timers.ordered(pending).collect()] == [(5, 1), (5, 2)]
    heads, rest = timers.poll(pending)
    assert [(r.ts_ms, r.key) for r in heads.collect()] == [(5, 1)] and [(r.ts_ms, r.key) for r in rest.collect()] == [(5, 2)]
    assert [r.head_changed for r in timers.head_changes(ops, F.lit(0)).orderBy("seq").collect()] == [True, False, False, False]


def test_specs():
    spec = StateSpec("s", "VALUE", T.LongType(), T.IntegerType(), ttl_ms=5)
    assert spec.reregistered(replace(spec, ttl_ms=-1)).ttl_ms == 5
    assert spec.reregistered(replace(spec, ttl_ms=9, value=T.LongType())).ttl_ms == 9
    assert replace(spec, ttl_on=False).effective_ttl_ms == -1
    for bad in (replace(spec, key=T.StringType()), replace(spec, name="t"), replace(spec, value=T.ByteType())):
        with pytest.raises(IncompatibleState):
            spec.check(bad)
    with pytest.raises(IncompatibleState):
        StateSpec("m", "MAP", T.LongType(), T.LongType(), subkey=T.LongType()).check(StateSpec("m", "MAP", T.LongType(), T.LongType(), subkey=T.StringType()))
    for kind, extra, refused in (("LIST", {}, "merge_namespaces"), ("SUB_LIST", {"namespace": T.StringType()}, "remove_key"), ("MAP", {"subkey": T.LongType()}, "put_whole_map")):
        with pytest.raises(NotImplementedError):
            StateSpec("x", kind, T.LongType(), T.LongType(), **extra).require(refused)
    with pytest.raises(ValueError):
        StateSpec("x", "SUB_MAP", T.LongType(), T.LongType())


def test_savepoint_files_prune_by_key_group(spark, tmp_path):
    log = random_log(8, kinds=("PUT",), weights=(1,))
    state = values.value_state(spark.createDataFrame(log, OPS))
    spec = StateSpec("latest", "VALUE", T.LongType(), T.DoubleType())
    rows = snapshots.items(snapshots.groups_of(state, 1024), spec, F.col("key_group"))
    items.write_items(rows, str(tmp_path / "savepoint"))
    back = items.read_items(spark, str(tmp_path / "savepoint"))
    assert sorted(map(tuple, back.select(*items.ITEM).collect())) == sorted(map(tuple, rows.collect()))
    half = items.read_items(spark, str(tmp_path / "savepoint"), 512, 1023)
    assert {r.key for r in half.collect()} == {r.key for r in rows.where("key_group >= 512").collect()}
    restored = snapshots.restore([snapshots.as_ops(back, "double")], spark.createDataFrame([(log[0][0], "n", 0, "PUT", -1.0, 0, 0)], OPS).select("key", "ns", F.lit(None).cast("string").alias("subkey"), "op", "value", "seq", "write_ms"))
    expected = replay_values(log) | {log[0][0]: -1.0}
    assert {r.key: r.value for r in values.value_state(restored).collect()} == expected


def test_savepoint_is_ordered_by_key_group(spark, sf_dir):
    from foldstone.plans.queries import savepoint_items

    groups = [r.key_group for r in savepoint_items(spark, sf_dir).collect()]
    assert groups == sorted(groups)


def test_compaction_keeps_answers(spark):
    log = random_log(9)
    ops = spark.createDataFrame(log, OPS)
    old, new = ops.where("seq <= 300"), ops.where("seq > 300")
    kept = snapshots.compact_lists(old, True).unionByName(snapshots.compact_lists(new, False))
    assert {r.key: r.elements for r in lists.list_state(lists.live_elements(kept)).collect()} == replay_lists(log)
    kept = snapshots.compact(old, True).unionByName(snapshots.compact(new, False))
    assert {r.key: r.value for r in values.last_writes(kept).where("op <> 'DELETE'").collect()} == replay_values(log)


def test_equal_turns_are_added_each(spark, tmp_path):
    from foldstone.plans import queries

    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "yes")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.list_add_all(spark, str(tmp_path)).first()
    assert (found.n, found.chars, found.first, found.last) == (2 + 1, 7, "hi", "yes")

"""The registered queries over folded state, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldstone.functions import expiry, keygroups
from foldstone.operators import aggregates, lists, maintenance, maps, scans, snapshots, timers, values
from foldstone.plans.spec import StateSpec
from foldstone.sources import logs
from foldstone.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Parameters of the queries.
M, P, BUCKETS = 128, 5, 1024
DAY_MS = 86_400_000
TTL_MS, LONGER_MS = 7 * DAY_MS, 14 * DAY_MS
CUT, PREVIOUS_CUT = 0.6, 0.4
BLOB_BYTES = 2000

RAW = "(((user_id % 2147483648) * 2654435761) % 2147483648)"
VALUE_OPS = "v AS (SELECT user_id AS key, CAST(ts AS DATE) AS ns, event_type AS subkey, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, value, event_id AS seq, epoch_ms(ts) AS write_ms FROM events)"
LIST_OPS = "l AS (SELECT user_id AS key, CAST(ts AS DATE) AS ns, CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'PUT' ELSE 'APPEND' END AS op, value, event_id AS seq, epoch_ms(ts) AS write_ms FROM events)"
VALUE_STATE = f"{VALUE_OPS}, s AS (SELECT key, arg_max(value, seq) AS value, max(seq) AS seq, arg_max(write_ms, seq) AS write_ms FROM v GROUP BY key HAVING arg_max(op, seq) = 'PUT')"
NS_STATE = f"{VALUE_OPS}, s AS (SELECT key, ns, arg_max(value, seq) AS value, max(seq) AS seq FROM v GROUP BY key, ns HAVING arg_max(op, seq) = 'PUT')"
LIST_STATE = f"{LIST_OPS}, r AS (SELECT *, max(CASE WHEN op IN ('PUT', 'DELETE') THEN seq END) OVER (PARTITION BY key) AS reset_seq FROM l), e AS (SELECT * FROM r WHERE op <> 'DELETE' AND (reset_seq IS NULL OR seq >= reset_seq)), s AS (SELECT key, list(value ORDER BY seq) AS elements FROM e GROUP BY key)"
NS_LIST_STATE = LIST_STATE.replace("PARTITION BY key", "PARTITION BY key, ns").replace("SELECT key, list(", "SELECT key, ns, list(").replace("FROM e GROUP BY key", "FROM e GROUP BY key, ns")
MAP_STATE = f"{VALUE_OPS}, s AS (SELECT key, k AS subkey, arg_max(value, seq) AS value, max(seq) AS seq FROM v GROUP BY key, k HAVING arg_max(op, seq) = 'PUT')"
CENTS = "CAST(round({} * 100) AS BIGINT)"
TIMERS = f"t AS (SELECT o_custkey AS key, epoch_ms(o_orderdate) AS ts_ms FROM orders GROUP BY 1, 2 HAVING arg_max(o_orderstatus, o_orderkey) <> 'F'), p AS (SELECT CAST((((key % 2147483648) * 2654435761) % 2147483648) % {M} AS BIGINT) AS kg, ts_ms, key FROM t)"


def query(name: str, sql: str | None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def _events(spark: SparkSession, d: str) -> DataFrame:
    return logs.table(spark, d, "events")


def _value_ops(spark: SparkSession, d: str) -> DataFrame:
    return logs.null_rules(logs.event_ops(_events(spark, d)), "value")


def _map_ops(spark: SparkSession, d: str) -> DataFrame:
    return logs.null_rules(logs.event_ops(_events(spark, d), subkey="props"), "map")


def _list_ops(spark: SparkSession, d: str) -> DataFrame:
    return logs.null_rules(logs.event_ops(_events(spark, d), "list"), "list")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return logs.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey")


def _raw(column: str = "key"):
    return keygroups.raw_hash(F.col(column))


def _group(column: str = "key"):
    return keygroups.key_group(_raw(column), M)


def _cents(column):
    return F.round(column * 100).cast("long")


def _described(state: DataFrame, *by: str) -> DataFrame:
    """Lists as scalars: number, first, last, and all elements in cents."""
    e = F.col("elements")
    return state.select(*by or ("key",), F.size(e).cast("long").alias("n"), F.element_at(e, 1).alias("first"), F.element_at(e, -1).alias("last"), F.array_join(F.transform(e, _cents), ",").alias("cents"))


def _described_sql(by: str = "key") -> str:
    return f"SELECT {by}, len(elements) AS n, elements[1] AS first, elements[len(elements)] AS last, array_to_string(list_transform(elements, lambda x: CAST(round(x * 100) AS BIGINT)), ',') AS cents FROM s"


# value state


@query("value_latest", f"WITH {VALUE_STATE} SELECT key, value, seq FROM s")
def value_latest(spark, d):
    return values.value_state(_value_ops(spark, d)).select("key", "value", "seq")


@query("value_contains", f"WITH {VALUE_STATE} SELECT c_custkey AS key, s.key IS NOT NULL AS present FROM customer LEFT JOIN s ON c_custkey = s.key")
def value_contains(spark, d):
    return values.contains(_customers(spark, d).select("key"), values.value_state(_value_ops(spark, d)))


@query("value_default", f"WITH {VALUE_STATE} SELECT c_custkey AS key, coalesce(value, -1.0::DOUBLE) AS value FROM customer LEFT JOIN s ON c_custkey = s.key")
def value_default(spark, d):
    return values.get_or_default(_customers(spark, d).select("key"), values.value_state(_value_ops(spark, d)), -1.0)


@query("value_update_null", "SELECT user_id AS key, arg_max(CASE WHEN value < 5 THEN NULL ELSE [value] END, event_id)[1] AS value, max(event_id) AS seq FROM events GROUP BY user_id HAVING arg_max(CASE WHEN value < 5 THEN 0 ELSE 1 END, event_id) = 1")
def value_update_null(spark, d):
    """Updates below 5 write null, which clears."""
    ops = logs.event_ops(_events(spark, d)).withColumn("op", F.lit("PUT")).withColumn("value", F.when(F.col("value") >= 5, F.col("value")))
    return values.value_state(logs.null_rules(ops, "value")).select("key", "value", "seq")


@query("value_put_all", f"WITH {VALUE_STATE} SELECT coalesce(c_custkey, key) AS key, coalesce(c_acctbal, value) AS value FROM s FULL JOIN (SELECT * FROM customer WHERE c_nationkey < 10) c ON c_custkey = key")
def value_put_all(spark, d):
    """A bulk put of account balances on top of the log."""
    balances = logs.table(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), F.lit(1 << 60).alias("seq"))
    return values.value_state(values.put_all(_value_ops(spark, d), balances)).select("key", "value")


@query("value_multiget", f"WITH {VALUE_STATE} SELECT key, value FROM s WHERE key IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3))")
def value_multiget(spark, d):
    wanted = _customers(spark, d).where(F.col("c_nationkey").isin(1, 2, 3))
    return values.multi_get(wanted, values.value_state(_value_ops(spark, d))).select("key", "value")


@query("value_remove_all", f"WITH {VALUE_STATE} SELECT key, value FROM s WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3))")
def value_remove_all(spark, d):
    return values.remove_all(values.value_state(_value_ops(spark, d)), _customers(spark, d).where(F.col("c_nationkey").isin(1, 2, 3))).select("key", "value")


@query("value_get_and_remove", f"WITH {VALUE_STATE} SELECT key, value, key IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) AS removed FROM s")
def value_get_and_remove(spark, d):
    """What was read, and what the log still holds after the removal."""
    held, later = values.get_and_remove(_value_ops(spark, d), _customers(spark, d).where("c_nationkey < 5"), 1 << 60)
    return held.select("key", "value", F.lit(True).alias("removed")).unionByName(values.value_state(later).select("key", "value", F.lit(False).alias("removed")))


@query("value_serialized", f"WITH {VALUE_STATE} SELECT key, CAST({CENTS.format('value')} AS VARCHAR) AS text FROM s")
def value_serialized(spark, d):
    """Queryable form of each value."""
    return values.value_state(_value_ops(spark, d)).select("key", _cents(F.col("value")).cast("string").alias("text"))


@query("ns_value_latest", f"WITH {NS_STATE} SELECT key, ns, value, seq FROM s")
def ns_value_latest(spark, d):
    return values.value_state(_value_ops(spark, d), "key", "ns").select("key", "ns", "value", "seq")


@query("ns_value_all", f"WITH {NS_STATE} SELECT key, count(*) AS n, string_agg(CAST(ns AS VARCHAR) || '=' || CAST({CENTS.format('value')} AS VARCHAR), ',' ORDER BY ns) AS entries FROM s GROUP BY key")
def ns_value_all(spark, d):
    """All namespaces of a key as a map."""
    whole = values.namespaces_as_map(values.value_state(_value_ops(spark, d), "key", "ns"))
    pairs = F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), _cents(e["value"]).cast("string")))
    return whole.select("key", F.size("entries").cast("long").alias("n"), F.array_join(pairs, ",").alias("entries"))


@query("ns_value_remove_key", f"WITH {NS_STATE} SELECT key, ns, value FROM s WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def ns_value_remove_key(spark, d):
    """Removing a key drops all its namespaces."""
    return values.remove_all(values.value_state(_value_ops(spark, d), "key", "ns"), _customers(spark, d).where("c_nationkey = 7")).select("key", "ns", "value")


# list state


def _lists(spark, d, *by: str) -> DataFrame:
    return lists.list_state(lists.live_elements(_list_ops(spark, d), *by), *by)


@query("list_current", f"WITH {LIST_STATE} {_described_sql()}")
def list_current(spark, d):
    return _described(_lists(spark, d))


@query("list_add_all", "SELECT conv_id AS key, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, arg_min(text, turn) AS first, arg_max(text, turn) AS last FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def list_add_all(spark, d):
    """Turns appended to their conversation, read back as one list."""
    turns = lists.live_elements(logs.null_rules(logs.conversation_ops(logs.table(spark, d, "conversations")), "list"))
    # equal turns are elements each
    state = lists.list_state(turns.withColumn("said", F.col("value")).withColumn("row", F.monotonically_increasing_id()), order=("seq", "said", "row"))
    total = F.aggregate("elements", F.lit(0).cast("long"), lambda s, t: s + F.char_length(t))
    return state.select("key", F.size("elements").cast("long").alias("n"), total.alias("chars"), F.element_at("elements", 1).alias("first"), F.element_at("elements", -1).alias("last"))


@query("list_contains", f"WITH {LIST_STATE} SELECT c_custkey AS key, s.key IS NOT NULL AS present FROM customer LEFT JOIN s ON c_custkey = s.key")
def list_contains(spark, d):
    return values.contains(_customers(spark, d).select("key"), lists.live_elements(_list_ops(spark, d)))


@query("list_remove_first", f"WITH {LIST_STATE.replace(', s AS (SELECT key, list(value', ', s0 AS (SELECT key, list(value')}, s AS (SELECT key, elements[:list_position(elements, m) - 1] || elements[list_position(elements, m) + 1:] AS elements FROM (SELECT *, list_min(elements) AS m FROM s0) WHERE len(elements) > 1) {_described_sql()}")
def list_remove_first(spark, d):
    """Without the first of the smallest elements; a list that gets empty is gone."""
    state = _lists(spark, d).withColumn("elements", lists.remove_first(F.col("elements"), F.array_min("elements")))
    return _described(lists.non_empty(state))


@query("list_remove_all", f"WITH {LIST_STATE.replace(', s AS (SELECT key, list(value', ', s0 AS (SELECT key, list(value')}, s AS (SELECT key, list_filter(elements, lambda x: x <> elements[1] AND x <> elements[len(elements)]) AS elements FROM s0 WHERE len(list_filter(elements, lambda x: x <> elements[1] AND x <> elements[len(elements)])) > 0) {_described_sql()}")
def list_remove_all(spark, d):
    """Without all elements equal to the first or the last one."""
    state = _lists(spark, d).withColumn("elements", lists.remove_equal(F.col("elements"), F.array(F.element_at("elements", 1), F.element_at("elements", -1))))
    return _described(lists.non_empty(state))


@query("list_multiget", f"WITH {LIST_STATE.replace(', s AS (SELECT key, list(value', ', s0 AS (SELECT key, list(value')}, s AS (SELECT * FROM s0 WHERE key IN (SELECT c_custkey FROM customer WHERE c_nationkey < 8)) {_described_sql()}")
def list_multiget(spark, d):
    return _described(lists.multi_get(_customers(spark, d).where("c_nationkey < 8"), _lists(spark, d)))


def _day_lists(spark, d) -> DataFrame:
    """Whole-list updates: per user and day the day's values, null where an error happened, empty for signups only."""
    per = _events(spark, d).groupBy(F.col("user_id").alias("key"), F.to_date("ts").alias("ns"))
    kept = F.array_sort(F.collect_list(F.when(F.col("event_type") != "signup", F.struct("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v")))))
    return per.agg(F.transform(kept, lambda e: e["v"]).alias("elements"), F.max("event_id").alias("seq"))


DAY_LISTS = """u AS (SELECT user_id AS key, CAST(ts AS DATE) AS ns, coalesce(list(CASE WHEN event_type <> 'error' THEN value END ORDER BY event_id) FILTER (WHERE event_type <> 'signup'), []) AS elements,
  count(*) FILTER (WHERE event_type = 'error') AS bad, max(event_id) AS seq FROM events GROUP BY ALL)"""


@query("list_put_all", f"WITH {DAY_LISTS}, s AS (SELECT key, arg_max(elements, seq) AS elements FROM u WHERE bad = 0 GROUP BY key HAVING len(arg_max(elements, seq)) > 0) {_described_sql()}")
def list_put_all(spark, d):
    """Whole-list puts: one with a null element is refused, an empty one clears."""
    ops = logs.list_updates(_day_lists(spark, d).drop("ns"), namespaced=False)
    return _described(lists.list_state(lists.live_elements(ops), order=("seq", "pos")))


@query("ns_list_update_null", f"WITH {DAY_LISTS}, s AS (SELECT key, ns, elements FROM u WHERE bad = 0 AND len(elements) > 0) {_described_sql('key, ns')}")
def ns_list_update_null(spark, d):
    """The same per namespace, where a null list clears."""
    updates = _day_lists(spark, d)
    nulls = updates.where(F.exists("elements", lambda x: x.isNull())).withColumn("elements", F.lit(None).cast("array<double>")).withColumn("seq", F.col("seq") - 1)
    ops = logs.list_updates(updates.unionByName(nulls), namespaced=True)
    return _described(lists.list_state(lists.live_elements(ops, "key", "ns"), "key", "ns", order=("seq", "pos")), "key", "ns")


@query("ns_list_current", f"WITH {NS_LIST_STATE} {_described_sql('key, ns')}")
def ns_list_current(spark, d):
    return _described(_lists(spark, d, "key", "ns"), "key", "ns")


# map state


@query("map_entries", f"WITH {MAP_STATE} SELECT key, subkey, value, seq FROM s")
def map_entries(spark, d):
    return maps.entries(_map_ops(spark, d)).select("key", "subkey", "value", "seq")


@query("map_get", f"WITH {MAP_STATE} SELECT key, max(CASE WHEN subkey = 42 THEN value END) AS value FROM s GROUP BY key")
def map_get(spark, d):
    return maps.lookup(maps.entries(_map_ops(spark, d)), 42).select("key", "value")


@query("map_contains", f"WITH {MAP_STATE} SELECT key, bool_or(subkey = 42) AS present FROM s GROUP BY key")
def map_contains(spark, d):
    return maps.lookup(maps.entries(_map_ops(spark, d)), 42).select("key", "present")


@query("map_keys_values", f"WITH {MAP_STATE} SELECT key, string_agg(CAST(subkey AS VARCHAR), ',' ORDER BY subkey) AS subkeys, string_agg(CAST({CENTS.format('value')} AS VARCHAR), ',' ORDER BY subkey) AS cents FROM s GROUP BY key")
def map_keys_values(spark, d):
    whole = maps.whole_maps(maps.entries(_map_ops(spark, d)))
    return whole.select("key", F.array_join(F.map_keys("entries"), ",").alias("subkeys"), F.array_join(F.transform(F.map_values("entries"), _cents), ",").alias("cents"))


@query("map_multiget", f"WITH {MAP_STATE} SELECT key, subkey, value FROM s WHERE (key, subkey) IN (SELECT c_custkey, c_nationkey FROM customer)")
def map_multiget(spark, d):
    wanted = _customers(spark, d).withColumnRenamed("c_nationkey", "subkey")
    return maps.multi_get(maps.entries(_map_ops(spark, d)), wanted).select("key", "subkey", "value")


CLEARING = f"{VALUE_OPS}, c AS (SELECT key, max(seq) AS cleared FROM v WHERE subkey = 'error' GROUP BY key), s AS (SELECT v.key, k AS subkey, arg_max(value, seq) AS value FROM v LEFT JOIN c ON v.key = c.key WHERE subkey <> 'error' GROUP BY v.key, k HAVING max(seq) > coalesce(max(cleared), -1))"


@query("map_clear_key", f"WITH {CLEARING} SELECT * FROM s")
def map_clear_key(spark, d):
    """An error clears its key's whole map."""
    ops = logs.event_ops(_events(spark, d), subkey="props").withColumn("subkey", F.when(F.col("op") == "PUT", F.col("subkey")))
    return maps.entries(logs.null_rules(ops, "map")).select("key", "subkey", "value")


@query("map_remove_bulk", f"WITH {MAP_STATE} SELECT key, subkey, value FROM s WHERE (key, subkey) NOT IN (SELECT c_custkey, c_nationkey FROM customer)")
def map_remove_bulk(spark, d):
    """Bulk removal of entries as DELETE operations."""
    gone = _customers(spark, d).select("key", F.col("c_nationkey").alias("subkey"), F.lit("DELETE").alias("op"), F.lit(1 << 60).alias("seq"))
    return maps.entries(_map_ops(spark, d).unionByName(gone, allowMissingColumns=True)).select("key", "subkey", "value")


@query("map_set_value", f"WITH {MAP_STATE} SELECT key, subkey, value * 2 AS value FROM s WHERE value >= 10")
def map_set_value(spark, d):
    """An iterator's setValue and remove, written through as operations."""
    ops = _map_ops(spark, d)
    doubled = maps.rewrite(maps.entries(ops), F.when(F.col("value") >= 10, F.col("value") * 2), 1 << 60)
    return maps.entries(ops.unionByName(doubled, allowMissingColumns=True)).select("key", "subkey", "value")


@query("ns_map_entries", f"WITH {VALUE_OPS} SELECT key, ns, subkey, arg_max(value, seq) AS value FROM (SELECT key, ns, k AS subkey, value, seq, op FROM v) GROUP BY key, ns, subkey HAVING arg_max(op, seq) = 'PUT'")
def ns_map_entries(spark, d):
    return maps.entries(_map_ops(spark, d), "key", "ns").select("key", "ns", "subkey", "value")


# scans


@query("keys_of_state", f"WITH {VALUE_STATE} SELECT DISTINCT key FROM s")
def keys_of_state(spark, d):
    return scans.keys(values.value_state(_value_ops(spark, d)))


@query("keys_in_namespace", f"WITH {VALUE_OPS} SELECT DISTINCT key FROM (SELECT key, k FROM v WHERE ns = DATE '2024-01-05' GROUP BY key, ns, k HAVING arg_max(op, seq) = 'PUT')")
def keys_in_namespace(spark, d):
    """Of a map state: one row per key, not per entry. The namespace reaches the scan."""
    return scans.keys_in_namespace(maps.entries(_map_ops(spark, d), "key", "ns"), F.to_date(F.lit("2024-01-05")))


@query("keys_in_namespace_list", f"WITH {NS_LIST_STATE} SELECT DISTINCT key FROM s WHERE ns = DATE '2024-01-05'")
def keys_in_namespace_list(spark, d):
    return scans.keys_in_namespace(lists.live_elements(_list_ops(spark, d), "key", "ns"), F.to_date(F.lit("2024-01-05")))


@query("prefix_scan", f"WITH {MAP_STATE} SELECT key, subkey, value FROM s WHERE key = 7")
def prefix_scan(spark, d):
    return scans.prefix(maps.entries(_map_ops(spark, d)), 7).select("key", "subkey", "value")


@query("key_range_scan", f"WITH {VALUE_STATE} SELECT key, value FROM s WHERE key BETWEEN 5 AND 90")
def key_range_scan(spark, d):
    return scans.key_range(values.value_state(_value_ops(spark, d)), 5, 90).select("key", "value")


@query("keys_and_namespaces", f"WITH {NS_STATE} SELECT DISTINCT key, ns FROM s")
def keys_and_namespaces(spark, d):
    return scans.keys_and_namespaces(values.value_state(_value_ops(spark, d), "key", "ns"))


@query("entry_count", f"WITH {MAP_STATE} SELECT count(*) AS n FROM s")
def entry_count(spark, d):
    return scans.entry_count(maps.entries(_map_ops(spark, d)))


# reducing and aggregating state

LIVE = f"{VALUE_OPS}, a AS (SELECT * FROM v WHERE op = 'PUT')"
MONEY = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"


def _money(column="value"):
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def _puts(spark, d) -> DataFrame:
    return _value_ops(spark, d).where("op = 'PUT'")


@query("reduce_sum", f"WITH {LIVE} SELECT key, {MONEY} AS value FROM a GROUP BY key")
def reduce_sum(spark, d):
    return aggregates.reduce(_puts(spark, d), _money())


@query("reduce_max", f"WITH {LIVE} SELECT key, max(value) AS value FROM a GROUP BY key")
def reduce_max(spark, d):
    return aggregates.reduce(_puts(spark, d), F.max("value"))


@query("reduce_in_order", f"WITH {LIVE} SELECT key, list_reduce(list({CENTS.format('value')} ORDER BY seq), lambda x, y: (x * 31 + y) % 1000003) AS value FROM a GROUP BY key")
def reduce_in_order(spark, d):
    """A reduce whose order matters."""
    cents = _puts(spark, d).withColumn("value", _cents(F.col("value")))
    return aggregates.reduce_in_order(cents, lambda old, new: F.pmod(old * 31 + new, F.lit(1000003)))


@query("aggregate_avg", f"WITH {LIVE} SELECT key, round({MONEY} / count(*), 6) AS value FROM a GROUP BY key")
def aggregate_avg(spark, d):
    state = aggregates.accumulate(_puts(spark, d), {"total": _money(), "n": F.count(F.lit(1))})
    return state.select("key", F.round(F.col("total") / F.col("n"), 6).alias("value"))


@query("ns_reduce", f"WITH {LIVE} SELECT key, ns, {MONEY} AS value FROM a GROUP BY key, ns")
def ns_reduce(spark, d):
    return aggregates.reduce(_puts(spark, d), _money(), "key", "ns")


@query("ns_aggregate", f"WITH {LIVE} SELECT key, ns, round({MONEY} / count(*), 6) AS value, max(value) AS most FROM a GROUP BY key, ns")
def ns_aggregate(spark, d):
    state = aggregates.accumulate(_puts(spark, d), {"total": _money(), "n": F.count(F.lit(1)), "most": F.max("value")}, "key", "ns")
    return state.select("key", "ns", F.round(F.col("total") / F.col("n"), 6).alias("value"), "most")


def _week():
    """The merge target of a day: the Monday of its week."""
    return F.to_date(F.date_trunc("week", "ns"))


WEEK = "CAST(date_trunc('week', ns) AS DATE)"


@query("merge_ns_reduce", f"WITH {LIVE} SELECT key, {WEEK} AS ns, {MONEY} AS value FROM a GROUP BY ALL")
def merge_ns_reduce(spark, d):
    """Day windows merged into weeks."""
    days = aggregates.reduce(_puts(spark, d), _money(), "key", "ns")
    return aggregates.merge_namespaces(days, _week(), {"value": _money()})


@query("merge_ns_aggregate", f"WITH {LIVE} SELECT key, {WEEK} AS ns, round({MONEY} / count(*), 6) AS value FROM a GROUP BY ALL")
def merge_ns_aggregate(spark, d):
    days = aggregates.accumulate(_puts(spark, d), {"total": _money(), "n": F.count(F.lit(1))}, "key", "ns")
    weeks = aggregates.merge_namespaces(days, _week(), {"total": _money("total"), "n": F.sum("n")})
    return weeks.select("key", "ns", F.round(F.col("total") / F.col("n"), 6).alias("value"))


@query("merge_ns_list", f"WITH {NS_LIST_STATE.replace(', s AS (', ', s0 AS (')}, s AS (SELECT key, {WEEK} AS ns, flatten(list(elements ORDER BY ns)) AS elements FROM s0 GROUP BY ALL) {_described_sql('key, ns')}")
def merge_ns_list(spark, d):
    return _described(aggregates.merge_lists(_lists(spark, d, "key", "ns"), _week()), "key", "ns")


GAP = "30 minutes"


@query("merge_ns_session", "WITH o AS (SELECT user_id AS key, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts) AS session FROM o) SELECT key, min(ts) AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM n GROUP BY key, session")
def merge_ns_session(spark, d):
    """Session windows: namespaces that merge as events arrive."""
    rows = _events(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.col("user_id").alias("key"), F.session_window("at", GAP).alias("w")).agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"), _money().alias("value")).drop("w")


# timers


def _timers(spark, d) -> DataFrame:
    return timers.pending(logs.order_timers(logs.table(spark, d, "orders")), _group())


@query("timer_order", f"WITH {TIMERS} SELECT kg, ts_ms, key, row_number() OVER (PARTITION BY kg ORDER BY ts_ms, key) AS place FROM p")
def timer_order(spark, d):
    return timers.placed(_timers(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("timer_peek", f"WITH {TIMERS} SELECT kg, min(ts_ms) AS ts_ms, arg_min(key, (ts_ms, key)) AS key FROM p GROUP BY kg")
def timer_peek(spark, d):
    return timers.peek(_timers(spark, d))


@query("timer_poll", f"WITH {TIMERS} SELECT kg, ts_ms, key FROM (SELECT *, row_number() OVER (PARTITION BY kg ORDER BY ts_ms, key) AS n FROM p) WHERE n = 2")
def timer_poll(spark, d):
    """The head after one poll of every group."""
    return timers.peek(timers.poll(_timers(spark, d))[1])


@query("timer_poll_until", f"WITH {TIMERS}, w AS (SELECT (epoch_ms(min(o_orderdate)) + epoch_ms(max(o_orderdate))) // 2 AS m FROM orders) SELECT kg, ts_ms, key, row_number() OVER (PARTITION BY kg ORDER BY ts_ms, key) AS place FROM p, w WHERE ts_ms <= m")
def timer_poll_until(spark, d):
    """All timers that a watermark in the middle of the orders fires."""
    span = logs.order_timers(logs.table(spark, d, "orders")).agg(F.floor((F.min("ts_ms") + F.max("ts_ms")) / 2).alias("m"))
    return timers.due(_timers(spark, d).crossJoin(F.broadcast(span)), F.col("m")).drop("m").withColumn("place", F.col("place").cast("long"))


@query("timer_size", f"WITH {TIMERS} SELECT kg, count(*) AS n FROM p GROUP BY kg")
def timer_size(spark, d):
    return timers.sizes(_timers(spark, d))


@query("timer_head_changes", f"WITH a AS (SELECT CAST((((o_custkey % 2147483648) * 2654435761) % 2147483648) % {M} AS BIGINT) AS kg, o_orderkey AS seq, (epoch_ms(o_orderdate), o_custkey) AS t FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT *, min(t) OVER (PARTITION BY kg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head FROM a) SELECT kg, seq, head IS NULL OR t < head AS head_changed FROM b")
def timer_head_changes(spark, d):
    return timers.head_changes(logs.order_timers(logs.table(spark, d, "orders")), _group()).select("kg", "seq", "head_changed")


# expiry


def _now(spark, d) -> DataFrame:
    return _events(spark, d).agg(F.max(logs.epoch_ms(F.col("ts"))).alias("now_ms"))


def _unexpired(state: DataFrame, now: DataFrame, ttl: int) -> DataFrame:
    return state.crossJoin(F.broadcast(now)).where(~expiry.expired(F.col("write_ms"), ttl, F.col("now_ms"))).drop("now_ms")  # one row


@query("ttl_live", f"WITH {VALUE_STATE} SELECT key, value FROM s WHERE write_ms + {TTL_MS} > (SELECT max(write_ms) FROM v)")
def ttl_live(spark, d):
    return _unexpired(values.value_state(_value_ops(spark, d)), _now(spark, d), TTL_MS).select("key", "value")


@query("ttl_map_entries", f"WITH {VALUE_OPS} SELECT key, k AS subkey, arg_max(value, seq) AS value FROM v GROUP BY key, k HAVING arg_max(op, seq) = 'PUT' AND arg_max(write_ms, seq) + {TTL_MS} > (SELECT max(write_ms) FROM v)")
def ttl_map_entries(spark, d):
    return _unexpired(maps.entries(_map_ops(spark, d)), _now(spark, d), TTL_MS).select("key", "subkey", "value")


@query("ttl_updated", f"WITH {VALUE_STATE} SELECT key, value, write_ms + {TTL_MS} > (SELECT max(write_ms) FROM v) AS alive_before FROM s WHERE write_ms + {LONGER_MS} > (SELECT max(write_ms) FROM v)")
def ttl_updated(spark, d):
    """After re-registration with a longer TTL, and again with one that does not count."""
    spec = StateSpec("latest", "VALUE", T.LongType(), T.DoubleType(), ttl_ms=TTL_MS)
    spec = spec.reregistered(replace(spec, ttl_ms=LONGER_MS)).reregistered(replace(spec, ttl_ms=-1))
    state = values.value_state(_value_ops(spark, d)).crossJoin(F.broadcast(_now(spark, d)))
    return state.where(~expiry.expired(F.col("write_ms"), spec.effective_ttl_ms, F.col("now_ms"))).select("key", "value", (~expiry.expired(F.col("write_ms"), TTL_MS, F.col("now_ms"))).alias("alive_before"))


@query("ttl_list_elements", f"WITH {LIST_STATE.replace(', s AS (SELECT key, list(value ORDER BY seq) AS elements FROM e GROUP BY key)', '')}, s AS (SELECT key, list(value ORDER BY seq) AS elements FROM e WHERE write_ms + {3 * TTL_MS // 7} > (SELECT max(write_ms) FROM l) GROUP BY key) {_described_sql()}")
def ttl_list_elements(spark, d):
    """List elements expire one by one."""
    ops = _list_ops(spark, d).crossJoin(F.broadcast(_now(spark, d)))
    return _described(lists.list_state(lists.live_elements(ops, ttl_ms=3 * DAY_MS, now_ms=F.col("now_ms"))))


@query("ttl_list_tail", f"WITH {LIST_STATE.replace(', s AS (SELECT key, list(value', ', s0 AS (SELECT key, list(value')}, s AS (SELECT key, elements[list_position(list_transform(elements, lambda x: x > 20), true):] AS elements FROM s0 WHERE len(list_filter(elements, lambda x: x > 20)) > 0) {_described_sql()}")
def ttl_list_tail(spark, d):
    """A snapshot filter that stops at the first element it includes and keeps the rest."""
    return _described(lists.non_empty(_lists(spark, d).withColumn("elements", expiry.tail_from_first(F.col("elements"), lambda x: x > 20))))


# key groups and rescale


def _codes(spark, d, m: int) -> DataFrame:
    keys = _events(spark, d).select(F.col("user_id").alias("key")).distinct()
    return keys.select("key", _raw().alias("raw"), keygroups.key_group(_raw(), m).alias("kg"), keygroups.encode(_raw(), m).alias("code"))


def _code_sql(m: int) -> str:
    base, extra = divmod(keygroups.SPACE, m)
    return f"h AS (SELECT DISTINCT user_id AS key, CAST({RAW} AS BIGINT) AS raw FROM events), c AS (SELECT key, raw, raw % {m} AS kg, CAST((raw % {m}) * {base} + least(raw % {m}, {extra}) + raw // {m} AS BIGINT) AS code FROM h)"


@query("keygroup_encode", f"WITH {_code_sql(30000)} SELECT key, raw, kg, code FROM c")
def keygroup_encode(spark, d):
    return _codes(spark, d, 30000)


@query("keygroup_decode", f"WITH {_code_sql(30000)} SELECT key, kg AS decoded FROM c")
def keygroup_decode(spark, d):
    return _codes(spark, d, 30000).select("key", keygroups.decode(F.col("code"), 30000).alias("decoded"))


@query("keygroup_text", f"WITH h AS (SELECT DISTINCT user_id, session_id AS key, hex(encode(session_id)) AS x FROM (SELECT user_id, event_type || '/' || CAST(user_id AS VARCHAR) AS session_id FROM events)), r AS (SELECT DISTINCT key, list_reduce([CAST(1 AS BIGINT)] || list_transform(range(1, len(x) // 2 + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT)), lambda a, b: (a * 31 + b) % 2147483648) AS raw FROM h) SELECT key, CAST(raw AS BIGINT) AS raw, CAST(raw % {M} AS BIGINT) AS kg FROM r")
def keygroup_text(spark, d):
    """Key groups of string keys."""
    keys = _events(spark, d).select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key")).distinct()
    raw = keygroups.bytes_hash(F.col("key"))
    return keys.select("key", raw.alias("raw"), keygroups.key_group(raw, M).alias("kg"))


@query("list_append_bulk", f"WITH l AS (SELECT o_custkey AS key, o_orderdate AS day, count(*) AS n, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2) SELECT key, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * year(day)) AS BIGINT) AS years FROM l GROUP BY key")
def list_append_bulk(spark, d):
    """One bulk append per customer and day: the day's year once per order, so equal elements repeat."""
    days = logs.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("seq"))
    batches = days.select("key", F.array_repeat(F.year("day").cast("long"), F.col("n").cast("int")).alias("elements"), "seq")
    state = lists.list_state(lists.live_elements(logs.list_appends(batches)))
    return state.select("key", F.size("elements").cast("long").alias("n"), F.aggregate("elements", F.lit(0).cast("long"), lambda t, x: t + x).alias("years"))


@query("keygroup_pow2", f"WITH {_code_sql(M)} SELECT key, code FROM c")
def keygroup_pow2(spark, d):
    return _codes(spark, d, M).select("key", keygroups.encode_pow2(F.col("raw"), M).alias("code"))


@query("keygroup_filter", f"WITH {VALUE_STATE} SELECT key, value FROM s WHERE (((key % 2147483648) * 2654435761) % 2147483648) % {M} BETWEEN 32 AND 63")
def keygroup_filter(spark, d):
    return values.value_state(_value_ops(spark, d)).where(_group().between(32, 63)).select("key", "value")


@query("subtask_ranges", f"WITH {_code_sql(M)}, r AS (SELECT i, CAST(ceil(i * {M} / {P}::DOUBLE) AS BIGINT) AS lo, CAST(ceil((i + 1) * {M} / {P}::DOUBLE) AS BIGINT) - 1 AS hi FROM range({P}) t(i)) SELECT i AS subtask, lo, hi, count(*) AS keys FROM c JOIN r ON kg BETWEEN lo AND hi GROUP BY ALL")
def subtask_ranges(spark, d):
    """Keys per subtask, with the key groups that it owns."""
    lo, hi = keygroups.subtask_range(F.col("subtask"), M, P)
    counted = _codes(spark, d, M).groupBy(keygroups.subtask_of(F.col("kg"), M, P).alias("subtask")).agg(F.count(F.lit(1)).alias("keys"))
    return counted.select("subtask", lo.alias("lo"), hi.alias("hi"), "keys")


def _in_task(spark, d) -> DataFrame:
    """Codes of M=1024 with the task of P=3 that owns them, its first code and its span."""
    m, p = 1024, 3
    codes = _codes(spark, d, m).withColumn("subtask", keygroups.subtask_of(F.col("kg"), m, p))
    lo, hi = keygroups.subtask_range(F.col("subtask"), m, p)
    start = keygroups.group_start(lo, m).cast("long")
    return codes.withColumn("start", start).withColumn("span", keygroups.group_start(hi + 1, m).cast("long") - start)


TASKS = f"{_code_sql(1024)}, t AS (SELECT *, (kg * 3) // 1024 AS subtask FROM c), q AS (SELECT *, CAST(ceil(subtask * 1024 / 3.0::DOUBLE) AS BIGINT) * 2097152 AS start, CAST(ceil((subtask + 1) * 1024 / 3.0::DOUBLE) - ceil(subtask * 1024 / 3.0::DOUBLE) AS BIGINT) * 2097152 AS span FROM t), b AS (SELECT *, CAST(((code - start)::HUGEINT * {BUCKETS}) // span AS BIGINT) AS bucket FROM q)"


@query("bucket_map", f"WITH {TASKS} SELECT key, subtask, bucket FROM b")
def bucket_map(spark, d):
    return _in_task(spark, d).select("key", "subtask", keygroups.bucket(F.col("code"), F.col("start"), F.col("span"), BUCKETS).alias("bucket"))


@query("bucket_ranges", f"WITH {TASKS} SELECT subtask, bucket, start + CAST((bucket::HUGEINT * span + {BUCKETS - 1}) // {BUCKETS} AS BIGINT) AS lo, start + CAST(((bucket + 1)::HUGEINT * span + {BUCKETS - 1}) // {BUCKETS} AS BIGINT) - 1 AS hi, count(*) AS keys FROM b GROUP BY subtask, bucket, start, span")
def bucket_ranges(spark, d):
    """The buckets that hold keys, with their code ranges; every key lies in its bucket's range."""
    held = _in_task(spark, d).withColumn("bucket", keygroups.bucket(F.col("code"), F.col("start"), F.col("span"), BUCKETS)).groupBy("subtask", "bucket", "start", "span").agg(F.count(F.lit(1)).alias("keys"))
    lo, hi = keygroups.bucket_range(F.col("bucket"), F.col("start"), F.col("span"), BUCKETS)
    return held.select("subtask", "bucket", lo.alias("lo"), hi.alias("hi"), "keys")


def _ranges(codes: DataFrame, p: int) -> DataFrame:
    lo, hi = keygroups.subtask_range(F.col("task"), M, p)
    return codes.select(keygroups.subtask_of(F.col("kg"), M, p).alias("task")).distinct().select("task", lo.alias("lo"), hi.alias("hi"))


def _range_sql(p: int) -> str:
    return f"SELECT i AS task, CAST(ceil(i * {M} / {p}::DOUBLE) AS BIGINT) AS lo, CAST(ceil((i + 1) * {M} / {p}::DOUBLE) AS BIGINT) - 1 AS hi FROM range({p}) t(i)"


@query("rescale_overlap", f"WITH {_code_sql(M)}, o AS ({_range_sql(3)}), n AS ({_range_sql(2)}), x AS (SELECT o.task AS old, n.task AS new, greatest(o.lo, n.lo) AS lo, least(o.hi, n.hi) AS hi, greatest(o.lo, n.lo) > o.lo OR least(o.hi, n.hi) < o.hi AS clipped FROM o JOIN n ON o.lo <= n.hi AND o.hi >= n.lo) SELECT x.*, count(key) AS keys FROM x LEFT JOIN c ON kg BETWEEN lo AND hi GROUP BY ALL")
def rescale_overlap(spark, d):
    """From 3 subtasks to 2: which old range feeds which new one, whether it must be filtered, and how many keys move."""
    codes = _codes(spark, d, M)
    plan = snapshots.rescale_plan(_ranges(codes, 3), _ranges(codes, 2))
    moved = codes.groupBy(keygroups.subtask_of(F.col("kg"), M, 3).alias("old"), keygroups.subtask_of(F.col("kg"), M, 2).alias("new")).agg(F.count(F.lit(1)).alias("keys"))
    return plan.join(moved, ["old", "new"], "left").select("old", "new", "lo", "hi", "clipped", F.coalesce("keys", F.lit(0)).cast("long").alias("keys"))


# snapshots


def _cut(spark, d, share: float) -> int:
    """A sequence number in the log: one aggregate to the driver."""
    top = _events(spark, d).agg(F.max("event_id")).first()[0]
    return int((top or 0) * share)


def _cut_sql(share: float) -> str:
    return f"(SELECT CAST(floor(max(event_id) * {share}::DOUBLE) AS BIGINT) FROM events)"


@query("snapshot_at_seq", f"WITH {VALUE_OPS} SELECT key, arg_max(value, seq) AS value FROM v WHERE seq <= {_cut_sql(CUT)} GROUP BY key HAVING arg_max(op, seq) = 'PUT'")
def snapshot_at_seq(spark, d):
    return values.value_state(snapshots.at(_value_ops(spark, d), _cut(spark, d, CUT))).select("key", "value")


@query("snapshot_incremental", f"WITH {VALUE_OPS} SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, count(*) AS n FROM v WHERE seq > {_cut_sql(PREVIOUS_CUT)} AND seq <= {_cut_sql(CUT)} GROUP BY key")
def snapshot_incremental(spark, d):
    """Keys that an increment carries, tombstones included."""
    added = snapshots.increment(_value_ops(spark, d), _cut(spark, d, PREVIOUS_CUT), _cut(spark, d, CUT))
    return added.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"), F.count(F.lit(1)).alias("n"))


VALUE_SPEC = StateSpec("latest", "VALUE", T.LongType(), T.StringType())
MAP_SPEC = StateSpec("by_k", "MAP", T.LongType(), T.StringType(), subkey=T.IntegerType())


@query("savepoint_items", f"WITH {VALUE_STATE}, m AS (SELECT key, k AS subkey, arg_max(value, seq) AS value FROM v GROUP BY key, k HAVING arg_max(op, seq) = 'PUT'), i AS (SELECT 'VALUE' AS state_type, 'latest' AS state_name, key, NULL::VARCHAR AS map_key, value FROM s UNION ALL SELECT 'MAP', 'by_k', key, CAST(subkey AS VARCHAR), value FROM m) SELECT state_type, state_name, CAST((((key % 2147483648) * 2654435761) % 2147483648) % {M} AS INTEGER) AS key_group, key, NULL::VARCHAR AS ns, map_key, CAST({CENTS.format('value')} AS VARCHAR) AS value FROM i")
def savepoint_items(spark, d):
    """Two states as one ordered stream of items."""
    in_cents = lambda state: state.withColumn("value", _cents(F.col("value")))
    return snapshots.savepoint(
        snapshots.items(in_cents(values.value_state(_value_ops(spark, d))), VALUE_SPEC, _group()),
        snapshots.items(in_cents(maps.entries(_map_ops(spark, d))), MAP_SPEC, _group()),
    ).drop("write_ms")


LIST_SPEC = StateSpec("recent", "SUB_LIST", T.LongType(), T.DoubleType(), namespace=T.DateType())
TIMER_SPEC = StateSpec("due", "PQ", T.LongType(), T.LongType())


@query("savepoint_round_trip", f"WITH {VALUE_STATE}, {NS_LIST_STATE.replace(', s AS (', ', sl AS (')}, t AS (SELECT o_custkey AS key, epoch_ms(o_orderdate) AS ts_ms FROM orders GROUP BY 1, 2 HAVING arg_max(o_orderstatus, o_orderkey) <> 'F') SELECT 'VALUE' AS kind, key, NULL::VARCHAR AS ns, CAST({CENTS.format('value')} AS VARCHAR) AS value FROM s WHERE write_ms + {TTL_MS} > (SELECT max(write_ms) FROM v) UNION ALL SELECT 'SUB_LIST', key, CAST(ns AS VARCHAR), array_to_string(list_transform(elements, lambda x: CAST(round(x * 100) AS BIGINT)), ',') FROM sl UNION ALL SELECT 'PQ', key, NULL, CAST(ts_ms AS VARCHAR) FROM t")
def savepoint_round_trip(spark, d):
    """Values (still expiring by their write time), namespaced lists and timers out as items and back."""
    saved = snapshots.savepoint(
        snapshots.items(values.value_state(_value_ops(spark, d)), replace(VALUE_SPEC, value=T.DoubleType()), _group()),
        snapshots.items(_lists(spark, d, "key", "ns"), LIST_SPEC, _group()),
        snapshots.items(_timers(spark, d), TIMER_SPEC, _group()),
    )
    held = _unexpired(values.value_state(snapshots.as_ops(saved, "double")), _now(spark, d), TTL_MS)
    whole = lists.list_state(lists.live_elements(snapshots.as_list_ops(saved, "double"), "key", "ns"), "key", "ns")
    pending = timers.pending(snapshots.as_timer_ops(saved), _group())
    none = F.lit(None).cast("string")
    return (
        held.select(F.lit("VALUE").alias("kind"), "key", none.alias("ns"), _cents(F.col("value")).cast("string").alias("value"))
        .unionByName(whole.select(F.lit("SUB_LIST").alias("kind"), "key", "ns", F.array_join(F.transform("elements", _cents), ",").alias("value")))
        .unionByName(pending.select(F.lit("PQ").alias("kind"), "key", none.alias("ns"), F.col("ts_ms").cast("string").alias("value")))
    )


@query("restore_rescaled", f"WITH {VALUE_OPS}, b AS (SELECT * FROM v WHERE seq <= {_cut_sql(PREVIOUS_CUT)} OR seq > {_cut_sql(CUT)}) SELECT key, arg_max(value, seq) AS value FROM b GROUP BY key HAVING arg_max(op, seq) = 'PUT' AND (((key % 2147483648) * 2654435761) % 2147483648) % {M} BETWEEN 43 AND 85")
def restore_rescaled(spark, d):
    """Two snapshots by halves of the key groups, restored into the second of three subtasks, then later writes."""
    ops = _value_ops(spark, d)
    saved = values.last_writes(snapshots.at(ops, _cut(spark, d, PREVIOUS_CUT)))
    halves = [snapshots.of_subtask(saved, _group(), i, M, 2) for i in (0, 1)]
    later = ops.where(F.col("seq") > _cut(spark, d, CUT)).select(*saved.columns)
    return snapshots.of_subtask(values.value_state(snapshots.restore(halves, later)), _group(), 1, M, 3).select("key", "value")


@query("migrate_value_schema", f"WITH {VALUE_STATE} SELECT key, CAST(subkey_len AS BIGINT) AS value FROM (SELECT s.key, length(arg_max(v.subkey, v.seq)) AS subkey_len FROM s JOIN v ON s.key = v.key GROUP BY s.key)")
def migrate_value_schema(spark, d):
    """INT values re-written as BIGINT; the key type could not change."""
    old = StateSpec("kind_length", "VALUE", T.LongType(), T.IntegerType())
    new = StateSpec("kind_length", "VALUE", T.LongType(), T.LongType())
    ops = _value_ops(spark, d).withColumn("value", F.char_length("subkey"))
    return snapshots.migrate(values.value_state(ops), old, new).select("key", "value")


@query("log_compaction", f"WITH {VALUE_OPS}, n AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, max(seq) AS seq FROM v WHERE seq > {_cut_sql(CUT)} GROUP BY key) SELECT * FROM n")
def log_compaction(spark, d):
    """The newer part of the log, where tombstones must stay."""
    return snapshots.compact(_value_ops(spark, d).where(F.col("seq") > _cut(spark, d, CUT)), full=False).select("key", "op", "value", "seq")


@query("log_compaction_full", f"WITH {LIST_STATE.split(', s AS (')[0]} SELECT key, op, value, seq FROM e")
def log_compaction_full(spark, d):
    """A whole list log: what lies before the last reset goes, and so do the tombstones."""
    return snapshots.compact_lists(_list_ops(spark, d), full=True).select("key", "op", "value", "seq")


def _documents(spark, d) -> DataFrame:
    return logs.table(spark, d, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("value"), F.col("page_id").alias("seq"))


@query("blob_separation", f"SELECT page_id AS key, CASE WHEN strlen(html) <= {BLOB_BYTES} THEN strlen(html) END AS inline_bytes, CASE WHEN strlen(html) > {BLOB_BYTES} THEN page_id END AS blob_id FROM pages")
def blob_separation(spark, d):
    kept, _ = snapshots.separate(_documents(spark, d), BLOB_BYTES)
    return kept.select("key", F.octet_length("value").cast("long").alias("inline_bytes"), "blob_id")


@query("blob_read", "SELECT page_id AS key, strlen(html) AS bytes, sha256(html) AS digest FROM pages")
def blob_read(spark, d):
    """Values read back, inline or through their blob."""
    kept, blobs = snapshots.separate(_documents(spark, d), BLOB_BYTES)
    whole = kept.join(blobs.withColumnRenamed("value", "blob"), "blob_id", "left").withColumn("value", F.coalesce("value", "blob"))
    return whole.select("key", F.octet_length("value").cast("long").alias("bytes"), F.sha2("value", 256).alias("digest"))


@query("blob_gc", f"SELECT page_id AS blob_id, strlen(html) AS bytes FROM pages WHERE strlen(html) > {BLOB_BYTES} AND page_id % 3 <> 0")
def blob_gc(spark, d):
    """Blobs left after the state of every third page is gone."""
    kept, blobs = snapshots.separate(_documents(spark, d), BLOB_BYTES)
    return snapshots.collect_blobs(blobs, kept.where("key % 3 <> 0")).select("blob_id", F.octet_length("value").cast("long").alias("bytes"))


@query("log_statistics", f"WITH {VALUE_OPS}, n AS (SELECT CAST((((key % 2147483648) * 2654435761) % 2147483648) % {M} AS BIGINT) AS kg, key, count(*) AS n, count(*) FILTER (WHERE op = 'DELETE') AS d, arg_max(op, seq) AS last FROM v GROUP BY 1, 2), g AS (SELECT kg, CAST(sum(n) AS BIGINT) AS ops, CAST(sum(d) AS BIGINT) AS tombstones, count(*) AS keys, count(*) FILTER (WHERE last <> 'DELETE') AS live FROM n GROUP BY kg) SELECT *, CASE WHEN live > 0 THEN CAST(ops AS DOUBLE) / live END AS amplification FROM g")
def log_statistics(spark, d):
    return maintenance.log_statistics(_value_ops(spark, d), _group())


@query("compaction_candidates", ORACLE_SQL["log_statistics"].replace("SELECT *, CASE", "SELECT kg, CASE") + " WHERE live = 0 OR CAST(ops AS DOUBLE) / live > 70")
def compaction_candidates(spark, d):
    return maintenance.compaction_candidates(maintenance.log_statistics(_value_ops(spark, d), _group()), 70.0).select("kg", "amplification")


@query("coldest_first", f"SELECT CAST({RAW} % {M} AS BIGINT) AS kg, max(event_id) AS last_seq, count(*) AS ops FROM events GROUP BY 1")
def coldest_first(spark, d):
    return maintenance.coldest_first(_value_ops(spark, d), _group()).orderBy("last_seq")


@query("broadcast_state", f"WITH {VALUE_STATE} SELECT r_name AS region, count(*) AS keys, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM s JOIN customer ON c_custkey = key JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def broadcast_state(spark, d):
    """Keyed state next to a broadcast state: 25 nations in 5 regions, fixed in size."""
    nations = logs.table(spark, d, "nation").join(logs.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    state = values.value_state(_value_ops(spark, d)).join(_customers(spark, d), "key")
    return state.join(F.broadcast(nations), "c_nationkey").groupBy("region").agg(F.count(F.lit(1)).alias("keys"), _money().alias("value"))


# the same state live, on transformWithState


@query("live_value", f"WITH {VALUE_STATE} SELECT key, value FROM s")
def live_value(spark, d):
    return live.run(_value_ops(spark, d).select("key", "op", "value", "seq"), live.ValueProcessor()).where("value is not null")


@query("live_list", f"WITH {LIST_STATE} {_described_sql()}")
def live_list(spark, d):
    state = live.run(_list_ops(spark, d).select("key", "op", "value", "seq"), live.ListProcessor())
    return _described(lists.non_empty(state))


@query("live_map", f"WITH {MAP_STATE} SELECT key, subkey, value FROM s")
def live_map(spark, d):
    state = live.run(_map_ops(spark, d).select("key", "subkey", "op", "value", "seq"), live.MapProcessor())
    return state.select("key", F.explode("entries").alias("subkey", "value"))


@query("live_reduce", f"WITH {LIVE} SELECT key, max(value) AS value FROM a GROUP BY key")
def live_reduce(spark, d):
    return live.run(_puts(spark, d).select("key", "op", "value", "seq"), live.ReducingProcessor(max))

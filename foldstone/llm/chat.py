"""Chat formatting in budgeted windows, and reading the result back.

Turns of a conversation are numbered in order and cut into turn-aligned spans by
their running token sums: a span takes turns as long as they fit what the budget
leaves beside the system turn and the history. A span becomes a window: the
system turn that opens the conversation, then as many of the turns before the
span as fit the history budget (and what the span has left), then the span
itself. A window therefore stays within the budget, except where the system turn
and a single turn exceed it together; then it holds these two and no history.
Repeated turns (system and history) are masked, so each assistant text is a
target in exactly one window.

A turn counts ceil(UTF-8 bytes / 4) + OVERHEAD tokens: a counter that any engine
can follow, and one that errs towards more tokens for most vocabularies.

Windows are planned on numbers alone (conversation, turn, tokens); texts join the
finished plan once. A conversation is numbered in two levels (TURNS turn numbers
at a time) and planned PART turns at a time, where a span ends in any case; the
few turns that can be history of the next part are sent there too. So one
conversation that holds a third of all rows is spread over tasks. Only the
digests of a whole conversation, which are sequential by nature, read it in one
task, and they stream over its windows.

Template of a turn: `<turn:ROLE>` TEXT `</turn>` newline. Inside role and text
`\\` becomes `\\\\`, `<` becomes `\\l` and `>` becomes `\\g`, so no control
string can occur in them, and every text comes back unchanged.

Defined results: null role or text is empty. A null conv_id is a conversation,
a null turn comes first. Rows with the same turn number are ordered by role and
text; repeated rows are turns of their own. Only a system turn in first place
is retained. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldstone.llm.shared import arrow_rows, stage

SPAN, HISTORY, TURNS, PART, OVERHEAD = 512, 128, 256, 1024, 4
_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
_BACK = {v: k for k, v in _ESCAPES.items()}
_CLOSE = "</turn>\n"

WINDOW_SCHEMA = "conv_id long, window long, formatted string, loss array<struct<start:int,end:int>>, n_context int"


def escape(text: str) -> str:
    return re.sub(r"[\\<>]", lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: _BACK[m[0]], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    turns = []
    for part in formatted.split(_CLOSE)[:-1]:
        role, _, text = part.removeprefix("<turn:").partition(">")
        turns.append((unescape(role), unescape(text)))
    return turns


def token_count(text):
    return (F.ceil(F.octet_length(text) / 4) + OVERHEAD).cast("long")


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, slab, nth, role, text): turns numbered inside their slab of TURNS turn numbers."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("slab", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(1 << 62))))
    order = Window.partitionBy("conv_id", "slab").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("nth", F.row_number().over(order)).drop("turn")


def _plan(numbered: DataFrame, span: int, history: int) -> DataFrame:
    """(conv_id, slab, nth, at, window, context): which turns make up each window; a window is named by its first own turn."""
    slim = numbered.select("conv_id", "slab", "nth", token_count(F.col("text")).alias("tokens"), (F.col("role") == "system").alias("system"))
    slabs = slim.groupBy("conv_id", "slab").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("nth") == 1, F.struct("system", "tokens"))).alias("head"))
    by_slab = Window.partitionBy("conv_id").orderBy("slab")
    before, upto = by_slab.rowsBetween(Window.unboundedPreceding, -1), by_slab.rowsBetween(Window.unboundedPreceding, 0)
    slabs = slabs.select(
        F.col("conv_id").alias("__c"), F.col("slab").alias("__s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.first("slab").over(upto).alias("head_slab"), F.first("head").over(upto).alias("head"),
    )
    placed = slim.drop("system").join(slabs, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("slab") == F.col("__s")))
    at = F.col("n0") + F.col("nth") - 1
    placed = placed.select("conv_id", "slab", "nth", "tokens", "head_slab", at.alias("at"), F.when(F.col("head.system"), F.col("head.tokens")).alias("system"), F.floor(at / PART).alias("part"))
    last = placed.where(F.pmod("at", F.lit(PART)) >= PART - history // OVERHEAD).withColumn("part", F.col("part") + 1)
    dealt = placed.union(last).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")
    return arrow_rows(dealt, "conv_id long, slab long, nth int, at long, window long, context boolean", lambda rows: _spans(rows, span, history), 16384)


def _spans(rows: Iterator[dict], span: int, history: int) -> Iterator[tuple]:
    """Cuts the turns of each part, which come in order behind the last turns of the part before it."""
    group, own, used, past = None, [], 0, deque()

    def window() -> Iterator[tuple]:
        first, system = own[0], own[0]["system"]
        if system is not None and first["at"]:
            yield first["conv_id"], first["head_slab"], 1, 0, first["at"], first["at"] > 1
        left, repeated = min(history, span - (system or 0) - used), []
        for turn in reversed(past):
            if turn["tokens"] > left:
                break
            left -= turn["tokens"]
            repeated.append(turn)
        for turns, context in ((reversed(repeated), True), (own, False)):
            for turn in turns:
                yield first["conv_id"], turn["slab"], turn["nth"], turn["at"], first["at"], context

    for row in rows:
        if (row["conv_id"], row["part"]) != group:
            if own:
                yield from window()
            group, own, used, past = (row["conv_id"], row["part"]), [], 0, deque(maxlen=history // OVERHEAD)
        opens = row["at"] == 0 and row["system"] is not None
        if row["at"] // PART < row["part"]:
            if not opens:
                past.append(row)
            continue
        if own and own[0]["at"] == 0 and row["system"] is not None:
            own, used = [], 0  # the system turn is a window only where it is alone: the next one brings it along
        elif own and used + row["tokens"] > span - history - (row["system"] or 0):
            yield from window()
            past.extend(own)
            own, used = [], 0
        own.append(row)
        used += row["tokens"]
    if own:
        yield from window()


def windows(turns: DataFrame, span: int = SPAN, history: int = HISTORY) -> DataFrame:
    """One row per window (WINDOW_SCHEMA): the formatted text, the loss mask as code point ranges, the repeated turns."""
    if not 0 <= history <= span:
        raise ValueError("the history budget must lie between 0 and the span budget")
    rows = stage(_numbered(turns), "turns")
    plan = stage(_plan(rows, span, history), "window-plan").select(F.col("conv_id").alias("__c"), F.col("slab").alias("__s"), F.col("nth").alias("__n"), "at", "window", "context")
    made = rows.join(plan, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("slab") == F.col("__s")) & (F.col("nth") == F.col("__n")))
    shuffled = made.select("conv_id", "window", "at", "context", "role", "text").repartition("conv_id", "window").sortWithinPartitions("conv_id", "window", "at")
    return stage(arrow_rows(shuffled, WINDOW_SCHEMA, _format, 1024), "chat-windows")


def _format(rows: Iterator[dict]) -> Iterator[tuple]:
    at, turns = None, []
    for row in rows:
        if (row["conv_id"], row["window"]) != at:
            if turns:
                yield _window(*at, turns)
            at, turns = (row["conv_id"], row["window"]), []
        turns.append(row)
    if turns:
        yield _window(*at, turns)


def _window(conv_id: int | None, window: int, turns: list[dict]) -> tuple:
    parts, loss, place, context = [], [], 0, 0
    for turn in turns:
        head, text = f"<turn:{escape(turn['role'])}>", escape(turn["text"])
        context += turn["context"]
        place += len(head)
        if not turn["context"] and turn["role"] == "assistant":
            loss.append({"start": place, "end": place + len(text)})
        place += len(text) + len(_CLOSE)
        parts += [head, text, _CLOSE]
    return conv_id, window, "".join(parts), loss, context


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, their digest, and what the loss mask covers."""

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        now: list = []

        def told() -> tuple:
            conv_id, n, turns, chars, loss, size = now
            return conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for window in each:
            if not now or now[0] != window["conv_id"]:
                if now:
                    yield told()
                now = [window["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = window["formatted"]
            for role, said in parse(text)[window["n_context"] :]:
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
            for span in window["loss"]:
                said = unescape(text[span["start"] : span["end"]])
                now[3] += len(said)
                now[4].update(said.encode())
            now[5] += len(text)
        if now:
            yield told()

    together = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return arrow_rows(together, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", rows)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(windows(turns.unionByName(extra)))


ORACLE_SQL = rf"""
WITH RECURSIVE r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, row_number() OVER w - 1 AS nth, CAST(ceil(strlen(text) / 4.0) + {OVERHEAD} AS BIGINT) AS tokens, first_value(role) OVER w = 'system' AS headed,
             length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '>', '\g')) + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g')) + 15 AS chars
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, nth = 0 AND headed AS retained, coalesce(max(tokens) FILTER (WHERE nth = 0 AND headed) OVER (PARTITION BY conv_id), 0) AS sys FROM t),
o AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY nth ROWS UNBOUNDED PRECEDING) - tokens AS BIGINT) AS upto FROM s WHERE NOT retained),
w(conv_id, nth, first, used) AS (
  SELECT conv_id, min(nth), min(nth), arg_min(tokens, nth) FROM o GROUP BY conv_id
  UNION ALL
  SELECT o.conv_id, o.nth, CASE WHEN w.used + o.tokens > {SPAN - HISTORY} - o.sys OR o.nth % {PART} = 0 THEN o.nth ELSE w.first END,
         CASE WHEN w.used + o.tokens > {SPAN - HISTORY} - o.sys OR o.nth % {PART} = 0 THEN o.tokens ELSE w.used + o.tokens END
  FROM w JOIN o ON o.conv_id = w.conv_id AND o.nth = w.nth + 1),
f AS (SELECT conv_id, first, max(used) AS used FROM w GROUP BY ALL),
h AS (SELECT p.conv_id, sum(p.chars) AS chars FROM f JOIN o b ON b.conv_id = f.conv_id AND b.nth = f.first
      JOIN o p ON p.conv_id = f.conv_id AND p.nth < f.first AND b.upto - p.upto <= least({HISTORY}, {SPAN} - b.sys - f.used) GROUP BY ALL),
n AS (SELECT conv_id, count(*) AS n FROM f GROUP BY ALL)
SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(s.chars) + coalesce(max(h.chars), 0) + coalesce(sum(s.chars) FILTER (WHERE retained), 0) * (greatest(coalesce(max(n.n), 1), 1) - 1) AS BIGINT) AS formatted_chars
FROM s LEFT JOIN h ON s.conv_id = h.conv_id LEFT JOIN n ON s.conv_id = n.conv_id GROUP BY s.conv_id
"""

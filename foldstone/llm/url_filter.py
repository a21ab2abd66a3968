"""URL filters: a blocked Bloom filter ahead of an exact hash join.

A listed URL is a canonical key, host and path. A page's probes are the keys
that could list it: each suffix of its host at a dot, with each prefix of its
path up to the longest listed one. A probe's hash is made of a running sum over
the path and one over the host from its end, so all prefixes and suffixes cost
one pass each, however many lengths the list has. The probes meet a blocked
Bloom filter (bounded in size whatever the list, see `bloom`); possible hits go
on to a hash join with the list itself, which removes false positives, and the
longest listed key decides. A page without possible hits never meets the list.

A fuller list raises only the share of pages that reach the join, never the
answer. A key that holds a third of the pages is left to the skew join (or to
a broadcast of the list when Spark has measured it as small).

Defined results: a null URL, or one without "://", has an empty host and path
and no rule. Repeated rows give one result each. Rules with an equal key: the
smaller verdict wins (allow before block); a rule without host, path or verdict
is none. An empty list gives the default
verdict, an empty table an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.llm import bloom
from foldstone.llm.shared import arrow_rows, stage

#: Probes that are looked up at a time.
PROBES = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url):
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _avalanche(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _running(text: str, seed: int) -> np.ndarray:
    """n + 1 hashes, of the first 0, 1, ... n code points."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    weights = _avalanche((np.arange(len(points), dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * weights)))


def _joint(host: np.ndarray, path: np.ndarray) -> np.ndarray:
    return _avalanche(path + _avalanche(host))


def key_hash(host: str, path: str) -> int:
    """Signed 64-bit hash of a listed key; equal to that of the probe with this suffix and prefix."""
    return int(_joint(_running(host[::-1], 1)[-1:], _running(path, 1 << 32)[-1:]).view(np.int64)[0])


def possible_hits(words: np.ndarray, host: str, path: str) -> Iterator[tuple[int, int]]:
    """(characters of the host's suffix, of the path's prefix) of the probes that the filter does not rule out."""
    tails = _running(host[::-1], 1)
    sizes = np.array([len(host), *(len(host) - i - 1 for i, c in enumerate(host) if c == ".")])
    heads = _running(path, 1 << 32)
    step = max(1, PROBES // len(heads))
    for start in range(0, len(sizes), step):
        some = sizes[start : start + step]
        hit = bloom.maybe(words, _joint(tails[some][:, None], heads[None, :]).ravel())
        for at in np.flatnonzero(hit).tolist():
            yield int(some[at // len(heads)]), at % len(heads)


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict). listed: (host, path, verdict) of canonical URLs or prefixes."""
    spark = pages.sparkSession
    listed = listed.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where("host is not null and path is not null and verdict is not null")
    listed = stage(listed.groupBy("host", "path").agg(F.min("verdict").alias("verdict")), "url-list")

    def hashes(each: Iterator[dict]) -> Iterator[tuple]:
        for row in each:
            yield (key_hash(row["host"], row["path"]),)

    words = spark.sparkContext.broadcast(bloom.filter_words(arrow_rows(listed.select("host", "path"), "h long", hashes, 16384)))
    longest = listed.agg(F.coalesce(F.max(F.char_length("path")), F.lit(0))).first()[0]

    def probed(each: Iterator[dict]) -> Iterator[tuple]:
        for page in each:
            yield page["page_id"], page["host"], page["path"], [{"h": h, "p": p} for h, p in possible_hits(words.value, page["host"], page["path"][:longest])]

    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, hits array<struct<h:int,p:int>>"
    asked = stage(arrow_rows(split, schema, probed, 4096).withColumn("row", F.monotonically_increasing_id()), "url-probes")
    none = asked.where(F.size("hits") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    probes = asked.where(F.size("hits") > 0).select("row", "page_id", F.col("host").alias("own_host"), F.col("path").alias("own_path"), F.explode("hits").alias("hit"))
    keyed = probes.select("row", "page_id", "own_host", "own_path", F.when(F.col("hit.h") > 0, F.expr("right(own_host, hit.h)")).otherwise("").alias("host"), F.expr("left(own_path, hit.p)").alias("path"))
    rule = F.concat("host", "path")
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.char_length(rule).alias("n"), rule.alias("rule"), "verdict")))
    decided = (
        keyed.join(listed, ["host", "path"], "left").groupBy("row", "page_id", "own_host", "own_path").agg(best.alias("best"))
        .select("page_id", F.col("own_host").alias("host"), F.col("own_path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
    return none.unionByName(decided)


def rule_list(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_list(spark))


ORACLE_SQL = r"""
WITH r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (SELECT page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM s),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
      FROM (SELECT p.page_id, r.* FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""

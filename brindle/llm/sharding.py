"""Sharding by histogram sort.

Rows are keyed by (hash of the text, doc_id), so copies lie together yet a large group of them can be cut. Probes between the
current bounds of each splitter are counted exactly (bytes and rows below each) over all partitions, the bounds shrink to the
nearest probes, and rounds go on until every splitter is within tolerance of its share of the bytes or no row lies between its
bounds. Each shard is split further, more loosely, into intervals of about INTERVAL_BYTES, so that a task holds one interval however
large the shards are. Only then are rows exchanged, once, each interval to its own task. The shards' order is that of the keys.

Ties: rows equal in text and doc_id share one key and stay in one interval, in any order.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import binary_descent, longs, materialize, table

SHARDS = 24
OVERHEAD = 8
#: Of a splitter from its share of the bytes: of one between shards as a part of a shard's bytes, of one within as a part of an interval's.
TOLERANCE, INNER_TOLERANCE = 0.0002, 0.25
INTERVAL_BYTES = 16 << 20
LOW = -(1 << 63)


def _keys(docs: DataFrame) -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return {"__k1": F.xxhash64(text), "__k2": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)), "__size": (F.octet_length(text) + OVERHEAD).cast("long")}


def interval(cuts: list[tuple[int, int]]) -> Column:
    """Number of cuts at or below the row's key."""
    one, two = longs([a for a, _ in cuts]), longs([b for _, b in cuts])
    return binary_descent(len(cuts), lambda j: (F.get(one, j) < F.col("__k1")) | ((F.get(one, j) == F.col("__k1")) & (F.get(two, j) <= F.col("__k2"))))


def _counts(light: DataFrame, cuts: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each cut."""
    found = {r[0]: (r[1], r[2]) for r in light.groupBy(interval(cuts).alias("at")).agg(F.sum("__size"), F.count("*")).collect()}  # at most a row for each cut and one more
    out: tuple[list[int], list[int]] = ([], [])
    held = rows = 0
    for k in range(len(cuts)):
        held, rows = held + found.get(k, (0, 0))[0], rows + found.get(k, (0, 0))[1]
        out[0].append(held)
        out[1].append(rows)
    return out


def splitters(light: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, interval_bytes: int = INTERVAL_BYTES) -> tuple[list[tuple[int, int]], int]:
    """light (__k1, __k2, __size): keys at which the intervals start (but for the first), and the intervals of a shard."""
    total, rows, low1, high1, low2, high2 = light.agg(F.sum("__size"), F.count("*"), F.min("__k1"), F.max("__k1"), F.min("__k2"), F.max("__k2")).first()
    if not rows:
        return [(0, 0)] * (shards - 1), 1
    per = -(-total // (interval_bytes * shards))
    width = high2 - low2 + 1  # keys as integers: k1 and then k2, each within its range
    key = lambda x: (x // width + low1, x % width + low2)
    end = (high1 - low1 + 1) * width
    wanted = [total * j / (per * shards) for j in range(1, per * shards)]
    allowed = [(INNER_TOLERANCE / per if j % per else tolerance) * total / shards for j in range(1, per * shards)]
    known = {0: (0, 0), end: (total, rows)}
    found: dict[int, int] = {}
    while True:
        points = sorted(known)
        held = [known[x][0] for x in points]
        probes: set[int] = set()
        for j, want in enumerate(wanted):
            if j in found:
                continue
            at = max(1, bisect_left(held, want))
            lo, hi = points[at - 1], points[at]
            best = min((lo, hi), key=lambda x: abs(known[x][0] - want))
            if abs(known[best][0] - want) <= allowed[j] or hi - lo <= 1 or known[hi][1] - known[lo][1] <= 1:
                found[j] = best
                continue
            span, part = hi - lo, (want - held[at - 1]) / max(1, held[at] - held[at - 1])
            guess = lo + int(span * part)
            probes |= {x for x in [lo + span * k // 8 for k in range(1, 8)] + [guess + s * (span >> b) for b in (4, 8, 12) for s in (-1, 1)] + [guess, lo + 1] if lo < x < hi}
        if not probes:
            break
        tried = sorted(probes)
        for x, b, n in zip(tried, *_counts(light, [key(x) for x in tried]), strict=True):
            known[x] = (b, n)
    return [key(found[j]) if found[j] < end else ((1 << 63) - 1, (1 << 63) - 1) for j in range(len(wanted))], per


def assign(rows: DataFrame, light: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows (with the key columns) and their shard and slot; light has the same rows' keys and sizes."""
    cuts, per = splitters(light, shards)
    found = {r[0]: r[1] for r in light.groupBy(interval(cuts).alias("at")).count().collect()}  # a row for each interval
    before, base = [], 0
    for k in range(per * shards):
        base = 0 if k % per == 0 else base
        before.append(base)
        base += found.get(k, 0)
    # an interval is a partition, so a row's place in it is all that its number in the partition says
    dealt = rows.withColumn("__at", interval(cuts)).repartitionById(per * shards, F.col("__at")).sortWithinPartitions("__k1", "__k2")
    slot = F.get(longs(before), F.col("__at")) + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return dealt.withColumns({"shard": F.floor(F.col("__at") / per).cast("int"), "slot": slot.cast("long")}).drop("__at")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with shard (0 to shards - 1, of near equal bytes) and slot (gapless from 0 in each shard).

    A row's size is its text's UTF-8 bytes (null: none) plus OVERHEAD. Null ids sort first. Rows that repeat text and doc_id share
    one key and stay in one shard; a group of copies with ids of their own can be cut anywhere. Columns of docs named shard or
    slot are replaced. An empty table gives an empty result.
    """
    light = materialize(docs.select(*[c.alias(n) for n, c in _keys(docs).items()]), "keys")
    rows = docs.drop("shard", "slot")
    return assign(rows.withColumns(_keys(rows)), light, shards).drop("__k1", "__k2", "__size")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    return sharded.select("doc_id", _keys(sharded)["__size"].alias("size"), crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

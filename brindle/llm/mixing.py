"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash. A document's virtual finish time is its source's words up to and with it,
divided by the source's target; a source that must give more than it has goes round again, up to `repeats` times. All sources'
items are ordered by finish time and the order is cut where the words reach the budget.

Nothing is gathered by source: running sums are windows over (source, slice of the hash range) plus offsets of the slices. As the
order within a source is fixed, the cut is one point for each source, and documents are kept by comparing with their source's
point: texts are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import WORD_GAP, materialize, numbered, shuffle_partitions, table

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
SEED = 17
#: Slices of the finish times; only the slice in which the budget ends is sorted.
SLICES = 1 << 14


def words(text: Column) -> Column:
    """The pieces between gaps, less the empty ones before a gap at the start and after one at the end."""
    text = F.coalesce(text, F.lit(""))
    gaps = [chr(c) for c in (0x20, *range(0x09, 0x0E))]
    ends = F.when(F.left(text, F.lit(1)).isin(gaps), 1).otherwise(0) + F.when(F.right(text, F.lit(1)).isin(gaps), 1).otherwise(0)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, WORD_GAP)) - ends).cast("long")


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with size, key (the source, also where null) and place: the document's place in its source's shuffled order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.struct(F.xxhash64(F.lit(seed), "doc_id", text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"))
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    return docs.withColumns({"__size": words(F.col("text")), "__key": key, "__place": place})


def _targets(sizes: DataFrame, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """sizes (source, key, size, most): the targets, shared by weight; what goes beyond repeats * size is shared again."""
    k = len(weights)
    listed = numbered(sizes, "at", F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("at") % k + 1).cast("int"))
    listed = materialize(listed.withColumn("weight", weight), "sources")
    cap, total, level, full = F.col("size") * float(repeats), None, 0.0, -1
    while True:  # the set of full sources only grows
        held = F.when(cap <= level * F.col("weight"), True).otherwise(False) if full >= 0 else F.lit(False)
        row = listed.agg(F.sum("size"), F.sum(F.when(held, cap)), F.sum(F.when(~held, F.col("weight"))), F.count(F.when(held, 1))).first()
        total = float(row[0] or 0)
        if row[3] == full or not row[2]:
            break
        full, level = row[3], (total - (row[1] or 0.0)) / row[2]
    return listed.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def plan(light: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """light (source, key, size, place): for each source key, source_size, target, rounds and point.

    A document is taken rounds times, and once more if its place is at or before point (null: no document is).
    """
    spark = light.sparkSession
    sizes = light.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("size"), F.max("size").alias("most"), F.count("*").alias("n"))
    sources = materialize(_targets(sizes, weights, repeats), "targets")
    rows, budget, most, free = sources.agg(F.sum("n"), F.sum("size"), F.sum("most"), F.sum(F.when(F.col("target") < F.col("size") * float(repeats), F.col("target")))).first()
    budget = budget or 0
    bits = max(4, math.ceil(math.log2(max(4 * shuffle_partitions(spark), (rows or 0) / 100_000))))
    parts = light.where("size > 0").withColumn("slice", F.shiftright(F.col("place.h"), 64 - bits))
    held = parts.groupBy("key", "slice").agg(F.sum("size").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.withColumn("before", before).join(sources.select("key", "target", F.col("size").alias("source_size")), "key").select("key", "slice", "before", "target", "source_size")
    running = F.sum("size").over(Window.partitionBy("key", "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    done = parts.withColumn("running", running).join(offsets, ["key", "slice"]).withColumn("round", F.explode(F.array(*map(F.lit, range(repeats)))))
    finish = (F.col("before") + F.col("running") + F.col("round") * F.col("source_size")) / F.col("target")
    #: From this time on the sources that aren't full have served the budget, whatever document each has in hand.
    last = 1.0 + (most or 0) / free + 1e-9 if free else float("inf")
    items = done.withColumn("finish", finish).where(F.col("finish") <= last).withColumn("band", F.floor(F.least(F.col("finish"), F.lit(float(1 << 20))) * SLICES))
    items = materialize(items.select("key", "round", "place", "size", "finish", "band"), "finish")
    bands = items.groupBy("band").agg(F.sum("size").alias("held"))
    summed = bands.withColumn("upto", F.sum("held").over(Window.orderBy("band")))
    cut = summed.where(F.col("upto") > budget).orderBy("band").select("band", F.col("upto") - F.col("held")).first()
    if cut is None:
        taken = items
    else:
        inside = items.where(F.col("band") == cut[0]).withColumn("upto", F.sum("size").over(Window.orderBy("finish", "key", "round", "place").rowsBetween(Window.unboundedPreceding, 0)))
        taken = items.where(F.col("band") < cut[0]).unionByName(inside.where(F.col("upto") + cut[1] <= budget).drop("upto"))
    points = taken.groupBy("key").agg(F.max(F.struct("round", "place")).alias("end")).select(F.col("key"), F.col("end.round").cast("long").alias("rounds"), F.col("end.place").alias("point"))
    out = sources.join(points, "key", "left").select("key", F.col("size").alias("source_size"), "target", F.coalesce("rounds", F.lit(0)).alias("rounds"), "point")
    return materialize(out, "points")


def prepare(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, source, key, size, place) without texts, and plan() of them."""
    keyed = _keyed(docs, seed)
    light = materialize(keyed.select("doc_id", "source", F.col("__key").alias("key"), F.col("__size").alias("size"), F.col("__place").alias("place")), "light")
    return light, plan(light, weights, repeats)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, points: DataFrame | None = None) -> DataFrame:
    """The mixture's rows with the columns of docs, repeated documents once for each time. points: plan() of docs, if it is there already.

    Null texts and texts without words have size 0 and are never taken; null sources are a source of their own, the last.
    Ties of the shuffle hash are broken by doc_id (null first) and the text's hash. An empty table gives an empty mixture.
    """
    keyed = _keyed(docs, seed)
    if points is None:
        points = prepare(docs, weights, repeats, seed)[1]
    joined = keyed.join(points.withColumnsRenamed({"key": "__key", "rounds": "__rounds", "point": "__point"}).select("__key", "__rounds", "__point"), "__key")
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")  # the same as size 0, without counting again
    times = F.when(empty, 0).otherwise(F.col("__rounds") + F.when(F.col("__place") <= F.col("__point"), 1).otherwise(0))
    return joined.withColumn("__time", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken is counted in the mixture; rows that are equal throughout share what is taken of them, which is as often for each."""
    docs = table(spark, sf_dir, "documents")
    light, points = prepare(docs)
    of = lambda df, n: df.groupBy("key", F.col("place.h").alias("h"), F.col("place.id").alias("id"), F.col("place.th").alias("th")).agg(F.count("*").alias(n))
    mixed = of(_keyed(mix(docs, points=points), SEED).select(F.col("__key").alias("key"), F.col("__place").alias("place")), "copies")
    times = of(light, "rows").join(mixed, ["key", "h", "id", "th"], "left").withColumn("times", F.coalesce(F.col("copies"), F.lit(0)) / F.col("rows"))
    rows = light.select("doc_id", "source", "key", "size", F.col("place.h").alias("h"), F.col("place.id").alias("id"), F.col("place.th").alias("th")).join(times, ["key", "h", "id", "th"])
    return rows.join(points.select("key", "source_size", "target"), "key").select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"), "source")

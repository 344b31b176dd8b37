"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.session import checkpoint_folder, delete_folder

#: Words of the contracts: runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: A key with one in so many of all rows, or more, is joined by broadcast.
HEAVY, SPREAD_ROWS = 1000, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder (in subfolders by an integer column) and read it back: cuts the lineage, survives lost
    executors, is computed once. The folder is the result's stored_at.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(stored: DataFrame, inner: str = "") -> None:
    """Delete what materialize wrote (or a subfolder of it), once nothing reads it any more."""
    delete_folder(stored.sparkSession, f"{stored.stored_at}/{inner}".rstrip("/"))


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """left joined with right, which has a row for each key and in n how often it occurs on the left, of about total rows.

    Keys that hold at least one in HEAVY of them are joined by broadcast, so that their rows stay where they are; there are at most
    about HEAVY such keys. All others are joined by shuffle. Below SPREAD_ROWS rows no key is more than a task can hold, and one
    join does.
    """
    if total < SPREAD_ROWS:
        return left.join(right.drop(n), key)
    heavy = F.broadcast(right.where(F.col(n) * HEAVY >= total).drop(n))
    light = right.where(F.col(n) * HEAVY < total).drop(n)
    return left.join(heavy, key).unionByName(left.join(heavy.select(key), key, "left_anti").join(light, key))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of doc_id's decimal text modulo folds equals fold; a null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def binaries(array: pa.Array) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).to_pylist()


def pieces(texts: list[bytes | None], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about `most` bytes each (or one longer text), so that temporary arrays stay small."""
    return spans([len(t or b"") for t in texts], most)


def spans(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes come to `most` each (or of one larger size)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def binary_descent(n: int, goes_right) -> Column:
    """How many of n sorted splitters lie at or below the row: goes_right(j) says whether splitter j (from 0) does."""
    steps = [1 << k for k in reversed(range(max(1, n).bit_length()))]
    found = F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), found, lambda at, step: F.when((at + step <= n) & goes_right(at + step - 1), at + step).otherwise(at))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the smallest node of the component.

    Alternates large-star and small-star steps (Kiveris et al., 2014). A hub's least neighbour is found by partial aggregation and,
    where the hub has many edges, sent to them: its edges never meet in one task.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    before, total = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = spread_join(both, least, "a", "n", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low, "a", "n", total).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        last, edges = edges, materialize(small.where("a <> b").distinct(), "stars")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").bitwiseAND(0xFFFFFFFF))).first()
        if now == before:
            break
        before, total = now, now[0]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the global position (from 0) of each row in the given order: one range exchange, then offsets of the partitions."""
    n = shuffle_partitions(df.sparkSession)
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)}), "numbered")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def longs(values: list[int]) -> Column:
    """An array literal of longs that stays short in the plan however long the list."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")

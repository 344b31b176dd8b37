"""Weighted row changes (Z-sets) and their application to tables.

A ZSet holds, for each table, a DataFrame of the table's columns with __epoch, __seq (together a total order) and __weight (+1 insert
or upsert, -1 delete). Nothing is consolidated. Applying is a set operation, not a loop: in a table with a key, the last +1 of each key
decides, and its row goes if a later -1 equals it in all columns; without a key, rows are bags whose counts never fall below zero.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.catalog import Catalog, Table

ORDER = ("__epoch", "__seq")
#: Changes of a table without key between two writes of its snapshot.
BAG_CHANGES = 4
#: Copies of a row that are made from one array.
COPIES = 1 << 16


@dataclass
class ZSet:
    parts: dict[str, DataFrame] = field(default_factory=dict)
    low: int = 0
    high: int = 0

    @staticmethod
    def of(table: str, rows: DataFrame, weight: Column | int, seq: Column | int = 0) -> ZSet:
        weight = F.lit(weight) if isinstance(weight, int) else weight
        seq = F.lit(seq) if isinstance(seq, int) else seq
        return ZSet({table: rows.withColumns({"__epoch": F.lit(0), "__seq": seq.cast("long"), "__weight": weight.cast("int")})})

    def extend(self, other: ZSet) -> ZSet:
        """This and then other."""
        shift = self.high + 1 - other.low
        parts = dict(self.parts)
        for name, df in other.parts.items():
            moved = df.withColumn("__epoch", F.col("__epoch") + shift)
            parts[name] = parts[name].unionByName(moved) if name in parts else moved
        return ZSet(parts, self.low, other.high + shift)

    def invert(self, backwards: bool = False) -> ZSet:
        """All weights negated; backwards: also in reverse order, which undoes the changes."""
        turn = {"__weight": -F.col("__weight")} | ({"__epoch": -F.col("__epoch"), "__seq": -F.col("__seq")} if backwards else {})
        return ZSet({n: df.withColumns(turn) for n, df in self.parts.items()}, *((-self.high, -self.low) if backwards else (self.low, self.high)))

    def is_empty(self) -> bool:
        return all(df.where("__weight <> 0").isEmpty() for df in self.parts.values())

    def map(self, f) -> ZSet:
        return ZSet({n: f(df) for n, df in self.parts.items()}, self.low, self.high)


def _same(columns: list[str], other: str) -> Column:
    """Rows of `here` and other that are equal in all columns."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"here.`{c}`").eqNullSafe(F.col(f"{other}.`{c}`"))
    return out


def apply_keyed(base: DataFrame, delta: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """base after the changes: upserts by key; a delete removes the row it equals, if that is the one there."""
    columns = base.columns
    rows = F.struct(*[F.col(f"`{c}`") for c in columns])
    at = F.struct(*ORDER)
    last = delta.where("__weight > 0").groupBy(*key).agg(F.max_by(F.struct(rows.alias("row"), at.alias("at")), at).alias("last")).select("last.row.*", F.col("last.at").alias("__at"))
    none = F.lit(None).cast(last.schema["__at"].dataType)
    kept = base.join(last.select(*key), list(key), "left_anti").select(*columns).withColumn("__at", none)
    gone = delta.where("__weight < 0").select(*columns, at.alias("__gone")).alias("gone")
    after = F.col("__at").isNull() | (F.col("gone.__gone") > F.col("__at"))
    return kept.unionByName(last).alias("here").join(gone, _same(columns, "gone") & after, "left_anti").select(*columns)


def _copies(df: DataFrame, n: str) -> DataFrame:
    """Each row n times, in two steps, so that no array is as long as a large count."""
    blocks = df.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES).cast("long"))))
    return blocks.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col(n) - F.col("__block") * COPIES))))


def apply_bag(base: DataFrame, delta: DataFrame) -> DataFrame:
    """base after the changes in a table without key: +1 appends a copy, -1 removes one if there is any.

    A value's changes are summed by ranges of their order, each with its least running sum, and then over the ranges: a value that
    holds most of the changes is spread over the ranges' tasks.
    """
    columns = base.columns
    names = [F.col(f"`{c}`") for c in columns]
    touched = delta.where("__weight <> 0").select(*columns).distinct().alias("touched")
    start = base.alias("here").join(touched, _same(columns, "touched"), "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias("__sum"))
    step = F.when(F.col("__weight") > 0, 1).otherwise(-1).cast("long")
    steps = delta.where("__weight <> 0").select(*names, *ORDER, step.alias("__step")).repartitionByRange(*ORDER).withColumn("__range", F.spark_partition_id())
    running = F.sum("__step").over(Window.partitionBy(*names, "__range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    ranges = steps.withColumn("__running", running).groupBy(*names, "__range").agg(F.sum("__step").alias("__sum"), F.min("__running").alias("__low"))
    every = start.select(*columns, F.lit(-1).alias("__range"), "__sum", F.lit(0).cast("long").alias("__low")).unionByName(ranges)
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*names).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = every.withColumn("__low", before + F.col("__low")).groupBy(*names).agg((F.sum("__sum") - F.least(F.lit(0), F.min("__low"))).alias("__n"))
    same = base.alias("here").join(touched, _same(columns, "touched"), "left_anti")
    return same.unionByName(_copies(counted.where("__n > 0"), "__n").select(*columns))


def apply_zset(catalog: Catalog, delta: ZSet) -> None:
    """Each table's snapshot becomes the one after the changes."""
    for name, changes in delta.parts.items():
        table: Table = catalog[name]
        if table.key:
            table.changed(apply_keyed(table.rows, changes, table.key))
        else:  # reads the snapshot twice
            table.changed(apply_bag(table.rows, changes), every=BAG_CHANGES)


def replaced_rows(catalog: Catalog, delta: ZSet) -> ZSet:
    """delta with a -1 for each row of the snapshot that a +1 of it replaces, ahead of all else (upserts alone don't tell)."""
    parts = {}
    for name, changes in delta.parts.items():
        table = catalog[name]
        if table.key:
            news = changes.where("__weight > 0").select(*table.key).distinct()
            parts[name] = table.rows.join(news, list(table.key), "left_semi").select(*table.rows.columns).withColumns({"__epoch": F.lit(0), "__seq": F.lit(0).cast("long"), "__weight": F.lit(-1)})
    return ZSet(parts).extend(delta)


def weight_sums(delta: DataFrame, *by: str) -> DataFrame:
    """Net weight for each group; groups that cancel to zero go."""
    return delta.groupBy(*by).agg(F.sum("__weight").alias("weight")).where("weight <> 0")


def write_changes(delta: ZSet, folder: str) -> None:
    """The changes as Parquet, one folder a table."""
    for name, df in delta.parts.items():
        df.write.mode("append").parquet(f"{folder}/{name}")


def read_changes(catalog: Catalog, folder: str, *names: str) -> ZSet:
    out = ZSet({n: catalog.spark.read.parquet(f"{folder}/{n}") for n in names})
    ends = [df.agg(F.min("__epoch"), F.max("__epoch")).first() for df in out.parts.values()]
    out.low, out.high = min((r[0] or 0 for r in ends), default=0), max((r[1] or 0 for r in ends), default=0)
    return out

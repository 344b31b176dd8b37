"""Tables: schemas, keys, snapshots, and ways to load and hand out rows."""

from __future__ import annotations

import dataclasses
import re
import types
import typing
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.plans.dialect import ColumnDef, CreateTable, DialectError, Index
from brindle.session import settled
from brindle.trace import Trace

_SPARK = {"I64": T.LongType(), "STRING": T.StringType(), "UUID": T.StringType()}
#: Changes of a table between two writes of its snapshot.
CHANGES = 16
UUID_PATTERN = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


class ConstraintError(ValueError):
    """Rows break a table's schema or key."""


@dataclass
class Table:
    """A schema and the current rows. domains: I64, STRING, UUID, or NUM, TIME and OTHER for Spark types beyond the dialect's."""

    name: str
    schema: T.StructType
    domains: dict[str, str]
    key: tuple[str, ...]
    rows: DataFrame
    indexes: tuple[Index, ...] = ()
    changes: int = 0  # since the snapshot was last written

    def changed(self, rows: DataFrame, every: int | None = None) -> None:
        """A new snapshot. After CHANGES of them it is written, as plans grow with each change."""
        self.rows, self.changes = rows, self.changes + 1
        if self.changes >= (every or CHANGES):
            self.rows, self.changes = settled(self.laid_out(rows)), 0

    def laid_out(self, rows: DataFrame) -> DataFrame:
        """rows by ranges of the first sorted index, or else the key: a lookup of a prefix then reads the files and row groups it falls in."""
        columns = next((i.columns for i in self.indexes if i.kind == "BTREE"), self.key)
        by = [F.col(f"`{c}`") for c in columns]
        return rows.repartitionByRange(*by).sortWithinPartitions(*by) if by else rows


def domain_of(kind: T.DataType) -> str:
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "I64"
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "NUM"
    if isinstance(kind, T.StringType):
        return "STRING"
    return "TIME" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "OTHER"


class Catalog:
    """Names are case-sensitive and flat. Snapshots are DataFrames; a change replaces the snapshot."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.unread: dict[str, Callable[[], Table]] = {}  # tables whose files are looked at when first used
        self.trace: Trace | None = None

    def __getitem__(self, name: str) -> Table:
        if name in self.unread:
            self.unread.pop(name)()
        if name not in self.tables:
            raise DialectError(f"unknown table {name}")
        return self.tables[name]

    def copy(self) -> Catalog:
        out = Catalog(self.spark)
        out.tables = {k: dataclasses.replace(self[k]) for k in [*self.tables, *self.unread]}
        return out

    def replace_tables(self, other: Catalog) -> None:
        self.tables, self.unread = other.copy().tables, {}

    # -- declaring
    def create(self, made: CreateTable) -> Table:
        names = [c.name for c in made.columns]
        if made.name in self.tables or made.name in self.unread:
            raise DialectError(f"table {made.name} exists")
        if len(set(names)) < len(names):
            raise DialectError(f"table {made.name} has a column twice")
        for c in (*made.key, *(c for i in made.indexes for c in i.columns)):
            if c not in names:
                raise DialectError(f"table {made.name} has no column {c}")
        if loose := [c.name for c in made.columns if c.name in made.key and c.nullable]:
            raise DialectError(f"key column {loose[0]} can be null")
        schema = T.StructType([T.StructField(c.name, _SPARK[c.domain], c.nullable) for c in made.columns])
        return self._add(Table(made.name, schema, {c.name: c.domain for c in made.columns}, made.key, self.spark.createDataFrame([], schema), made.indexes))

    def register(self, row: type, table: str | None = None, key: str | None = None) -> Table:
        """A dataclass as a table: int, str and uuid.UUID fields, `| None` for nullable ones; key: by default the first field."""
        hints = typing.get_type_hints(row)
        columns = []
        for f in dataclasses.fields(row):
            parts = [p for p in typing.get_args(hints[f.name]) if p is not types.NoneType] if typing.get_args(hints[f.name]) else [hints[f.name]]
            domain = {int: "I64", str: "STRING", uuid.UUID: "UUID"}.get(parts[0])
            if domain is None or len(parts) != 1:
                raise DialectError(f"{row.__name__}.{f.name}: int, str or uuid.UUID, or one of them | None")
            columns.append(ColumnDef(f.name, domain, types.NoneType in typing.get_args(hints[f.name])))
        name = table or re.sub(r"(?<!^)(?=[A-Z])", "_", row.__name__).lower()
        return self.create(CreateTable(name, tuple(columns), (key or columns[0].name,)))

    def attach(self, name: str, rows: DataFrame, key: tuple[str, ...] = (), uuids: tuple[str, ...] = ()) -> Table:
        """A DataFrame as a table, with its own Spark types; uuids: string columns that hold UUIDs."""
        domains = {f.name: "UUID" if f.name in uuids else domain_of(f.dataType) for f in rows.schema}
        return self._add(Table(name, rows.schema, domains, tuple(key), rows))

    def attach_parquet(self, folder: str, *names: str, keys: dict[str, tuple[str, ...]] | None = None) -> Catalog:
        for name in names:
            self.unread[name] = lambda name=name: self.attach(name, self.spark.read.parquet(f"{folder}/{name}.parquet"), (keys or {}).get(name, ()))
        return self

    def _add(self, table: Table) -> Table:
        self.tables[table.name] = table
        return table

    # -- rows in
    def typed(self, name: str, rows: list[dict]) -> DataFrame:
        """Python rows as a DataFrame of the table; values are checked against the domains, nothing is kept if one fails."""
        table = self[name]
        made = []
        for row in rows:
            if unknown := set(row) - set(table.domains):
                raise ConstraintError(f"{name} has no column {sorted(unknown)[0]}")
            made.append(tuple(check(table, f, row.get(f.name)) for f in table.schema))
        return self.spark.createDataFrame(made, table.schema)

    def checked(self, name: str, rows: DataFrame, unique: bool = True) -> DataFrame:
        """rows if they meet the table's schema (nulls, UUID form) and, if unique, its key with the snapshot's rows; else ConstraintError."""
        table = self[name]
        bad = F.lit(False)
        for f in table.schema:
            if not f.nullable:
                bad = bad | F.col(f.name).isNull()
            if table.domains[f.name] == "UUID":
                bad = bad | (F.col(f.name).isNotNull() & ~F.col(f.name).rlike(UUID_PATTERN))
        if not rows.where(bad).isEmpty():
            raise ConstraintError(f"{name}: null or malformed values")
        if unique and table.key:
            keys = list(table.key)
            if not rows.groupBy(*keys).count().where("count > 1").isEmpty() or not rows.select(*keys).join(table.rows.select(*keys), keys, "left_semi").isEmpty():
                raise ConstraintError(f"{name}: a key occurs twice")
        return rows


def check(table: Table, f: T.StructField, value):
    domain = table.domains[f.name]
    if value is None:
        if not f.nullable:
            raise ConstraintError(f"{table.name}.{f.name} can't be null")
        return None
    if isinstance(value, bool):
        value = int(value)
    good = {"I64": int, "STRING": str, "UUID": uuid.UUID, "NUM": (int, float)}.get(domain, object)
    if not isinstance(value, good):
        raise ConstraintError(f"{table.name}.{f.name}: {value!r} isn't of {domain}")
    if domain == "UUID":
        return str(value)
    return float(value) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else value


# -- rows out
def read_rows(df: DataFrame, row: type) -> list:
    """Typed rows, by position; for results of a size that the caller bounds."""
    fields = dataclasses.fields(row)
    if len(fields) != len(df.columns):
        raise DialectError(f"{row.__name__} has {len(fields)} fields, the result {len(df.columns)} columns")
    return [row(*r) for r in df.collect()]


def read_row(df: DataFrame, row: type):
    found = read_rows(df.limit(2), row)
    if len(found) != 1:
        raise DialectError(f"expected one row, found {'none' if not found else 'more'}")
    return found[0]


def read_column(df: DataFrame, kind: type) -> list:
    """The single column of a result as int, str or uuid.UUID values."""
    if len(df.columns) != 1:
        raise DialectError("the result has more than one column")
    return [None if r[0] is None else kind(r[0]) for r in df.collect()]


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON string (column `row`); read back with from_json_rows."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))


def from_json_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(F.from_json("row", schema).alias("r")).select("r.*")


class Fetchers:
    """Named parameterised sources: fetch(name, **params) gives rows."""

    def __init__(self):
        self.known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str):
        def put(f):
            if name in self.known:
                raise DialectError(f"fetcher {name} exists")
            self.known[name] = f
            return f

        return put

    def fetch(self, name: str, *args, **params) -> DataFrame:
        if name not in self.known:
            raise DialectError(f"unknown fetcher {name}")
        return self.known[name](*args, **params)


def equals_if_given(column: str, value) -> Column:
    return F.lit(True) if value is None else F.col(column) == value


def at_least(column: str, value) -> Column:
    return F.lit(True) if value is None else F.col(column) >= value


def equals_or_null(column: str, value) -> Column:
    """Null-safe equality: a null value finds the null rows."""
    return F.col(column).eqNullSafe(F.lit(value))


def contains(column: str, part: str) -> Column:
    return F.col(column).contains(part)

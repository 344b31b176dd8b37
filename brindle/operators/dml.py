"""INSERT, UPDATE, DELETE and CREATE TABLE on a catalog; each change returns its Z-set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.delta import ZSet
from brindle.plans.dialect import CreateTable, Delete, DialectError, Insert, Lit, Param, Select, Update, parse, parse_script
from brindle.plans.lower import Lowering, Scope, literal, query, scalar
from brindle.sources.catalog import Catalog, ConstraintError, check


@dataclass
class Mutation:
    changes: ZSet


@dataclass
class Rows:
    df: DataFrame


@dataclass
class Ddl:
    table: str


def _value(e, params: dict | None):
    if not isinstance(e, (Lit, Param)):
        raise DialectError("values are literals or parameters")
    return scalar(e, params or {})


def insert(catalog: Catalog, s: Insert, params: dict | None = None, strict: bool = True) -> ZSet:
    """strict: keys must be unique; otherwise rows are only appended."""
    table = catalog[s.table]
    names = s.columns or tuple(table.domains)
    if bad := [r for r in s.rows if len(r) != len(names)]:
        raise ConstraintError(f"{s.table}: {len(names)} columns, {len(bad[0])} values")
    rows = catalog.checked(s.table, catalog.typed(s.table, [dict(zip(names, (_value(e, params) for e in r), strict=True)) for r in s.rows]), strict)
    table.changed(table.rows.unionByName(rows))
    return ZSet.of(s.table, rows, 1)


def append(catalog: Catalog, table: str, rows: DataFrame, strict: bool = True) -> ZSet:
    """A DataFrame's rows, like INSERT."""
    rows = catalog.checked(table, rows.select(*catalog[table].domains), strict)
    catalog[table].changed(catalog[table].rows.unionByName(rows))
    return ZSet.of(table, rows, 1)


def _judged(catalog: Catalog, name: str, where, params) -> tuple[DataFrame, Column]:
    """The table's rows, each once, and whether a row meets where (never null). One pass serves both halves, so plans grow by a step a change."""
    rows = catalog[name].rows
    if where is None:
        return rows, F.lit(True)
    marked, meets, _ = Lowering(catalog, params).marked(rows, where, Scope([(name, catalog[name], "")]))
    return marked, F.coalesce(meets, F.lit(False))


def delete(catalog: Catalog, s: Delete, params: dict | None = None) -> ZSet:
    table = catalog[s.table]
    rows, meets = _judged(catalog, s.table, s.where, params)
    columns = [F.col(f"`{c}`") for c in table.domains]
    table.changed(rows.where(~meets).select(*columns))
    return ZSet.of(s.table, rows.where(meets).select(*columns), -1)


def update(catalog: Catalog, s: Update, params: dict | None = None, strict: bool = True) -> ZSet:
    """A -1 of the old and a +1 of the new row for each match, also where nothing changes. strict: changed keys must stay unique."""
    table = catalog[s.table]
    sets = {}
    for name, e in s.sets:
        if name not in table.domains:
            raise DialectError(f"{s.table} has no column {name}")
        sets[name] = literal(check(table, table.schema[name], _value(e, params))).cast(table.schema[name].dataType)
    rows, meets = _judged(catalog, s.table, s.where, params)
    hit = rows.where(meets)
    old = hit.select(*[F.col(f"`{c}`") for c in table.domains])
    new = hit.select(*[sets.get(c, F.col(f"`{c}`")).alias(c) for c in table.domains])
    after = rows.select(*[(F.when(meets, sets[c]).otherwise(F.col(f"`{c}`")) if c in sets else F.col(f"`{c}`")).alias(c) for c in table.domains])
    if strict and set(table.key) & set(sets) and not after.groupBy(*[F.col(f"`{c}`") for c in table.key]).count().where("count > 1").isEmpty():
        raise ConstraintError(f"{s.table}: a key would occur twice")
    table.changed(after)
    weighted = lambda df, seq, weight: df.withColumns({"__epoch": F.lit(0), "__seq": F.lit(seq).cast("long"), "__weight": F.lit(weight)})
    return ZSet({s.table: weighted(old, 0, -1).unionByName(weighted(new, 1, 1))})


def run_tree(catalog: Catalog, tree, params: dict | None = None, **options) -> Mutation | Rows | Ddl:
    if isinstance(tree, Select):
        return Rows(query(catalog, tree, params, **options))
    if isinstance(tree, CreateTable):
        return Ddl(catalog.create(tree).name)
    made = {Insert: insert, Update: update, Delete: delete}[type(tree)]
    return Mutation(made(catalog, tree, params))


def execute(catalog: Catalog, sql: str, params: dict | None = None, **options) -> Mutation | Rows | Ddl:
    return run_tree(catalog, parse(sql), params, **options)


def execute_all(catalog: Catalog, script: str) -> None:
    """Statements one after another; what ran before a failing one stays."""
    for tree in parse_script(script):
        run_tree(catalog, tree)

"""From the syntax tree to DataFrames; Catalyst plans everything after that.

semantics="ansi" is the default. semantics="reference" changes four results: a global aggregate over no rows gives no row, predicates
on the right table of a left join act like ON, a scalar subquery without rows is an error, and float literals are truncated.
In both, NULL is the largest value in ORDER BY and a comparison of unlike types matches nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.plans.dialect import Agg, BindError, Bool, Cmp, Col, DialectError, In, IsNull, Lit, Param, Reactive, Select, Sub, parse, walk
from brindle.sources.catalog import Catalog, Table

_OPS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
_CLASS = {"I64": "number", "NUM": "number", "STRING": "string", "UUID": "uuid", "TIME": "time", "NULL": "null", "OTHER": "other"}


def comparable(a: str, b: str) -> bool:
    """Whether values of two domains can be equal: those of one class, and text with a time."""
    one, two = _CLASS[a], _CLASS[b]
    return one != "null" and (one == two or {one, two} == {"time", "string"})


class AnalysisError(DialectError):
    """The statement names or combines things that don't fit."""


def bound(value, params: dict):
    """A literal's or parameter's Python value; a list only where a list is allowed."""
    if isinstance(value, Param):
        if value.name not in params:
            raise BindError(f"parameter :{value.name} is missing")
        return params[value.name]
    if isinstance(value, Lit):
        return value.value
    raise AnalysisError("a literal or a parameter is needed here")


def scalar(value, params: dict):
    found = bound(value, params)
    if isinstance(found, (list, tuple)):
        raise BindError("a list where one value is needed")
    return found


def literal_domain(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (bool, int)):
        return "I64"
    return {float: "NUM", str: "STRING", uuid.UUID: "UUID"}.get(type(v), "OTHER")


def literal(v) -> Column:
    return F.lit(int(v) if isinstance(v, bool) else str(v) if isinstance(v, uuid.UUID) else v)


def timed(c: Column, domain: str, other: str) -> Column:
    """Text that is compared with a time, as a time (null where it is none); all else as it is."""
    return c.try_cast("timestamp") if domain == "STRING" and other == "TIME" else c


def host_params(params: dict) -> dict:
    """Parameters as a text host sends them: whole numbers only, and UUID-shaped strings become UUIDs."""

    def one(v):
        if isinstance(v, float):
            if not v.is_integer():
                raise BindError(f"{v} isn't a whole number")
            return int(v)
        if isinstance(v, str):
            try:
                return uuid.UUID(v) if len(v) == 36 else v
            except ValueError:
                return v
        return [one(x) for x in v] if isinstance(v, list) else v

    return {k: one(v) for k, v in params.items()}


@dataclass
class Scope:
    """The sources of a SELECT: alias, table, and the DataFrame's names for its columns."""

    sources: list[tuple[str, Table, str]] = field(default_factory=list)

    def resolve(self, c: Col) -> tuple[int, str, str]:
        """(source, the DataFrame's column name, domain)."""
        found = [(i, f"{prefix}{c.name}", t.domains[c.name]) for i, (alias, t, prefix) in enumerate(self.sources) if c.table in (None, alias) and c.name in t.domains]
        if not found:
            raise AnalysisError(f"unknown column {c.table + '.' if c.table else ''}{c.name}")
        if len(found) > 1:
            raise AnalysisError(f"column {c.name} is ambiguous")
        return found[0]


def conjuncts(e) -> list:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, Bool) and e.op == "AND" else [] if e is None else conjuncts(e.item) if isinstance(e, Reactive) and isinstance(e.item, Bool) and e.item.op == "AND" else [e]


class Lowering:
    def __init__(self, catalog: Catalog, params: dict | None = None, semantics: str = "ansi", triggered: frozenset[int] = frozenset()):
        if semantics not in ("ansi", "reference"):
            raise ValueError(semantics)
        self.catalog, self.params, self.reference, self.triggered = catalog, params or {}, semantics == "reference", triggered

    # -- predicates
    def operand(self, e, scope: Scope) -> tuple[Column, str]:
        if isinstance(e, Col):
            _, name, domain = scope.resolve(e)
            return F.col(f"`{name}`"), domain
        if isinstance(e, (Lit, Param)):
            v = scalar(e, self.params)
            if self.reference and isinstance(v, float):
                v = int(v)
            return literal(v), literal_domain(v)
        if isinstance(e, Sub):
            sub = self.select(e.select)
            if len(sub.df.columns) != 1:
                raise AnalysisError("a scalar subquery has one column")
            if self.reference and sub.df.isEmpty():
                raise AnalysisError("the scalar subquery has no row")
            return sub.df.scalar(), sub.domains[0]
        raise AnalysisError(f"{type(e).__name__} can't be compared")

    def compare(self, op: str, a: tuple[Column, str], b: tuple[Column, str]) -> Column:
        if not comparable(a[1], b[1]):
            return F.lit(False)
        return getattr(timed(*a, b[1]), _OPS[op])(timed(*b, a[1]))

    def among(self, e: In) -> list:
        if len(e.among) == 1 and isinstance(e.among[0], Param):
            v = bound(e.among[0], self.params)
            return list(v) if isinstance(v, (list, tuple)) else [v]
        return [scalar(x, self.params) for x in e.among]

    def predicate(self, e, scope: Scope, marks: dict) -> Column:
        if isinstance(e, Bool):
            a, b = self.predicate(e.left, scope, marks), self.predicate(e.right, scope, marks)
            return a & b if e.op == "AND" else a | b
        if isinstance(e, Reactive):
            return self.predicate(e.item, scope, marks)
        if isinstance(e, Cmp):
            return self.compare(e.op, self.operand(e.left, scope), self.operand(e.right, scope))
        if isinstance(e, IsNull):
            c = self.operand(e.item, scope)[0]
            return c.isNotNull() if e.negated else c.isNull()
        if isinstance(e, In):
            if isinstance(e.among, Sub):
                return F.coalesce(F.col(marks[e]), F.lit(False))
            column, domain = self.operand(e.item, scope)
            good = [timed(literal(v), literal_domain(v), domain) for v in self.among(e) if comparable(literal_domain(v), domain)]
            return column.isin(good) if good else F.lit(False)
        if isinstance(e, Lit) and isinstance(e.value, bool):
            return F.lit(e.value)
        raise AnalysisError(f"{type(e).__name__} is no predicate")

    def filter(self, df: DataFrame, e, scope: Scope) -> DataFrame:
        """IN subqueries of the conjunction are semi joins; others (under OR) become marks by a left join."""
        rest = []
        for c in conjuncts(e):
            bare = c.item if isinstance(c, Reactive) else c
            if isinstance(bare, In) and isinstance(bare.among, Sub):
                df = self._semi(df, bare, scope)
            else:
                rest.append(c)
        for c in rest:
            marked, meets, made = self.marked(df, c, scope)
            df = marked.where(meets).drop(*made)
        return df

    def marked(self, df: DataFrame, e, scope: Scope) -> tuple[DataFrame, Column, list[str]]:
        """df with a mark column for each IN subquery of e, the predicate over it, and the marks' names. No row is lost or repeated."""
        marks: dict = {}
        for node in (n for n in walk(e) if isinstance(n, In) and isinstance(n.among, Sub)):
            item, sub = self._sub(node, scope)
            marks[node] = f"__mark{len(marks)}"
            values = sub.withColumnRenamed(sub.columns[0], "__v").where("__v is not null").distinct().withColumn(marks[node], F.lit(True))
            df = df.join(values, item == F.col("__v"), "left").drop("__v")
        return df, self.predicate(e, scope, marks), list(marks.values())

    def _sub(self, e: In, scope: Scope) -> tuple[Column, DataFrame]:
        sub = self.select(e.among.select)
        if len(sub.df.columns) != 1:
            raise AnalysisError("the subquery of IN has one column")
        item, domain = self.operand(e.item, scope)
        value = F.col(f"`{sub.df.columns[0]}`")
        if not comparable(domain, sub.domains[0]):  # nothing is equal
            return item.cast("string"), sub.df.limit(0).select(value.cast("string").alias("v"))
        return timed(item, domain, sub.domains[0]), sub.df.select(timed(value, sub.domains[0], domain).alias("v"))

    def _semi(self, df: DataFrame, e: In, scope: Scope) -> DataFrame:
        item, sub = self._sub(e, scope)
        values = sub.select(F.col("v").alias("__v"))
        return df.join(values, item == F.col("__v"), "left_semi")

    # -- SELECT
    def scan(self, scope: Scope, source) -> DataFrame:
        table = self.catalog[source.table]
        if any(alias == source.alias for alias, *_ in scope.sources):
            raise AnalysisError(f"{source.alias} occurs twice in FROM; use AS")
        prefix = f"s{len(scope.sources)}__"
        scope.sources.append((source.alias, table, prefix))
        return table.rows.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in table.domains])

    def select(self, s: Select) -> Lowered:
        scope = Scope()
        df = self.scan(scope, s.source)
        rights = []
        for j in s.joins:
            rights.append(self.scan(scope, j.source))
        wheres = conjuncts(s.where)
        seen = Scope([scope.sources[0]])
        for k, (j, right) in enumerate(zip(s.joins, rights, strict=True)):
            seen.sources.append(scope.sources[k + 1])
            if j.kind == "left" and self.reference:
                own = [c for c in wheres if {scope.resolve(n)[0] for n in walk(c) if isinstance(n, Col)} == {k + 1}]
                wheres = [c for c in wheres if c not in own]
                for c in own:
                    right = self.filter(right, c, scope)
            if any(isinstance(n, In) and isinstance(n.among, Sub) for n in walk(j.on)):
                raise AnalysisError("no subquery list in ON")
            df = df.join(right, self.predicate(j.on, seen, {}), j.kind)
        for c in wheres:
            df = self.filter(df, c, scope)
        if s.group or any(isinstance(e, Agg) for e, _ in s.items):
            out = self._aggregate(df, s, scope)
        else:
            out = self._project(df, s, scope)
        return out

    def _names(self, s: Select) -> list[str]:
        out: list[str] = []
        for e, alias in s.items:
            name = alias or (e.name if isinstance(e, Col) else f"{e.fn.lower()}_{e.item.name}" if isinstance(e, Agg) and isinstance(e.item, Col) else "reactive" if isinstance(e, Reactive) else "value")
            n, made = 1, name
            while made in out:
                n += 1
                made = f"{name}_{n}"
            out.append(made)
        return out

    def _flag(self, s: Select, e) -> Column:
        at = [x for x, _ in s.items if isinstance(x, Reactive)].index(e)
        return F.lit(1 if at in self.triggered else 0).cast("long")

    def _limit(self, df: DataFrame, s: Select) -> DataFrame:
        if s.limit is None:
            return df
        n = bound(s.limit, self.params)
        if isinstance(n, bool) or not isinstance(n, int):
            raise BindError("LIMIT needs a whole number")
        return df.limit(n)

    @staticmethod
    def _sorted(df: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
        return df.orderBy(*[c.desc_nulls_first() if down else c.asc_nulls_last() for c, down in keys]) if keys else df

    def _project(self, df: DataFrame, s: Select, scope: Scope) -> Lowered:
        names, columns, domains = self._names(s), [], []
        for e, _ in s.items:
            if isinstance(e, Reactive):
                columns.append(self._flag(s, e))
                domains.append("I64")
            elif isinstance(e, (Col, Lit, Param)):
                c, d = self.operand(e, scope)
                columns.append(c)
                domains.append(d)
            else:
                raise AnalysisError(f"{type(e).__name__} can't be selected")
        keys = []
        for e, down in s.order:
            if not isinstance(e, Col):
                raise AnalysisError("ORDER BY takes columns")
            aliased = [c for (_, alias), c in zip(s.items, columns, strict=True) if alias and e.table is None and alias == e.name]
            keys.append((aliased[0] if aliased else self.operand(e, scope)[0], down))
        df = self._limit(self._sorted(df, keys), s)
        return Lowered(df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)]), domains)

    def _aggregate(self, df: DataFrame, s: Select, scope: Scope) -> Lowered:
        names, group = self._names(s), []
        for e in s.group:
            if not isinstance(e, Col):
                raise AnalysisError("GROUP BY takes columns")
            group.append(scope.resolve(e))
        made, domains, place = [], [], []
        for k, (e, _) in enumerate(s.items):
            if isinstance(e, Agg):
                if not isinstance(e.item, Col):
                    raise AnalysisError("an aggregate takes a column")
                _, name, domain = scope.resolve(e.item)
                if e.fn == "SUM" and _CLASS[domain] != "number":
                    made.append(F.lit(None).cast("long").alias(f"__a{k}"))
                    made[-1] = F.max(F.lit(None).cast("long")).alias(f"__a{k}")
                else:
                    made.append({"COUNT": F.count, "SUM": F.sum, "MIN": F.min, "MAX": F.max}[e.fn](F.col(f"`{name}`")).alias(f"__a{k}"))
                domains.append("I64" if e.fn == "COUNT" else domain)
                place.append(F.col(f"__a{k}"))
            elif isinstance(e, Col):
                found = scope.resolve(e)
                if found not in group:
                    raise AnalysisError(f"column {e.name} is neither grouped nor aggregated")
                domains.append(found[2])
                place.append(F.col(f"`{found[1]}`"))
            elif isinstance(e, Reactive):
                domains.append("I64")
                place.append(self._flag(s, e))
            else:
                raise AnalysisError(f"{type(e).__name__} can't be selected")
        keys = [F.col(f"`{name}`") for _, name, _ in dict.fromkeys(group)]
        if not made:
            out = df.select(*keys).distinct()
        elif keys:
            out = df.groupBy(*keys).agg(*made)
        else:
            out = df.agg(*made, F.count(F.lit(1)).alias("__rows"))
            if self.reference:
                out = out.where("__rows > 0")
        order = []
        for e, down in s.order:
            if not isinstance(e, Col):
                raise AnalysisError("ORDER BY takes columns")
            aliased = [c for (_, alias), c in zip(s.items, place, strict=True) if alias and e.table is None and alias == e.name]
            if not aliased and scope.resolve(e) not in group:
                raise AnalysisError(f"ORDER BY {e.name}: neither grouped nor a result's name")
            order.append((aliased[0] if aliased else F.col(f"`{scope.resolve(e)[1]}`"), down))
        out = self._limit(self._sorted(out, order), s)
        return Lowered(out.select(*[c.alias(n) for c, n in zip(place, names, strict=True)]), domains)


@dataclass
class Lowered:
    df: DataFrame
    domains: list[str]


def query(catalog: Catalog, sql: str | Select, params: dict | None = None, semantics: str = "ansi", triggered=frozenset()) -> DataFrame:
    """The result of a SELECT. triggered: the REACTIVE items that caused this run."""
    tree = parse(sql) if isinstance(sql, str) else sql
    if not isinstance(tree, Select):
        raise DialectError("query() takes a SELECT")
    lowering = Lowering(catalog, params, semantics, frozenset(triggered))
    if catalog.trace is None:
        return lowering.select(tree).df
    from brindle.plans.explain import plan_text  # it imports this module

    with catalog.trace.query(sql if isinstance(sql, str) else "prepared", plan=plan_text(catalog, tree)):  # the time is that of planning; Spark runs it later
        return lowering.select(tree).df


class Prepared:
    """A parsed SELECT that runs with different parameters."""

    def __init__(self, sql: str):
        self.tree = parse(sql)

    def run(self, catalog: Catalog, params: dict | None = None, **options) -> DataFrame:
        return query(catalog, self.tree, params, **options)

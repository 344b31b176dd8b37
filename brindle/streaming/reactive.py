"""Which subscriptions does a batch of row changes wake, and which of their conditions fired?

REACTIVE(column) fires on any change of the column's table, REACTIVE(predicate) on changed rows that meet the predicate. The branches
of an OR are looked up each for itself. A branch with equalities and INs in its AND chain gets composite lookup keys. Branches that
differ only in constants share a template: its subscriptions are rows (sub_id, cond, keys k*, constants v*), and a batch of changes is
joined once for each template, by the keys where there are any, and the full predicate is verified after the join. A single comparison
of a column with a constant needs no join: the least and the largest changed value decide it. Many subscriptions cost rows, not joins.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.delta import ZSet
from brindle.plans.dialect import Agg, Bool, Cmp, Col, DialectError, In, IsNull, Lit, Param, Reactive, Select, Sub, parse, walk
from brindle.plans.lower import _OPS, AnalysisError, Scope, bound, comparable, literal_domain, query, scalar, timed
from brindle.sources.catalog import Catalog
from brindle.trace import Trace

#: Key tables up to so many rows are sent to all executors; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Condition:
    index: int
    table: str
    predicate: object | None  # None: any change of the table


def or_to_in(e):
    """OR of equalities and INs on one column as one IN."""
    if not isinstance(e, Bool):
        return e
    a, b = or_to_in(e.left), or_to_in(e.right)
    if e.op == "OR" and (x := _values(a)) and (y := _values(b)) and x[0] == y[0]:
        return In(x[0], x[1] + y[1])
    return Bool(e.op, a, b)


def branches(e) -> list:
    """A predicate's alternatives: it holds where one of them does."""
    return branches(e.left) + branches(e.right) if isinstance(e, Bool) and e.op == "OR" else [e]


def _values(e):
    if isinstance(e, Cmp) and e.op == "=":
        for c, v in ((e.left, e.right), (e.right, e.left)):
            if isinstance(c, Col) and isinstance(v, (Lit, Param)):
                return c, (v,)
    if isinstance(e, In) and isinstance(e.item, Col) and isinstance(e.among, tuple):
        return e.item, e.among
    return None


def _reactives(e) -> Iterator[Reactive]:
    if isinstance(e, Reactive):
        yield e
    elif isinstance(e, (Bool, Cmp)):
        yield from _reactives(e.left)
        yield from _reactives(e.right)


def conditions(catalog: Catalog, s: Select) -> list[Condition]:
    """All REACTIVE conditions: the select items' first, then WHERE's, in order."""
    scope = Scope([(src.alias, catalog[src.table], "") for src in (s.source, *(j.source for j in s.joins))])
    out = []
    for r in [x for e, _ in s.items for x in _reactives(e)] + list(_reactives(s.where)):
        nodes = list(walk(r.item))
        if any(isinstance(n, Sub) or isinstance(n, In) and isinstance(n.among, Sub) for n in nodes):
            raise AnalysisError("REACTIVE takes no subquery")
        if any(isinstance(n, (Agg, Reactive)) for n in nodes):
            raise AnalysisError("REACTIVE takes a column or a predicate")
        columns = [n for n in nodes if isinstance(n, Col)]
        if not columns:
            raise AnalysisError("REACTIVE names no column")
        places = {scope.resolve(c)[0] for c in columns}
        if len(places) > 1:
            raise AnalysisError("REACTIVE names columns of one table only")
        table = scope.sources[places.pop()][1].name
        out.append(Condition(len(out), table, None if isinstance(r.item, Col) else or_to_in(r.item)))
    return out


@dataclass
class Template:
    """A predicate whose constants are slots; rows: (sub_id, cond, *keys, *constants)."""

    table: str
    shape: object
    key_columns: tuple[str, ...]
    key_types: tuple[str, ...]
    slot_types: tuple[str, ...]
    rows: dict[tuple[int, int], list[tuple]] = field(default_factory=dict)
    frame: DataFrame | None = None

    def subscriptions(self, catalog: Catalog) -> DataFrame:
        if self.frame is None:
            types = {"I64": T.LongType(), "NUM": T.DoubleType()}
            kind = lambda d: T.ArrayType(kind(d[1:])) if d[0] == "*" else types.get(d, T.StringType())
            fields = [("sub_id", T.LongType()), ("cond", T.IntegerType()), *((f"__k{i}", kind(d)) for i, d in enumerate(self.key_types)), *((f"__v{i}", kind(d)) for i, d in enumerate(self.slot_types))]
            self.frame = catalog.spark.createDataFrame([r for rows in self.rows.values() for r in rows], T.StructType([T.StructField(n, t) for n, t in fields]))
        return self.frame


def _plain(v):
    return int(v) if isinstance(v, bool) else v if v is None or isinstance(v, (int, float)) else str(v)


def _shape(e, table, params: dict, slots: list):
    """The predicate as a hashable tree with ("slot", n, domain) for constants; None for what never matches."""
    if isinstance(e, Bool):
        a, b = _shape(e.left, table, params, slots), _shape(e.right, table, params, slots)
        return ("bool", e.op, a, b)
    side = lambda x: ("col", x.name, table.domains[x.name]) if isinstance(x, Col) else _slot(x)

    def _slot(x):
        v = scalar(x, params)
        slots.append((literal_domain(v), _plain(v)))
        return ("slot", len(slots) - 1, literal_domain(v))

    if isinstance(e, Cmp):
        return ("cmp", e.op, side(e.left), side(e.right))
    if isinstance(e, IsNull):
        return ("null", e.negated, side(e.item))
    if isinstance(e, In):
        among = _among(e, params)
        domain = table.domains[e.item.name]
        good = [_plain(v) for v in among if comparable(literal_domain(v), domain)]
        slots.append(("*" + ("NUM" if any(isinstance(v, float) for v in good) else "I64" if domain in ("I64", "NUM") else "STRING"), good))
        return ("in", side(e.item), len(slots) - 1)
    if isinstance(e, Lit) and isinstance(e.value, bool):
        return ("const", e.value)
    raise AnalysisError(f"{type(e).__name__} is no predicate")


def _among(e: In, params: dict) -> list:
    if len(e.among) == 1 and isinstance(e.among[0], Param):
        v = bound(e.among[0], params)
        return list(v) if isinstance(v, (list, tuple)) else [v]
    return [scalar(x, params) for x in e.among]


def _verify(shape) -> Column:
    kind = shape[0]
    if kind == "bool":
        a, b = _verify(shape[2]), _verify(shape[3])
        return a & b if shape[1] == "AND" else a | b
    side = lambda s: F.col(f"`{s[1]}`") if s[0] == "col" else F.col(f"__v{s[1]}")
    if kind == "cmp":
        a, b = shape[2], shape[3]
        if not comparable(a[2], b[2]):
            return F.lit(False)
        return F.coalesce(getattr(timed(side(a), a[2], b[2]), _OPS[shape[1]])(timed(side(b), b[2], a[2])), F.lit(False))
    if kind == "null":
        return side(shape[2]).isNotNull() if shape[1] else side(shape[2]).isNull()
    if kind == "in":
        if shape[1][2] == "TIME":
            return F.coalesce(F.array_contains(F.transform(F.col(f"__v{shape[2]}"), lambda v: v.try_cast("timestamp")), side(shape[1]).cast("timestamp")), F.lit(False))
        return F.coalesce(F.array_contains(F.col(f"__v{shape[2]}"), side(shape[1]).cast("double" if shape[1][2] == "NUM" else "long" if shape[1][2] == "I64" else "string")), F.lit(False))
    return F.lit(shape[1])


def _compared(shape) -> str | None:
    """The column where the predicate is one comparison, other than equality, of a column with a constant."""
    if shape[0] == "cmp" and shape[1] != "=" and {shape[2][0], shape[3][0]} == {"col", "slot"}:
        return next(s[1] for s in shape[2:] if s[0] == "col")
    return None


def lookup_keys(predicate, table, params: dict) -> list[tuple[str, list]]:
    """(column, values) for each equality and IN of the AND chain, the first for each column; empty: the table is scanned."""
    out: dict[str, list] = {}
    chain = [predicate]
    while chain:
        e = chain.pop(0)
        if isinstance(e, Bool) and e.op == "AND":
            chain = [e.left, e.right, *chain]
        elif found := _values(e):
            column, among = found
            values = _among(In(column, among), params)
            good = [_plain(v) for v in values if comparable(literal_domain(v), table.domains[column.name])]
            out.setdefault(column.name, list(dict.fromkeys(good)))
    return sorted(out.items())


class Registry:
    """Subscriptions by template. Ids count up; the same SQL text and parameters share one id and are counted."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.templates: dict[tuple, Template] = {}
        self.by_text: dict[tuple, int] = {}
        self.known: dict[int, tuple[tuple, Select, dict, list[tuple]]] = {}
        self.handles: dict[int, int] = {}
        self.holders: Counter = Counter()
        self._next_id = itertools.count(1)
        self._next_handle = itertools.count(1)
        self.dirty: dict[int, set[int]] = {}
        self.wake: Callable[[], None] | None = None
        self.trace: dict[str, int] = {"batches": 0, "templates": 0, "fired": 0}
        self.log = Trace()  # a round's templates and what fired, by condition

    # -- subscribing
    def subscribe(self, sql: str, params: dict | None = None) -> tuple[int, int]:
        """(handle, subscription id)."""
        text = (sql, repr(sorted((params or {}).items(), key=str)))
        handle = next(self._next_handle)
        if text not in self.by_text:
            tree = parse(sql)
            if not isinstance(tree, Select):
                raise DialectError("only a SELECT can be subscribed to")
            found = conditions(self.catalog, tree)
            sub = next(self._next_id)
            used = [(c.index, self._add(sub, c.index, c.table, branch, params or {})) for c in found for branch in branches(c.predicate)]
            self.by_text[text] = sub
            self.known[sub] = (text, tree, params or {}, used)
        self.handles[handle] = self.by_text[text]
        self.holders[self.by_text[text]] += 1
        return handle, self.by_text[text]

    def _add(self, sub: int, index: int, name: str, predicate, params: dict) -> tuple:
        table = self.catalog[name]
        slots: list = []
        shape = ("const", True) if predicate is None else _shape(predicate, table, params, slots)
        keys = [] if predicate is None else lookup_keys(predicate, table, params)
        names = tuple(k for k, _ in keys)
        key_types = tuple("NUM" if any(isinstance(v, float) for v in vs) or table.domains[k] == "NUM" else table.domains[k] if table.domains[k] in ("I64", "TIME") else "STRING" for k, vs in keys)
        slot_types = tuple(d for d, _ in slots)
        which = (name, shape, names, key_types, slot_types)
        template = self.templates.setdefault(which, Template(*which))
        fit = lambda v, d: float(v) if d == "NUM" and v is not None else [float(x) for x in v] if d == "*NUM" else v
        values = tuple(fit(v, d) for (_, v), d in zip(slots, slot_types, strict=True))
        combos = itertools.product(*[[fit(v, t) for v in vs] for (_, vs), t in zip(keys, key_types, strict=True)])
        template.rows.setdefault((sub, index), []).extend((sub, index, *combo, *values) for combo in combos)
        template.frame = None
        return which

    def unsubscribe(self, handle: int) -> bool:
        """False if the handle is unknown or gone."""
        sub = self.handles.pop(handle, None)
        if sub is None:
            return False
        self.holders[sub] -= 1
        if not self.holders[sub]:
            del self.holders[sub]
            text, _, _, used = self.known.pop(sub)
            del self.by_text[text]
            for index, which in set(used):
                template = self.templates[which]
                del template.rows[sub, index]
                template.frame = None
                if not template.rows:
                    del self.templates[which]
            self.dirty.pop(sub, None)
        return True

    # -- evaluating
    def fired(self, changes: dict[str, DataFrame]) -> DataFrame:
        """changes: for each table its changed rows (old and new images alike). Rows (sub_id, conditions): the indexes that fired, sorted."""
        hits = None
        for t in self.templates.values():
            if t.table not in changes:
                continue
            rows = changes[t.table].select(*self.catalog[t.table].domains)
            subs = t.subscriptions(self.catalog)
            if sum(map(len, t.rows.values())) <= BROADCAST_ROWS:
                subs = F.broadcast(subs)
            if t.shape == ("const", True):
                one = subs.where(rows.limit(1).agg(F.count(F.lit(1))).scalar() > 0).select("sub_id", "cond")
            elif compared := _compared(t.shape):
                ends = F.array(F.min(F.col(f"`{compared}`")), F.max(F.col(f"`{compared}`")))
                one = subs.withColumn(compared, F.explode(rows.agg(ends).scalar())).where(_verify(t.shape)).select("sub_id", "cond").distinct()
            elif t.key_columns:
                on = None
                for k, (c, kind) in enumerate(zip(t.key_columns, t.key_types, strict=True)):
                    as_kind = {"NUM": "double", "I64": "long", "TIME": "timestamp"}.get(kind)
                    column = F.col(f"`{c}`").cast(as_kind) if as_kind else F.col(f"`{c}`")
                    equal = column == timed(F.col(f"__k{k}"), "STRING", kind)
                    on = equal if on is None else on & equal
                one = rows.join(subs, on).where(_verify(t.shape)).select("sub_id", "cond")
            else:
                one = rows.join(subs, _verify(t.shape)).select("sub_id", "cond")
            hits = one if hits is None else hits.unionByName(one)
        if hits is None:
            hits = self.catalog.spark.createDataFrame([], "sub_id long, cond int")
        return hits.groupBy("sub_id").agg(F.array_sort(F.collect_set("cond")).alias("conditions"))

    def on_zset(self, delta: ZSet) -> DataFrame:
        return self.fired({n: df.where("__weight <> 0") for n, df in delta.parts.items()})

    def on_insert(self, table: str, row: dict) -> DataFrame:
        """What one inserted row fires."""
        return self.fired({table: self.catalog.typed(table, [row])})

    on_delete = on_insert  # a deleted row fires the same

    # -- marking and draining
    def _mark(self, marks: dict[int, set[int]]) -> None:
        was_empty = not self.dirty
        for sub, fired in marks.items():
            if sub in self.known:
                self.dirty.setdefault(sub, set()).update(fired)
        if was_empty and self.dirty and self.wake:
            self.wake()

    def notify(self, delta: ZSet) -> None:
        """Marks what fired; wakes once when the marks were empty before. The marks are as many as there are subscriptions at most."""
        found = self.on_zset(delta).collect()
        self.trace["batches"] += 1
        self.trace["templates"] += len(self.templates)
        self.trace["fired"] += len(found)
        asked = [{"table": t.table, "keys": t.key_columns, "subscriptions": len(t.rows)} for t in self.templates.values() if t.table in delta.parts]
        self.log.event("round", templates=asked, fired=sum(len(r.conditions) for r in found), conditions=dict(Counter(c for r in found for c in r.conditions)))
        self._mark({r.sub_id: set(r.conditions) for r in found})

    def notify_all(self) -> None:
        self._mark({sub: set() for sub in self.known})

    def drain(self) -> list[tuple[int, frozenset[int]]]:
        """The marked subscriptions, each once, and no marks any more. Marks made meanwhile belong to the next cycle."""
        taken, self.dirty = self.dirty, {}
        return [(sub, frozenset(fired)) for sub, fired in sorted(taken.items()) if sub in self.known]

    def rerun(self, sub: int, fired=frozenset()) -> DataFrame:
        """The subscription's query, with its REACTIVE items showing what fired."""
        _, tree, params, _ = self.known[sub]
        return query(self.catalog, tree, params, triggered=fired)


def watch(stream: DataFrame, registry: Registry, table: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """A streaming query over a change feed of one table: each micro-batch is one drain cycle and gives sink (sub_id, conditions)."""

    def batch(df: DataFrame, epoch: int) -> None:
        sink(registry.fired({table: df}), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

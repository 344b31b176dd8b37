"""Registered queries on what the engine does besides SELECT: declaring, binding, changing, subscribing, syncing and loading.

Each runs the operator on the driver tables (or on tables it declares itself) and returns what the operator did as rows.
"""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import fragments
from brindle.operators import delta as z
from brindle.operators import dml
from brindle.plans.catalog_queries import _TOTALS, _positions, catalog
from brindle.plans.explain import plan_text, subscription_text
from brindle.plans.lower import host_params, query
from brindle.session import shared_folder
from brindle.sources import catalog as sources
from brindle.sources.catalog import Catalog, Fetchers
from brindle.sources.loading import Loader
from brindle.streaming import commands, sync
from brindle.streaming.reactive import Registry
from brindle.trace import Trace

PORTS = "CREATE TABLE port (code I64 PRIMARY KEY, name STRING NOT NULL, depth I64, INDEX by_depth (depth, name) USING BTREE, INDEX by_name (name) USING HASH)"


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _said(rows: list[tuple], types: str) -> str:
    """DuckDB VALUES with named, typed columns."""
    columns = [c.split() for c in types.split(", ")]
    shown = lambda v: "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in columns)} FROM (VALUES {values}) v({', '.join(n for n, _ in columns)})"


def ports(spark: SparkSession) -> Catalog:
    c = Catalog(spark)
    dml.execute_all(c, f"{PORTS}; INSERT INTO port VALUES (1, 'Malmö', 9), (2, 'Cádiz', 12); INSERT INTO port (code, name) VALUES (3, 'Bari')")
    return c


# -- declaring and rows
def create_insert(spark, sf_dir) -> DataFrame:
    c = ports(spark)
    dml.execute(c, "INSERT INTO port VALUES (:code, :name, :depth)", {"code": 4, "name": "Kiel", "depth": None})
    return c["port"].rows


_PORTS = _said([(1, "Malmö", 9), (2, "Cádiz", 12), (3, "Bari", None), (4, "Kiel", None)], "code BIGINT, name VARCHAR, depth BIGINT")


@dataclass
class BerthRow:
    berth_id: uuid.UUID
    label: str
    length: int | None


def register_typed(spark, sf_dir) -> DataFrame:
    """A dataclass as a table, and its rows by it."""
    c = Catalog(spark)
    table = c.register(BerthRow)
    dml.append(c, table.name, c.typed(table.name, [{"berth_id": uuid.UUID(int=k), "label": f"b{k}", "length": k * 10 or None} for k in range(3)]))
    return query(c, "SELECT berth_row.label, berth_row.length FROM berth_row")


def typed_reads(spark, sf_dir) -> DataFrame:
    """A result as typed Python rows, one row and one column."""

    @dataclass
    class Nation:
        key: int
        name: str

    c = catalog(spark, sf_dir)
    found = sources.read_rows(query(c, "SELECT nation.n_nationkey, nation.n_name FROM nation ORDER BY nation.n_nationkey DESC LIMIT 3"), Nation)
    one = sources.read_row(query(c, "SELECT nation.n_nationkey, nation.n_name FROM nation WHERE nation.n_nationkey = 0"), Nation)
    keys = sources.read_column(query(c, "SELECT nation.n_nationkey FROM nation ORDER BY nation.n_nationkey LIMIT 2"), int)
    return _table(spark, [("rows", n.key, n.name) for n in found] + [("row", one.key, one.name)] + [("column", k, None) for k in keys], "how string, key long, name string")


_TYPED = """
SELECT 'rows' AS how, CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM (SELECT * FROM nation ORDER BY n_nationkey DESC LIMIT 3)
UNION ALL SELECT 'row', n_nationkey, n_name FROM nation WHERE n_nationkey = 0
UNION ALL SELECT 'column', n_nationkey, NULL FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 2)
"""


def json_roundtrip(spark, sf_dir) -> DataFrame:
    rows = catalog(spark, sf_dir)["customer"].rows
    return sources.from_json_rows(sources.to_json_rows(rows), rows.schema)


def wire_changes(spark, sf_dir) -> DataFrame:
    """A change feed written, read back and summed."""
    c = catalog(spark, sf_dir)
    rows = c["events"].rows.select("event_id", "event_type")
    c.attach("feed", rows.limit(0), ("event_id",))
    changes = z.ZSet.of("feed", rows, F.when(F.col("event_type") == "error", -1).otherwise(1), F.col("event_id"))
    with shared_folder(spark, "wire") as folder:
        z.write_changes(changes, folder)
        found = z.weight_sums(z.read_changes(c, folder, "feed").parts["feed"], "event_type").collect()  # a row for each type
    return _table(spark, [tuple(r) for r in found], "event_type string, weight long")


def command_text(spark, sf_dir) -> DataFrame:
    """Commands as one text each, and back; what isn't one is refused."""
    made = [commands.Pay(1, 7, 500), commands.Credit(9, 7, 100, 1)]
    rows = [(commands.to_text(c), str(commands.from_text(commands.to_text(c)) == c)) for c in made]
    for bad in ("{}", '{"command": "Fly", "arguments": {}}', "no json"):
        try:
            commands.from_text(bad)
        except commands.Refused:
            rows.append((bad, "refused"))
    return _table(spark, rows, "text string, back string")


_COMMANDS = _said(
    [
        ('{"arguments": {"amount": 500, "invoice_id": 7, "payment_id": 1}, "command": "Pay"}', "True"),
        ('{"arguments": {"activity_id": 1, "first_position": 100, "invoice_id": 7, "note_id": 9}, "command": "Credit"}', "True"),
        ("{}", "refused"),
        ('{"command": "Fly", "arguments": {}}', "refused"),
        ("no json", "refused"),
    ],
    "text VARCHAR, back VARCHAR",
)


# -- binding and errors
def _outcomes(cases: dict[str, Callable[[], object]], spark: SparkSession) -> DataFrame:
    rows = []
    for name, f in cases.items():
        try:
            f()
            rows.append((name, "fine"))
        except ValueError as e:
            rows.append((name, type(e).__name__))
    return _table(spark, rows, "what string, outcome string")


_ERRORS = {
    "bound": ("SELECT port.name FROM port WHERE port.code = :v", {"v": 1}, "fine"),
    "unbound": ("SELECT port.name FROM port WHERE port.code = :v", {}, "BindError"),
    "list for scalar": ("SELECT port.name FROM port WHERE port.code = :v", {"v": [1]}, "BindError"),
    "text limit": ("SELECT port.name FROM port LIMIT :n", {"n": "x"}, "BindError"),
    "unbound in values": ("INSERT INTO port VALUES (:a, 'x', 1)", {}, "BindError"),
    "unknown column": ("SELECT port.nope FROM port", {}, "AnalysisError"),
    "unknown table": ("SELECT dock.code FROM dock", {}, "DialectError"),
    "neither grouped nor aggregated": ("SELECT port.name, COUNT(port.code) AS n FROM port", {}, "AnalysisError"),
    "key twice": ("INSERT INTO port VALUES (1, 'again', 1)", {}, "ConstraintError"),
    "null where none may be": ("INSERT INTO port VALUES (9, NULL, 1)", {}, "ConstraintError"),
    "too few values": ("INSERT INTO port VALUES (9)", {}, "ConstraintError"),
    "wrong type": ("INSERT INTO port VALUES ('x', 'y', 1)", {}, "ConstraintError"),
    "key made equal": ("UPDATE port SET code = 1", {}, "ConstraintError"),
    "table twice": ("CREATE TABLE port (code I64)", {}, "DialectError"),
    "column twice": ("CREATE TABLE dock (a I64, a I64)", {}, "DialectError"),
    "nullable key": ("CREATE TABLE dock (a I64, PRIMARY KEY (a))", {}, "DialectError"),
    "index of no column": ("CREATE TABLE dock (a I64, INDEX (b))", {}, "DialectError"),
    "no statement": ("SELEC port.name FROM port", {}, "DialectError"),
}


def error_kinds(spark, sf_dir) -> DataFrame:
    c = ports(spark)
    return _outcomes({n: lambda t=t, p=p: dml.execute(c, t, p) for n, (t, p, _) in _ERRORS.items()}, spark)


_SUBSCRIBE_ERRORS = {
    "subquery": "SELECT REACTIVE(port.code IN (SELECT port.code FROM port)) AS x FROM port",
    "no column": "SELECT REACTIVE(1 = 1) AS x FROM port",
    "two tables": "SELECT REACTIVE(port.code = nation.n_nationkey) AS x FROM port JOIN nation ON port.code = nation.n_nationkey",
}


def reactive_refused(spark, sf_dir) -> DataFrame:
    c = ports(spark)
    c.attach("nation", catalog(spark, sf_dir)["nation"].rows, ("n_nationkey",))
    return _outcomes({n: lambda t=t: Registry(c).subscribe(t) for n, t in _SUBSCRIBE_ERRORS.items()}, spark)


def fragment_query(spark, sf_dir) -> DataFrame:
    part = fragments.sql("customer.c_nationkey = {nation} OR customer.c_mktsegment IN ({segments})", nation=3, segments=["BUILDING", "MACHINERY"])
    text, params = fragments.sql("SELECT customer.c_custkey FROM customer WHERE {part} AND customer.c_custkey != {not_this} AND customer.c_acctbal > {low}", part=part, not_this=True, low=0.0).render()
    return query(catalog(spark, sf_dir), text, params)


def param_conversion(spark, sf_dir) -> DataFrame:
    """What values become as parameters, from Python and from a text host; templates that don't render."""
    shown = lambda v: f"{type(v).__name__} {v}"
    rows = [(repr(v), shown(fragments.to_param(v))) for v in (True, 7, 2.5, "x", None, (1, False))]
    rows += [(f"host {v!r}", shown(host_params({"v": v})["v"])) for v in (3.0, "00000000-0000-0000-0000-000000000007", "plain")]
    for bad in ("{x", "x}", "{nope}"):
        try:
            fragments.sql(bad).render()
        except fragments.RenderError as e:
            rows.append((bad, type(e).__name__))
    return _table(spark, rows, "given string, made string")


_CONVERTED = _said(
    [("True", "int 1"), ("7", "int 7"), ("2.5", "float 2.5"), ("'x'", "str x"), ("None", "NoneType None"), ("(1, False)", "list [1, 0]"), ("host 3.0", "int 3"), ("host '00000000-0000-0000-0000-000000000007'", "UUID 00000000-0000-0000-0000-000000000007"), ("host 'plain'", "str plain"), ("{x", "RenderError"), ("x}", "RenderError"), ("{nope}", "RenderError")],
    "given VARCHAR, made VARCHAR",
)


def filter_in_time(spark, sf_dir) -> DataFrame:
    c = catalog(spark, sf_dir)
    ends = c["events"].rows.agg(F.min("ts").cast("string"), F.max("ts").cast("string")).first()
    return query(c, "SELECT events.event_id, events.user_id FROM events WHERE events.ts IN (:a, :b, 'never')", {"a": ends[0], "b": ends[1]})


# -- changing
def dml_update_key(spark, sf_dir) -> DataFrame:
    """A key may change, but not to one that is there; a loose update may do that too."""
    c = catalog(spark, sf_dir)
    dml.execute(c, "UPDATE nation SET n_nationkey = 99 WHERE nation.n_nationkey = 1")
    try:
        dml.execute(c, "UPDATE nation SET n_nationkey = 2 WHERE nation.n_regionkey = 1")
        refused = False
    except sources.ConstraintError:
        refused = True
    return c["nation"].rows.withColumn("refused", F.lit(refused))


def insert_append(spark, sf_dir) -> DataFrame:
    """Without the key check rows are only appended."""
    c = catalog(spark, sf_dir)
    dml.append(c, "customer", c["customer"].rows.where("c_acctbal < 0"), strict=False)
    return c["customer"].rows.groupBy("c_custkey").count().withColumnRenamed("count", "n")


def result_kinds(spark, sf_dir) -> DataFrame:
    c, rows = ports(spark), []
    for text in ("CREATE TABLE crane (id I64 PRIMARY KEY)", "INSERT INTO crane VALUES (1)", "UPDATE port SET depth = 1 WHERE port.code = 1", "SELECT port.code FROM port", "DELETE FROM port"):
        found = dml.execute(c, text)
        n = sum(d.count() for d in found.changes.parts.values()) if isinstance(found, dml.Mutation) else found.df.count() if isinstance(found, dml.Rows) else 0
        rows.append((text, type(found).__name__, n))
    return _table(spark, rows, "statement string, kind string, n long")


_KINDS = _said(
    [("CREATE TABLE crane (id I64 PRIMARY KEY)", "Ddl", 0), ("INSERT INTO crane VALUES (1)", "Mutation", 1), ("UPDATE port SET depth = 1 WHERE port.code = 1", "Mutation", 2), ("SELECT port.code FROM port", "Rows", 3), ("DELETE FROM port", "Mutation", 3)],
    "statement VARCHAR, kind VARCHAR, n BIGINT",
)


def script(spark, sf_dir) -> DataFrame:
    """What ran before a failing statement stays."""
    c = ports(spark)
    try:
        dml.execute_all(c, "DELETE FROM port WHERE port.code = 1; INSERT INTO port VALUES (7, 'Turku', 8); INSERT INTO port VALUES (7, 'again', 8); DELETE FROM port")
    except sources.ConstraintError:
        pass
    return c["port"].rows


def replace_tables(spark, sf_dir) -> DataFrame:
    """Changes of a copy become the catalog's; later changes of the copy don't."""
    c = catalog(spark, sf_dir)
    work = c.copy()
    dml.execute(work, "DELETE FROM nation WHERE nation.n_regionkey = 1")
    untouched = c["nation"].rows.count()
    c.replace_tables(work)
    dml.execute(work, "DELETE FROM nation")
    return c["nation"].rows.withColumn("before", F.lit(untouched))


def database_sink(spark, sf_dir) -> DataFrame:
    """The changes of an INSERT, an UPDATE and a DELETE applied to a database, and its table read back."""
    c = catalog(spark, sf_dir, "nation")
    path = "file:brindle?mode=memory&cache=shared"
    with_table = sqlite3.connect(path, uri=True)
    with_table.execute("DROP TABLE IF EXISTS nation")
    with_table.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER)")
    sink = commands.DatabaseSink(lambda: sqlite3.connect(path, uri=True), c)
    sink.apply(z.ZSet.of("nation", c["nation"].rows, 1))
    for text in ("INSERT INTO nation VALUES (100, NULL, 4)", "UPDATE nation SET n_name = 'X' WHERE nation.n_regionkey = 1", "DELETE FROM nation WHERE nation.n_regionkey = 2 OR nation.n_nationkey = 100"):
        sink.apply(dml.execute(c, text).changes)
    found = with_table.execute("SELECT * FROM nation").fetchall()
    with_table.close()
    return _table(spark, found, "n_nationkey int, n_name string, n_regionkey int")


# -- plans
def plan_printing(spark, sf_dir) -> DataFrame:
    c = ports(spark)
    c.attach("nation", catalog(spark, sf_dir)["nation"].rows, ("n_nationkey",))
    c.trace = Trace()
    texts = [
        "SELECT port.name FROM port WHERE port.code = 1",
        "SELECT port.name FROM port WHERE port.depth = 9",
        "SELECT port.name FROM port WHERE port.depth = 9 AND port.name > 'M'",
        "SELECT port.depth FROM port WHERE port.name = 'Bari' LIMIT 3",
        "SELECT port.depth FROM port WHERE port.code IN (1, 2) ORDER BY port.depth DESC",
        "SELECT port.name, COUNT(nation.n_nationkey) AS n FROM port LEFT JOIN nation ON port.code = nation.n_nationkey WHERE port.depth != 3 GROUP BY port.name",
    ]
    for text in texts:
        query(c, text)
    rows = [(q["sql"], k, line) for q in c.trace.queries for k, line in enumerate(q["plan"].split("\n"))]
    watched = "SELECT REACTIVE(port.code = 1 AND port.depth > 4) AS a, port.name FROM port WHERE REACTIVE(port.name)"
    rows += [(watched, k, line) for k, line in enumerate(subscription_text(c, watched).split("\n"))]
    assert plan_text(c, texts[0]) == c.trace.queries[0]["plan"]
    return _table(spark, rows, "sql string, step int, line string")


_PLANS = _said(
    [
        ("SELECT port.name FROM port WHERE port.code = 1", 0, "project port.name"),
        ("SELECT port.name FROM port WHERE port.code = 1", 1, "  scan port where port.code = 1 [lookup by btree (code)]"),
        ("SELECT port.name FROM port WHERE port.depth = 9", 0, "project port.name"),
        ("SELECT port.name FROM port WHERE port.depth = 9", 1, "  scan port where port.depth = 9 [prefix of 1 of btree (depth, name)]"),
        ("SELECT port.name FROM port WHERE port.depth = 9 AND port.name > 'M'", 0, "project port.name"),
        ("SELECT port.name FROM port WHERE port.depth = 9 AND port.name > 'M'", 1, "  scan port where port.depth = 9 AND port.name > 'M' [range after 1 of btree (depth, name)]"),
        ("SELECT port.depth FROM port WHERE port.name = 'Bari' LIMIT 3", 0, "limit 3"),
        ("SELECT port.depth FROM port WHERE port.name = 'Bari' LIMIT 3", 1, "  project port.depth"),
        ("SELECT port.depth FROM port WHERE port.name = 'Bari' LIMIT 3", 2, "    scan port where port.name = 'Bari' [lookup by hash (name)]"),
        ("SELECT port.depth FROM port WHERE port.code IN (1, 2) ORDER BY port.depth DESC", 0, "sort port.depth desc"),
        ("SELECT port.depth FROM port WHERE port.code IN (1, 2) ORDER BY port.depth DESC", 1, "  project port.depth"),
        ("SELECT port.depth FROM port WHERE port.code IN (1, 2) ORDER BY port.depth DESC", 2, "    scan port where port.code IN (1, 2) [many lookups by btree (code)]"),
        ("SELECT port.name, COUNT(nation.n_nationkey) AS n FROM port LEFT JOIN nation ON port.code = nation.n_nationkey WHERE port.depth != 3 GROUP BY port.name", 0, "aggregate by (port.name): COUNT(nation.n_nationkey)"),
        ("SELECT port.name, COUNT(nation.n_nationkey) AS n FROM port LEFT JOIN nation ON port.code = nation.n_nationkey WHERE port.depth != 3 GROUP BY port.name", 1, "  scan port where port.depth != 3 [full scan]"),
        ("SELECT port.name, COUNT(nation.n_nationkey) AS n FROM port LEFT JOIN nation ON port.code = nation.n_nationkey WHERE port.depth != 3 GROUP BY port.name", 2, "  left join on port.code = nation.n_nationkey: scan nation [full scan]"),
        ("SELECT REACTIVE(port.code = 1 AND port.depth > 4) AS a, port.name FROM port WHERE REACTIVE(port.name)", 0, "0: port by code in [1], verify (port.code = 1 AND port.depth > 4)"),
        ("SELECT REACTIVE(port.code = 1 AND port.depth > 4) AS a, port.name FROM port WHERE REACTIVE(port.name)", 1, "1: port on any change"),
    ],
    "sql VARCHAR, step INTEGER, line VARCHAR",
)


# -- subscribing
def _watched(spark, sf_dir, *texts: str) -> tuple[Catalog, Registry, list[tuple[int, int]]]:
    c = catalog(spark, sf_dir, "customer", "nation", "events")
    registry = Registry(c)
    return c, registry, [registry.subscribe(t) for t in texts]


_NATION = "SELECT REACTIVE(customer.c_nationkey = {}) AS hit, customer.c_custkey FROM customer"


def reactive_time(spark, sf_dir) -> DataFrame:
    c, registry, _ = _watched(spark, sf_dir)
    first, last = c["events"].rows.agg(F.min("ts").cast("string"), F.max("ts").cast("string")).first()
    for text, p in (("events.ts = :a", {"a": first}), ("events.ts IN (:a, 'never')", {"a": last}), ("events.ts = :a", {"a": "1999-01-01 00:00:00"}), ("events.ts > :a", {"a": last}), ("events.ts >= :a AND events.user_id = :u", {"a": first, "u": 5})):
        registry.subscribe(f"SELECT events.event_id FROM events WHERE REACTIVE({text})", p)
    return registry.fired({"events": c["events"].rows}).select("sub_id")


_TIME = "SELECT CAST(1 AS BIGINT) AS sub_id FROM (SELECT count(*) AS n FROM events) WHERE n > 0 UNION ALL SELECT 2 FROM (SELECT count(*) AS n FROM events) WHERE n > 0 UNION ALL SELECT 5 WHERE EXISTS (SELECT 1 FROM events WHERE user_id = 5)"


def reactive_range(spark, sf_dir) -> DataFrame:
    """Many subscriptions to one comparison each."""
    c, registry, _ = _watched(spark, sf_dir)
    for k in range(60):
        registry.subscribe(f"SELECT events.event_id FROM events WHERE REACTIVE(events.value {('>', '<=', '!=')[k % 3]} :v)", {"v": (k - 10) * 50.0})
    return registry.fired({"events": c["events"].rows}).select("sub_id")


_RANGE = "SELECT k + 1 AS sub_id FROM (SELECT range AS k, (range - 10) * 50.0 AS v FROM range(60)) WHERE EXISTS (SELECT 1 FROM events WHERE CASE k % 3 WHEN 0 THEN value > v WHEN 1 THEN value <= v ELSE value <> v END)"


def reactive_or_in(spark, sf_dir) -> DataFrame:
    """ORs of equalities on one column become one lookup with many keys; other branches are looked up apart."""
    c, registry, _ = _watched(
        spark,
        sf_dir,
        "SELECT customer.c_custkey FROM customer WHERE REACTIVE(customer.c_nationkey = 1 OR customer.c_nationkey = 2 OR customer.c_nationkey IN (2, 3))",
        "SELECT customer.c_custkey FROM customer WHERE REACTIVE(customer.c_nationkey = 777 OR customer.c_nationkey = 778)",
        "SELECT customer.c_custkey FROM customer WHERE REACTIVE(customer.c_nationkey = 777 OR customer.c_acctbal > 0.0)",
    )
    keys = {sub: 0 for sub in registry.known}
    for t in registry.templates.values():
        for (sub, _), found in t.rows.items():
            keys[sub] += len(found) if t.key_columns else 0
    fired = registry.fired({"customer": c["customer"].rows}).select("sub_id")
    return fired.join(_table(spark, list(keys.items()), "sub_id long, keys long"), "sub_id")


_OR_IN = "SELECT CAST(1 AS BIGINT) AS sub_id, CAST(3 AS BIGINT) AS keys WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey IN (1, 2, 3)) UNION ALL SELECT 3, 1 WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 0.0)"


def reactive_unsubscribe(spark, sf_dir) -> DataFrame:
    """Of three subscriptions, one with two holders: it stays until both are gone."""
    c, registry, (a, b, again, d) = _watched(spark, sf_dir, _NATION.format(1), _NATION.format(2), _NATION.format(2), _NATION.format(3))
    done = [registry.unsubscribe(h) for h in (a[0], a[0], b[0])]
    return registry.fired({"customer": c["customer"].rows}).select("sub_id", F.lit(str(done)).alias("done"), F.lit(len(registry.known)).cast("long").alias("known"))


_UNSUBSCRIBED = " UNION ALL ".join(f"SELECT CAST({s} AS BIGINT) AS sub_id, '[True, False, True]' AS done, CAST(2 AS BIGINT) AS known WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = {n})" for s, n in ((2, 2), (3, 3)))


def reactive_one_row(spark, sf_dir) -> DataFrame:
    """An inserted and a deleted row fire alike."""
    _, registry, _ = _watched(spark, sf_dir, *(_NATION.format(k) for k in range(4)))
    row = {"c_custkey": 1, "c_name": "x", "c_nationkey": 2, "c_acctbal": 1.0, "c_mktsegment": None}
    added, gone = (f("customer", row).select("sub_id", F.lit(n).alias("how")) for f, n in ((registry.on_insert, "insert"), (registry.on_delete, "delete")))
    return added.unionByName(gone)


def reactive_shared(spark, sf_dir) -> DataFrame:
    """The same text with the same parameters is one subscription with several handles."""
    _, registry, handles = _watched(spark, sf_dir, _NATION.format(1), _NATION.format(2), _NATION.format(1))
    handles += [registry.subscribe("SELECT customer.c_custkey FROM customer WHERE REACTIVE(customer.c_nationkey = :n)", {"n": n}) for n in (1, 2, 1)]
    return _table(spark, handles, "handle long, sub_id long")


_SHARED = _said([(1, 1), (2, 2), (3, 1), (4, 3), (5, 4), (6, 3)], "handle BIGINT, sub_id BIGINT")


def reactive_drain(spark, sf_dir) -> DataFrame:
    """Two rounds of changes before one drain: each marked subscription once, and one wake; later marks are the next cycle's."""
    c, registry, _ = _watched(spark, sf_dir, *(_NATION.format(k) for k in range(6)))
    woken, rows = [], []
    registry.wake = lambda: woken.append(1)
    registry.notify(dml.execute(c, "UPDATE customer SET c_nationkey = 4 WHERE customer.c_nationkey = 1").changes)
    registry.notify(dml.execute(c, "DELETE FROM customer WHERE customer.c_nationkey = 2").changes)
    for cycle in range(3):
        rows += [(cycle, sub, len(fired), len(woken)) for sub, fired in registry.drain()]
        if not cycle:
            registry.notify(dml.execute(c, "DELETE FROM customer WHERE customer.c_nationkey = 0").changes)
    return _table(spark, rows, "cycle long, sub_id long, fired long, wakes long")


_DRAINED = """
WITH hit AS (SELECT 0 AS cycle, n, 1 AS wakes FROM (VALUES (1), (4)) v(n) WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 1)
  UNION ALL SELECT 0, 2, 1 WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 2) UNION ALL SELECT 1, 0, 2 WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 0))
SELECT CAST(cycle AS BIGINT) AS cycle, CAST(n + 1 AS BIGINT) AS sub_id, CAST(1 AS BIGINT) AS fired, CAST(wakes AS BIGINT) AS wakes FROM hit
"""


def reactive_notify_all(spark, sf_dir) -> DataFrame:
    _, registry, handles = _watched(spark, sf_dir, *(_NATION.format(k) for k in range(4)))
    registry.unsubscribe(handles[1][0])
    registry.notify_all()
    return _table(spark, [(sub, len(fired)) for sub, fired in registry.drain()], "sub_id long, fired long")


def reactive_rerun(spark, sf_dir) -> DataFrame:
    """What a drained subscription's query gives, with its flags."""
    c, registry, _ = _watched(spark, sf_dir, "SELECT REACTIVE(nation.n_regionkey = 1) AS one, REACTIVE(nation.n_regionkey = 99) AS other, nation.n_nationkey FROM nation")
    registry.notify(dml.execute(c, "UPDATE nation SET n_name = 'X' WHERE nation.n_regionkey = 1").changes)
    ((sub, fired),) = registry.drain()
    return registry.rerun(sub, fired)


def reactive_trace(spark, sf_dir) -> DataFrame:
    """What a round looked up, and what fired by condition."""
    c, registry, _ = _watched(spark, sf_dir, *(_NATION.format(k) for k in range(3)), "SELECT REACTIVE(customer.c_custkey) AS a, customer.c_custkey FROM customer")
    registry.notify(dml.execute(c, "UPDATE customer SET c_name = 'X'").changes)
    _, kind, what = registry.log.events[-1]
    rows = [(kind, f"{t['table']} by {', '.join(t['keys']) or 'any change'}", t["subscriptions"]) for t in what["templates"]]
    return _table(spark, [*rows, (kind, "fired", what["fired"]), *((kind, f"condition {k}", n) for k, n in what["conditions"].items())], "event string, what string, n long")


_TRACED = """
WITH hit AS (SELECT count(DISTINCT c_nationkey) AS n FROM customer WHERE c_nationkey IN (0, 1, 2)), a AS (SELECT n + 1 AS n FROM hit)
SELECT 'round' AS event, 'customer by c_nationkey' AS what, CAST(3 AS BIGINT) AS n UNION ALL SELECT 'round', 'customer by any change', 1 UNION ALL SELECT 'round', 'fired', n FROM a UNION ALL SELECT 'round', 'condition 0', n FROM a
"""


# -- syncing
def _lanes(spark, sf_dir) -> tuple[Catalog, sync.SyncClient, sync.EchoServer]:
    c = catalog(spark, sf_dir, "nation")
    veto = lambda at, changes: "nation 13 stays" if not changes.parts["nation"].where("n_nationkey = 13").isEmpty() else None
    return c, sync.SyncClient(Registry(c)), sync.EchoServer(c.copy(), veto)


def _rename(key: int):
    return lambda c: dml.execute(c, f"UPDATE nation SET n_name = 'X{key}' WHERE nation.n_nationkey = {key}").changes


def _renamed(*keys: int) -> str:
    return f"SELECT n_nationkey, CASE WHEN n_nationkey IN ({', '.join(map(str, keys)) or 'NULL'}) THEN 'X' || n_nationkey ELSE n_name END AS n_name, n_regionkey FROM nation"


def sync_execute(spark, sf_dir) -> DataFrame:
    """Commands show at once, before any answer, and are numbered by stream."""
    c, client, _ = _lanes(spark, sf_dir)
    one, two = client.create_stream(), client.create_stream()
    seqs = [client.execute(s, _rename(k))[0] for s, k in ((one, 1), (one, 2), (two, 13))]
    return c["nation"].rows.withColumn("seqs", F.lit(str(seqs)))


def sync_blocking(spark, sf_dir) -> DataFrame:
    c, client, server = _lanes(spark, sf_dir)
    states = [client.execute_blocking(_rename(k), server) for k in (1, 13)]
    return c["nation"].rows.withColumn("states", F.lit(",".join(states)))


def sync_reconcile(spark, sf_dir) -> DataFrame:
    """Answers out of order: the stream waits, then the server's changes replace the optimistic ones. Here the server has its own."""
    c, client, server = _lanes(spark, sf_dir)
    s = client.create_stream()
    sent = [client.execute(s, _rename(k)) for k in (1, 2)]
    own = [server.handle(_rename_as(server.catalog, k)) for k in (1, 2)]
    states = [client.receive(s, sent[k][0], own[k]) for k in (1, 0)]
    return c["nation"].rows.withColumn("states", F.lit(",".join(states)))


def _rename_as(c: Catalog, key: int) -> z.ZSet:
    return dml.execute(c.copy(), f"UPDATE nation SET n_name = 'server {key}' WHERE nation.n_nationkey = {key}").changes


def sync_rollback(spark, sf_dir) -> DataFrame:
    """A reject undoes the whole stream, and no other."""
    c, client, server = _lanes(spark, sf_dir)
    one, two = client.create_stream(), client.create_stream()
    sent = [(s, *client.execute(s, _rename(k))) for s, k in ((one, 1), (two, 2), (one, 13), (one, 3))]
    states = [client.receive(s, seq, server.handle(changes)) for s, seq, changes in sent]
    return c["nation"].rows.withColumn("states", F.lit(",".join(states)))


def sync_batch_abort(spark, sf_dir) -> DataFrame:
    """A batch with a rejected command leaves the server's tables as they were."""
    _, client, server = _lanes(spark, sf_dir)
    batch = [client.execute(client.create_stream(), _rename(k))[1] for k in (1, 13, 2)]
    reasons = [v.reason for v in server.handle_batch(batch)]
    fine = [v.reason for v in server.handle_batch(batch[::2][:1])]
    return server.catalog["nation"].rows.withColumn("reasons", F.lit(f"{reasons} {fine}"))


def sync_batching(spark, sf_dir) -> DataFrame:
    """A client's batches of two, sent again when the line breaks."""
    c, client, server = _lanes(spark, sf_dir)
    broken = [True]

    class Line:
        def handle_batch(self, batch):
            if broken.pop() if broken else False:
                raise ConnectionError
            return server.handle_batch(batch)

    b = sync.Batcher(client, Line(), client.create_stream(), count=2, retries=1)
    states = [b.execute(_rename(k)) for k in (1, 2, 3)] + [b.flush()]
    return c["nation"].rows.withColumn("states", F.lit(",".join(states)))


def _invoicing(spark, sf_dir) -> tuple[Catalog, int]:
    """Orders as invoices, their lines as positions. Line numbers repeat within an order: positions are numbered by line number, then by place in the files."""
    tables = catalog(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("*", "_metadata.file_path", "_metadata.row_index")
    ids = _positions(spark, sf_dir).columns
    first, most = lines.groupBy("l_orderkey").count().agg(F.min("l_orderkey"), F.max("count")).first()
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("l_linenumber"), "file_path", "row_index"))
    numbered = lines.select(F.col("l_orderkey").alias("invoice_id"), F.col("l_quantity").cast("long").alias("quantity"), *(F.round(F.col(c) * 100).cast("long").alias(n) for c, n in (("l_extendedprice", "unit_price"), ("l_discount", "discount_pct"), ("l_tax", "tax_rate"))), (F.col("l_orderkey") * most + place - 1).alias("position_id"))
    assert set(ids) < set(numbered.columns)
    invoices = tables["orders"].rows.select(F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("customer_id"), F.lit("invoice").alias("kind"), F.lit(None).cast("long").alias("parent_id"))
    return commands.seeded(Catalog(spark), invoices, numbered), first


def server_commands(spark, sf_dir) -> DataFrame:
    """Payments and a credit note run by the server: what is refused, and what is due after each."""
    c, i = _invoicing(spark, sf_dir)
    server, all_ = commands.CommandServer(c), commands.due(c, i)
    steps = [
        ("nothing", commands.Pay(1, i, 0)), ("some", commands.Pay(1, i, 100)), ("same payment", commands.Pay(1, i, 100)), ("too much", commands.Pay(2, i, all_)),
        ("the rest", commands.Pay(2, i, all_ - 100)), ("credit", commands.Credit(-i - 1, i, 10**12, 1)), ("credit again", commands.Credit(-i - 2, i, 10**13, 2)),
    ]
    rows = [(n, name, server.handle(commands.to_text(step)).reason is None, commands.due(c, i)) for n, (name, step) in enumerate(steps)]
    return _table(spark, rows, "step long, name string, accepted boolean, due long")


_SERVED = f"""
{_TOTALS}, i AS (SELECT gross AS g FROM t WHERE invoice_id = (SELECT min(l_orderkey) FROM lineitem))
SELECT CAST(step AS BIGINT) AS step, name, accepted, CAST(due AS BIGINT) AS due FROM i, LATERAL (VALUES (0, 'nothing', false, g), (1, 'some', true, g - 100), (2, 'same payment', false, g - 100), (3, 'too much', false, g - 100),
  (4, 'the rest', true, 0), (5, 'credit', true, -g), (6, 'credit again', false, -g)) v(step, name, accepted, due)
"""


def server_recomputes(spark, sf_dir) -> DataFrame:
    """A client's credit note settled by the server's own: the note's positions on the client's tables. A bad batch undoes both sides.

    The bad batch comes first, as nothing is due after the note: somebody else has paid all but a cent, which the client doesn't know, so
    that of its two payments of a cent the server takes one and finds the other too much.
    """
    c, i = _invoicing(spark, sf_dir)
    server, client = commands.CommandServer(c.copy()), sync.SyncClient(Registry(c))
    text = commands.to_text
    server.handle(text(commands.Pay(5, i, commands.due(server.catalog, i) - 1)))
    bad = commands.exchange(client, client.create_stream(), server, [text(commands.Pay(k, i, 1)) for k in (6, 7)])
    good = commands.exchange(client, client.create_stream(), server, [text(commands.Credit(-7, i, 10**12, 1))])
    rows = c["position"].rows.where("invoice_id = -7").select("position_id", "quantity", "unit_price")
    paid = c["payment"].rows.count() + server.catalog["payment"].rows.where("payment_id <> 5").count()  # what is left of the bad batch
    return rows.withColumns({"states": F.lit(f"{good},{bad}"), "noted": F.lit(c["activity"].rows.count()), "paid": F.lit(paid)})


_RECOMPUTED = """
SELECT 1000000000000 + row_number() OVER (ORDER BY l_linenumber) - 1 AS position_id, -CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS unit_price,
  'confirmed,rejected' AS states, CAST(1 AS BIGINT) AS noted, CAST(0 AS BIGINT) AS paid FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)
"""


# -- loading
def _loader(spark, sf_dir) -> tuple[Catalog, Loader]:
    fetchers = Fetchers()

    @fetchers.register("orders.of_customer")
    def of_customer(customer: int, minimum: float) -> DataFrame:
        if customer < 0:
            raise sources.ConstraintError("no such customer")
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
        return rows.where((F.col("o_custkey") == customer) & sources.at_least("o_totalprice", minimum)).select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"))

    c = Catalog(spark)
    dml.execute(c, "CREATE TABLE loaded (order_id I64 PRIMARY KEY, customer I64 NOT NULL)")
    return c, Loader(c, fetchers)


_LOADED = "SELECT loaded.customer, COUNT(loaded.order_id) AS n FROM loaded GROUP BY loaded.customer"


def load_rows(spark, sf_dir) -> DataFrame:
    """Two fetches land their rows in a table, and a derived query runs on them; the shared one is fetched once."""
    _, loader = _loader(spark, sf_dir)
    one, two = (loader.fetched("orders.of_customer", "loaded", customer=k, minimum=0.0) for k in (1, 4))
    total = loader.derived(_LOADED, upstream=(one, two))
    states = [loader.subscribe(one).value, loader.subscribe(total).value]
    return loader.rows(total).withColumn("states", F.lit(",".join(states)))


def load_invalidate(spark, sf_dir) -> DataFrame:
    """A slot fetched again keeps what is there, and subscriptions hear of what lands."""
    c, loader = _loader(spark, sf_dir)
    registry = Registry(c)
    registry.subscribe("SELECT loaded.order_id FROM loaded WHERE REACTIVE(loaded.customer = 1)")
    registry.subscribe("SELECT loaded.order_id FROM loaded WHERE REACTIVE(loaded.customer = 2)")
    loader.landed = lambda table, changes: registry.notify(changes)
    slot = loader.fetched("orders.of_customer", "loaded", customer=1, minimum=100000.0)
    loader.subscribe(slot)
    marked = [sub for sub, _ in registry.drain()]
    loader.invalidate(slot)
    again = [sub for sub, _ in registry.drain()]
    return c["loaded"].rows.withColumn("marked", F.lit(f"{marked} {again}"))


def load_states(spark, sf_dir) -> DataFrame:
    """States by step: waiting for a late fetch, ready, failed, and gone."""
    _, loader = _loader(spark, sf_dir)
    jobs: list[Callable[[], None]] = []
    loader.run = jobs.append
    good, bad = (loader.fetched("orders.of_customer", "loaded", customer=k, minimum=0.0) for k in (1, -1))
    fine, poor = loader.derived(_LOADED, upstream=(good,)), loader.derived(_LOADED, upstream=(good, bad))
    state = lambda key: loader.requirements.state(key).value
    rows = [("declared", state(fine), state(poor))]
    loader.subscribe(fine)
    loader.subscribe(poor)
    rows.append(("subscribed", state(fine), state(poor)))
    for n, name in enumerate(("first answer", "second answer")):
        jobs[n]()
        rows.append((name, state(fine), state(poor)))
    loader.unsubscribe(fine)
    loader.unsubscribe(poor)
    rows.append((f"left {len(loader.requirements.slots)}", state(fine), state(poor)))
    return _table(spark, rows, "step string, fine string, poor string")


_STATES = _said([("declared", "idle", "idle"), ("subscribed", "loading", "loading"), ("first answer", "ready", "loading"), ("second answer", "ready", "error"), ("left 0", "idle", "idle")], "step VARCHAR, fine VARCHAR, poor VARCHAR")


def fetcher_min_amount(spark, sf_dir) -> DataFrame:
    """All orders of at least an amount, or all."""
    fetchers = Fetchers()
    fetchers.register("orders")(lambda minimum: spark.read.parquet(f"{sf_dir}/orders.parquet").where(sources.at_least("o_totalprice", minimum)).select("o_orderkey"))
    return fetchers.fetch("orders", minimum=150000.0).withColumn("asked", F.lit("some")).unionByName(fetchers.fetch("orders", minimum=None).withColumn("asked", F.lit("all")))


#: name: (callable, oracle)
MADE = {
    "create_insert": (create_insert, _PORTS),
    "register_typed": (register_typed, _said([("b0", None), ("b1", 10), ("b2", 20)], "label VARCHAR, length BIGINT")),
    "typed_reads": (typed_reads, _TYPED),
    "json_roundtrip": (json_roundtrip, "SELECT * FROM customer"),
    "wire_changes": (wire_changes, "SELECT event_type, CAST(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS BIGINT) AS weight FROM events GROUP BY 1"),
    "command_text": (command_text, _COMMANDS),
    "error_kinds": (error_kinds, _said([(n, e) for n, (_, _, e) in _ERRORS.items()], "what VARCHAR, outcome VARCHAR")),
    "reactive_refused": (reactive_refused, _said([(n, "AnalysisError") for n in _SUBSCRIBE_ERRORS], "what VARCHAR, outcome VARCHAR")),
    "fragment_query": (fragment_query, "SELECT c_custkey FROM customer WHERE (c_nationkey = 3 OR c_mktsegment IN ('BUILDING', 'MACHINERY')) AND c_custkey <> 1 AND c_acctbal > 0"),
    "param_conversion": (param_conversion, _CONVERTED),
    "filter_bool_literal": (lambda spark, sf_dir: query(catalog(spark, sf_dir), "SELECT part.p_partkey FROM part WHERE TRUE AND part.p_size = 3 OR FALSE"), "SELECT p_partkey FROM part WHERE p_size = 3"),
    "filter_in_time": (filter_in_time, "SELECT event_id, user_id FROM events WHERE ts IN (SELECT min(ts) FROM events UNION ALL SELECT max(ts) FROM events)"),
    "dml_update_key": (dml_update_key, "SELECT CASE WHEN n_nationkey = 1 THEN 99 ELSE n_nationkey END AS n_nationkey, n_name, n_regionkey, true AS refused FROM nation"),
    "insert_append": (insert_append, "SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM customer"),
    "result_kinds": (result_kinds, _KINDS),
    "script": (script, _said([(2, "Cádiz", 12), (3, "Bari", None), (7, "Turku", 8)], "code BIGINT, name VARCHAR, depth BIGINT")),
    "replace_tables": (replace_tables, "SELECT *, (SELECT count(*) FROM nation) AS before FROM nation WHERE n_regionkey <> 1"),
    "database_sink": (database_sink, "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2"),
    "plan_printing": (plan_printing, _PLANS),
    "reactive_time": (reactive_time, _TIME),
    "reactive_range": (reactive_range, _RANGE),
    "reactive_or_in": (reactive_or_in, _OR_IN),
    "reactive_unsubscribe": (reactive_unsubscribe, _UNSUBSCRIBED),
    "reactive_one_row": (reactive_one_row, _said([(3, "insert"), (3, "delete")], "sub_id BIGINT, how VARCHAR")),
    "reactive_shared": (reactive_shared, _SHARED),
    "reactive_drain": (reactive_drain, _DRAINED),
    "reactive_notify_all": (reactive_notify_all, _said([(1, 0), (3, 0), (4, 0)], "sub_id BIGINT, fired BIGINT")),
    "reactive_rerun": (reactive_rerun, "SELECT CAST(1 AS BIGINT) AS one, CAST(0 AS BIGINT) AS other, n_nationkey FROM nation"),
    "reactive_trace": (reactive_trace, _TRACED),
    "sync_execute": (sync_execute, f"SELECT *, '[1, 2, 1]' AS seqs FROM ({_renamed(1, 2, 13)})"),
    "sync_blocking": (sync_blocking, f"SELECT *, 'confirmed,rejected' AS states FROM ({_renamed(1)})"),
    "sync_reconcile": (sync_reconcile, "SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 2) THEN 'server ' || n_nationkey ELSE n_name END AS n_name, n_regionkey, 'wait,confirmed' AS states FROM nation"),
    "sync_rollback": (sync_rollback, f"SELECT *, 'wait,confirmed,rejected,wait' AS states FROM ({_renamed(2)})"),
    "sync_batch_abort": (sync_batch_abort, f"SELECT *, '[''batch aborted'', ''nation 13 stays'', ''batch aborted''] [None]' AS reasons FROM ({_renamed(1)})"),
    "sync_batching": (sync_batching, f"SELECT *, 'wait,confirmed,wait,confirmed' AS states FROM ({_renamed(1, 2, 3)})"),
    "server_commands": (server_commands, _SERVED),
    "server_recomputes": (server_recomputes, _RECOMPUTED),
    "load_rows": (load_rows, "SELECT o_custkey AS customer, count(*) AS n, 'ready,ready' AS states FROM orders WHERE o_custkey IN (1, 4) GROUP BY 1"),
    "load_invalidate": (load_invalidate, "SELECT o_orderkey AS order_id, o_custkey AS customer, CASE WHEN count(*) OVER () > 0 THEN '[1] [1]' END AS marked FROM orders WHERE o_custkey = 1 AND o_totalprice >= 100000"),
    "load_states": (load_states, _STATES),
    "fetcher_min_amount": (fetcher_min_amount, "SELECT o_orderkey, 'some' AS asked FROM orders WHERE o_totalprice >= 150000 UNION ALL SELECT o_orderkey, 'all' FROM orders"),
}


def queries() -> dict:
    return {n: f for n, (f, _) in MADE.items()}


def oracle_sql() -> dict[str, str]:
    return {n: oracle for n, (_, oracle) in MADE.items()}

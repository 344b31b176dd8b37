"""Registered queries over the driver tables, one or more per operator family, with their DuckDB SQL.

Most are dialect text and differ from their oracle only where the dialects do: casts of sums, explicit places of NULL, parameters.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import money
from brindle.operators import delta as z
from brindle.operators import dml
from brindle.plans.dialect import Col, IsNull, parse
from brindle.plans.lower import query
from brindle.sources import catalog as sources
from brindle.sources.catalog import Catalog
from brindle.streaming import sync
from brindle.streaming.reactive import Registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")
KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",)}


def catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    return Catalog(spark).attach_parquet(sf_dir, *(names or TABLES), keys=KEYS)


FLAGSHIP = (
    "SELECT nation.n_name, COUNT(customer.c_custkey) AS n, MAX(customer.c_custkey) AS top FROM customer "
    "INNER JOIN nation ON customer.c_nationkey = nation.n_nationkey WHERE customer.c_custkey > 10 "
    "GROUP BY nation.n_name ORDER BY nation.n_name LIMIT 5"
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(catalog(spark, sf_dir, "customer", "nation"), FLAGSHIP)


_LJ = "FROM nation LEFT JOIN customer ON nation.n_nationkey = customer.c_nationkey"
#: A condition on values, and one that leaves unmatched nations at any size.
_POSITIVE = "customer.c_acctbal > 0.0"
_PADDING = f"{_POSITIVE} AND nation.n_regionkey > 1"

#: name: (dialect text, oracle text or None where they are the same, options of query())
TEXTS: dict[str, tuple[str, str | None, dict]] = {
    "flagship": (FLAGSHIP, None, {}),
    "scan_project": ("SELECT customer.c_name AS name, customer.c_custkey AS k, customer.c_custkey AS again FROM customer", None, {}),
    "scan_index_eq": ("SELECT orders.o_orderkey, orders.o_totalprice FROM orders WHERE orders.o_orderkey = 7", None, {}),
    "scan_prefix_eq": ("SELECT lineitem.l_orderkey, lineitem.l_linenumber, lineitem.l_quantity FROM lineitem WHERE lineitem.l_orderkey = 7", None, {}),
    "scan_prefix_range": ("SELECT lineitem.l_linenumber, lineitem.l_quantity FROM lineitem WHERE lineitem.l_suppkey = 3 AND lineitem.l_quantity > 45", None, {}),
    "scan_multi_lookup": ("SELECT orders.o_orderkey, orders.o_custkey FROM orders WHERE orders.o_orderkey IN (1, 5, 5, 9, 12)", None, {}),
    "filter_cmp_eq": ("SELECT part.p_partkey, part.p_size FROM part WHERE part.p_size = 10", None, {}),
    "filter_cmp_ne": ("SELECT part.p_partkey, part.p_size FROM part WHERE part.p_size != 10", None, {}),
    "filter_cmp_gt": ("SELECT part.p_partkey, part.p_size FROM part WHERE part.p_size > 40", None, {}),
    "filter_cmp_ge": ("SELECT part.p_partkey, part.p_size FROM part WHERE part.p_size >= 40", None, {}),
    "filter_cmp_lt": ("SELECT part.p_partkey, part.p_size FROM part WHERE part.p_size < 5", None, {}),
    "filter_cmp_le": ("SELECT part.p_partkey, part.p_size FROM part WHERE part.p_size <= 5", None, {}),
    "filter_literal_left": ("SELECT part.p_partkey, part.p_size FROM part WHERE 45 <= part.p_size", None, {}),
    "filter_and_or": ("SELECT part.p_partkey, part.p_size, part.p_brand FROM part WHERE part.p_size < 10 AND (part.p_partkey > 500 OR part.p_size = 3) OR part.p_partkey = 1", None, {}),
    "filter_in_list": ("SELECT nation.n_nationkey, nation.n_name FROM nation WHERE nation.n_nationkey IN (1, 3, 99, NULL)", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 3, 99)", {}),
    "filter_in_param": ("SELECT nation.n_nationkey, nation.n_name FROM nation WHERE nation.n_nationkey IN (:ids)", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (2, 4, 6)", {"params": {"ids": [2, 4, 6]}}),
    "filter_in_empty": ("SELECT nation.n_nationkey FROM nation WHERE nation.n_nationkey IN (:ids)", "SELECT n_nationkey FROM nation WHERE false", {"params": {"ids": []}}),
    "filter_null_param": ("SELECT nation.n_nationkey FROM nation WHERE nation.n_nationkey = :v", "SELECT n_nationkey FROM nation WHERE n_nationkey = NULL", {"params": {"v": None}}),
    "filter_param": ("SELECT customer.c_custkey FROM customer WHERE :low < customer.c_custkey", "SELECT c_custkey FROM customer WHERE 100 < c_custkey", {"params": {"low": 100}}),
    "filter_unlike_types": ("SELECT nation.n_nationkey FROM nation WHERE nation.n_name = 5 OR nation.n_nationkey = 2", "SELECT n_nationkey FROM nation WHERE n_nationkey = 2", {}),
    "filter_float_ansi": ("SELECT part.p_partkey FROM part WHERE part.p_size > 18.9 AND part.p_size < 20", None, {}),
    "filter_float_reference": ("SELECT part.p_partkey FROM part WHERE part.p_size > 18.9 AND part.p_size < 21", "SELECT p_partkey FROM part WHERE p_size > 18 AND p_size < 21", {"semantics": "reference"}),
    "filter_reactive_transparent": ("SELECT part.p_partkey FROM part WHERE REACTIVE(part.p_size = 7)", "SELECT p_partkey FROM part WHERE p_size = 7", {}),
    "in_subquery": ("SELECT customer.c_custkey, customer.c_name FROM customer WHERE customer.c_custkey IN (SELECT orders.o_custkey FROM orders WHERE orders.o_totalprice > 300000.0)", None, {}),
    "in_subquery_or": ("SELECT customer.c_custkey FROM customer WHERE customer.c_custkey < 5 OR customer.c_custkey IN (SELECT orders.o_custkey FROM orders WHERE orders.o_totalprice > 400000.0)", None, {}),
    "in_subquery_nested": (
        "SELECT orders.o_orderkey FROM orders WHERE orders.o_custkey IN (SELECT customer.c_custkey FROM customer WHERE customer.c_nationkey IN (SELECT nation.n_nationkey FROM nation WHERE nation.n_regionkey = 1))",
        None,
        {},
    ),
    "scalar_subquery_eq": ("SELECT part.p_partkey, part.p_size FROM part WHERE part.p_partkey = (SELECT MAX(part.p_partkey) AS m FROM part)", None, {}),
    "scalar_subquery_gt": ("SELECT part.p_partkey FROM part WHERE part.p_size > (SELECT part.p_size FROM part WHERE part.p_partkey = 3)", None, {}),
    "scalar_subquery_flipped": ("SELECT part.p_partkey FROM part WHERE (SELECT part.p_size FROM part WHERE part.p_partkey = 3) >= part.p_size", None, {}),
    "scalar_subquery_empty": ("SELECT part.p_partkey FROM part WHERE part.p_size = (SELECT part.p_size FROM part WHERE part.p_partkey = -1)", None, {}),
    "join_inner": ("SELECT customer.c_name, nation.n_name FROM customer INNER JOIN nation ON customer.c_nationkey = nation.n_nationkey", None, {}),
    "join_inner_filter": ("SELECT customer.c_custkey, orders.o_orderkey FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey WHERE orders.o_totalprice > 200000.0 AND customer.c_custkey < 200", None, {}),
    "join_multi": (
        "SELECT region.r_name, nation.n_name, customer.c_custkey FROM region JOIN nation ON region.r_regionkey = nation.n_regionkey JOIN customer ON customer.c_nationkey = nation.n_nationkey WHERE region.r_regionkey < 3",
        None,
        {},
    ),
    "join_left": (f"SELECT nation.n_name, customer.c_custkey {_LJ} AND {_PADDING}", None, {}),
    "join_left_where_right": (f"SELECT nation.n_name, customer.c_custkey {_LJ} WHERE {_POSITIVE}", None, {}),
    "join_left_where_right_ref": (
        f"SELECT nation.n_name, customer.c_custkey {_LJ} WHERE {_POSITIVE}",
        "SELECT n_name, c_custkey FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 0.0",
        {"semantics": "reference"},
    ),
    "join_left_where_left": (f"SELECT nation.n_name, customer.c_custkey {_LJ} WHERE nation.n_nationkey < 4", None, {}),
    "join_theta": ("SELECT region.r_name, nation.n_name FROM region JOIN nation ON region.r_regionkey < nation.n_regionkey", None, {}),
    "join_or": ("SELECT region.r_name, nation.n_name FROM region JOIN nation ON region.r_regionkey = nation.n_regionkey OR nation.n_nationkey = 0", None, {}),
    "join_cross_literal": ("SELECT region.r_name, nation.n_name FROM region JOIN nation ON region.r_regionkey = :r", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = 2", {"params": {"r": 2}}),
    "join_self_alias": ("SELECT a.n_name AS one, b.n_name AS two FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", None, {}),
    "agg_group": (
        "SELECT lineitem.l_returnflag, COUNT(lineitem.l_orderkey) AS n, SUM(lineitem.l_partkey) AS s FROM lineitem GROUP BY lineitem.l_returnflag",
        "SELECT l_returnflag, COUNT(l_orderkey) AS n, CAST(SUM(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag",
        {},
    ),
    "agg_multi_key": (
        "SELECT lineitem.l_returnflag, lineitem.l_linestatus, COUNT(lineitem.l_orderkey) AS n, MIN(lineitem.l_quantity) AS low, MAX(lineitem.l_quantity) AS high FROM lineitem GROUP BY lineitem.l_returnflag, lineitem.l_linestatus",
        None,
        {},
    ),
    "agg_global": ("SELECT COUNT(orders.o_orderkey) AS n, SUM(orders.o_custkey) AS s, MIN(orders.o_orderkey) AS low FROM orders", "SELECT COUNT(o_orderkey) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, MIN(o_orderkey) AS low FROM orders", {}),
    "agg_global_empty": ("SELECT COUNT(orders.o_orderkey) AS n, MAX(orders.o_custkey) AS top FROM orders WHERE orders.o_orderkey < 0", None, {}),
    "agg_global_empty_ref": (
        "SELECT COUNT(orders.o_orderkey) AS n, MAX(orders.o_custkey) AS top FROM orders WHERE orders.o_orderkey < 0",
        "SELECT COUNT(o_orderkey) AS n, MAX(o_custkey) AS top FROM orders WHERE o_orderkey < 0 HAVING COUNT(*) > 0",
        {"semantics": "reference"},
    ),
    "agg_minmax_string": ("SELECT customer.c_mktsegment, MIN(customer.c_name) AS low, MAX(customer.c_name) AS high FROM customer GROUP BY customer.c_mktsegment", None, {}),
    "agg_null_skip": (
        f"SELECT nation.n_name, COUNT(customer.c_custkey) AS n, SUM(customer.c_custkey) AS s {_LJ} AND {_PADDING} GROUP BY nation.n_name",
        "SELECT n_name, COUNT(c_custkey) AS n, CAST(SUM(c_custkey) AS BIGINT) AS s FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 0.0 AND n_regionkey > 1 GROUP BY n_name",
        {},
    ),
    "agg_null_key": (f"SELECT customer.c_custkey, COUNT(nation.n_nationkey) AS n {_LJ} AND {_PADDING} GROUP BY customer.c_custkey", None, {}),
    "group_only": ("SELECT orders.o_orderpriority, orders.o_orderstatus FROM orders GROUP BY orders.o_orderpriority, orders.o_orderstatus", None, {}),
    "sort_nulls": (
        f"SELECT nation.n_nationkey, customer.c_custkey {_LJ} AND {_PADDING} ORDER BY customer.c_custkey DESC, nation.n_nationkey LIMIT 12",
        "SELECT n_nationkey, c_custkey FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 0.0 AND n_regionkey > 1 ORDER BY c_custkey DESC NULLS FIRST, n_nationkey LIMIT 12",
        {},
    ),
    "sort_multi": ("SELECT orders.o_orderstatus, orders.o_orderkey FROM orders ORDER BY orders.o_orderstatus DESC, orders.o_orderkey ASC LIMIT 50", None, {}),
    "topk": ("SELECT orders.o_orderkey, orders.o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, orders.o_orderkey LIMIT 10", None, {}),
    "sort_aggregate": (
        "SELECT customer.c_nationkey, COUNT(customer.c_custkey) AS n FROM customer GROUP BY customer.c_nationkey ORDER BY n DESC, customer.c_nationkey LIMIT 5",
        None,
        {},
    ),
    "limit_zero": ("SELECT nation.n_name FROM nation LIMIT 0", None, {}),
    "limit_param": ("SELECT nation.n_nationkey FROM nation ORDER BY nation.n_nationkey LIMIT :n", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 3", {"params": {"n": 3}}),
    "reactive_flag_column": (
        "SELECT REACTIVE(nation.n_nationkey = 3) AS one, REACTIVE(nation.n_name) AS two, nation.n_nationkey FROM nation",
        "SELECT CAST(0 AS BIGINT) AS one, CAST(1 AS BIGINT) AS two, n_nationkey FROM nation",
        {"triggered": {1}},
    ),
}
for _op, _sign in (("eq", "="), ("ne", "!="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    TEXTS[f"filter_col_col_{_op}"] = (f"SELECT lineitem.l_orderkey, lineitem.l_partkey, lineitem.l_suppkey FROM lineitem WHERE lineitem.l_partkey {_sign} lineitem.l_suppkey", None, {})


def _text(name: str):
    text, _, options = TEXTS[name]
    return lambda spark, sf_dir: query(catalog(spark, sf_dir), text, **options)


# -- changes: event_id orders, user_id is the key, event_type tells what happens
_EVENT = "user_id, event_id, event_type, round(value, 2) AS value"


def _feed(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", F.round("value", 2).alias("value"))
    return rows


def _with_order(df: DataFrame, weight) -> DataFrame:
    return df.withColumns({"__epoch": F.lit(0), "__seq": F.col("event_id"), "__weight": weight})


def zset_apply_pk(spark, sf_dir) -> DataFrame:
    """All events but errors are upserts of their user's row; then a user's last error deletes the row it came after."""
    c = Catalog(spark)
    feed = _feed(spark, sf_dir)
    c.attach("users", feed.limit(0), ("user_id",))
    ups = feed.where("event_type <> 'error'")
    z.apply_zset(c, z.ZSet({"users": _with_order(ups, F.lit(1))}))
    image = c["users"].rows
    gone = feed.where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("__seq"))
    deletes = image.join(gone, "user_id").where(F.col("__seq") > F.col("event_id")).select(*image.columns, F.lit(0).alias("__epoch"), "__seq", F.lit(-1).alias("__weight"))
    z.apply_zset(c, z.ZSet({"users": deletes}))
    return c["users"].rows


def zset_apply_bag(spark, sf_dir) -> DataFrame:
    """lineitem has no key: flags as a bag, one R removed for each line 1 and an N added for each line 2."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    base = lines.select("l_returnflag", "l_linestatus")
    minus = lines.where("l_linenumber = 1").select(F.lit("R").alias("l_returnflag"), "l_linestatus", F.lit(0).alias("__epoch"), F.col("l_orderkey").alias("__seq"), F.lit(-1).alias("__weight"))
    plus = lines.where("l_linenumber = 2").select(F.lit("N").alias("l_returnflag"), "l_linestatus", F.lit(1).alias("__epoch"), F.col("l_orderkey").alias("__seq"), F.lit(1).alias("__weight"))
    out = z.apply_bag(base, minus.unionByName(plus))
    return out.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def zset_invert(spark, sf_dir) -> DataFrame:
    d = z.ZSet.of("events", _feed(spark, sf_dir), F.when(F.col("event_type") == "error", -1).otherwise(1), F.col("event_id")).invert()
    return z.weight_sums(d.parts["events"], "event_type")


def zset_extend_cancel(spark, sf_dir) -> DataFrame:
    d = z.ZSet.of("events", _feed(spark, sf_dir), 1, F.col("event_id"))
    both = d.extend(d.invert(backwards=True)).extend(z.ZSet.of("events", _feed(spark, sf_dir).where("event_type = 'view'"), 1, F.col("event_id")))
    return z.weight_sums(both.parts["events"], "event_type")


def _dml(statement: str, table: str, changes: bool = False):
    def run(spark, sf_dir) -> DataFrame:
        c = catalog(spark, sf_dir)
        out = dml.execute(c, statement)
        if changes:
            return out.changes.parts[table].select(*c[table].domains, F.col("__weight").cast("int").alias("weight"))
        return c[table].rows

    return run


_INSERT = "INSERT INTO region (r_regionkey, r_name) VALUES (100, 'NORTH'), (101, NULL)"
_UPDATE = "UPDATE nation SET n_name = 'X' WHERE nation.n_regionkey = 1 OR nation.n_nationkey = 0"
_DELETE = "DELETE FROM nation WHERE nation.n_regionkey IN (1, 2)"

#: subscriptions on events for the reactive queries: name, condition, the same in DuckDB
SUBSCRIPTIONS = {
    "reactive_table": ("REACTIVE(events.user_id)", "true"),
    "reactive_eq": ("REACTIVE(events.user_id = {})", "user_id = {}"),
    "reactive_in": ("REACTIVE(events.user_id IN ({}, 77))", "user_id IN ({}, 77)"),
    "reactive_or": ("REACTIVE(events.user_id = {} OR events.event_type = 'signup')", "user_id = {} OR event_type = 'signup'"),
    "reactive_mixed_range": ("REACTIVE(events.user_id = {} AND events.value > 90.5)", "user_id = {} AND value > 90.5"),
}
USERS = (5, 7, 5000, 9)


def _reactive(name: str):
    """Every row of events is a change."""

    def run(spark, sf_dir) -> DataFrame:
        c = catalog(spark, sf_dir, "events")
        registry = Registry(c)
        for u in USERS:
            registry.subscribe(f"SELECT events.event_id FROM events WHERE {SUBSCRIPTIONS[name][0].format(u)} AND events.event_id != {u}")
        return registry.fired({"events": c["events"].rows}).select(F.col("sub_id"), F.size("conditions").cast("long").alias("n"))

    return run


def _reactive_sql(name: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST({k + 1} AS BIGINT) AS sub_id, CAST(1 AS BIGINT) AS n WHERE EXISTS (SELECT 1 FROM events WHERE {SUBSCRIPTIONS[name][1].format(u)})" for k, u in enumerate(USERS))


def reactive_two_conditions(spark, sf_dir) -> DataFrame:
    """Every row of events is a change."""
    c = catalog(spark, sf_dir, "events")
    registry = Registry(c)
    for u in range(200):
        registry.subscribe("SELECT REACTIVE(events.user_id = :u) AS a, REACTIVE(events.event_id = :e) AS b, events.event_id FROM events", {"u": u, "e": u * 31})
    fired = registry.fired({"events": c["events"].rows})
    return fired.select("sub_id", F.array_join(F.col("conditions").cast("array<string>"), ",").alias("conditions"))


_TWO = """
WITH subs AS (SELECT range AS u, range + 1 AS sub_id FROM range(200)),
hits AS (SELECT DISTINCT sub_id, 0 AS c FROM subs JOIN events ON user_id = u UNION SELECT DISTINCT sub_id, 1 FROM subs JOIN events ON event_id = u * 31)
SELECT CAST(sub_id AS BIGINT) AS sub_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS conditions FROM hits GROUP BY sub_id
"""

def reactive_update_images(spark, sf_dir) -> DataFrame:
    """An UPDATE's old and new images both count."""
    c = catalog(spark, sf_dir, "nation")
    registry = Registry(c)
    for k in range(5):
        registry.subscribe("SELECT nation.n_name FROM nation WHERE REACTIVE(nation.n_regionkey = :r)", {"r": k})
    out = dml.execute(c, "UPDATE nation SET n_regionkey = 4 WHERE nation.n_regionkey = 1")
    return registry.on_zset(out.changes).select("sub_id")


def _lanes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lanes = events.select((F.col("user_id")).alias("stream_id"), F.col("event_id").alias("seq_no"), "event_type")
    return lanes.select("stream_id", "seq_no"), lanes.where("event_type <> 'view' OR seq_no % 50 <> 0").select("stream_id", "seq_no", (~((F.col("event_type") == "error") & (F.col("seq_no") % 40 == 0))).alias("confirmed"))


def _sync(state: str):
    return lambda spark, sf_dir: sync.fold(*_lanes(spark, sf_dir)).where(F.col("state") == state)


_SYNC = """
WITH p AS (SELECT user_id AS stream_id, event_id AS seq_no, event_type = 'view' AND event_id % 50 = 0 AS missing,
  event_type = 'error' AND event_id % 40 = 0 AS rejected FROM events),
s AS (SELECT stream_id, count(*) AS pending, min(CASE WHEN missing THEN seq_no END) AS m, min(CASE WHEN rejected AND NOT missing THEN seq_no END) AS r FROM p GROUP BY 1),
f AS (SELECT stream_id, pending, CASE WHEN r IS NOT NULL AND (m IS NULL OR r < m) THEN 'rejected' WHEN m IS NOT NULL THEN 'wait' ELSE 'confirmed' END AS state FROM s)
SELECT * FROM f WHERE state = '{}'
"""


def latest_image(spark, sf_dir) -> DataFrame:
    return sync.latest_image(_feed(spark, sf_dir), "user_id", "event_id", "event_type = 'error'")


# -- invoices: orders are invoices in cents, lineitem their positions
def _positions(spark, sf_dir) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_orderkey").alias("invoice_id"), F.col("l_quantity").cast("long").alias("quantity"), cents("l_extendedprice").alias("unit_price"), cents("l_discount").alias("discount_pct"), cents("l_tax").alias("tax_rate"))


def invoice_gross(spark, sf_dir) -> DataFrame:
    return money.invoice_totals(_positions(spark, sf_dir))


def top_customers(spark, sf_dir) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("customer_id"))
    return money.top_customers(invoice_gross(spark, sf_dir), orders, 10)


def balance_due(spark, sf_dir) -> DataFrame:
    payments = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("invoice_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"))
    return money.balance_due(invoice_gross(spark, sf_dir), payments)


_TOTALS = """
WITH p AS (SELECT l_orderkey AS invoice_id, CAST(round(CAST(l_quantity AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) / 100.0) AS BIGINT) AS net,
  CAST(round(l_tax * 100) AS BIGINT) AS tax FROM lineitem),
t AS (SELECT invoice_id, CAST(sum(net) AS BIGINT) AS net, CAST(sum(CAST(round(net * (100 + tax) / 100.0) AS BIGINT)) AS BIGINT) AS gross FROM p GROUP BY 1)
"""


def credit_note(spark, sf_dir) -> DataFrame:
    """A credit note for every invoice: its positions again, with quantities negated."""
    rows = _positions(spark, sf_dir)
    notes = rows.withColumns({"invoice_id": -1 - F.col("invoice_id"), "quantity": -F.col("quantity")})
    return money.invoice_totals(rows.unionByName(notes))


def cascade_delete(spark, sf_dir) -> DataFrame:
    """A customer goes with all orders and their lines; what is left of the lines, by flag."""
    c = catalog(spark, sf_dir)
    dml.execute(c, "DELETE FROM lineitem WHERE lineitem.l_orderkey IN (SELECT orders.o_orderkey FROM orders WHERE orders.o_custkey = 3)")
    dml.execute(c, "DELETE FROM orders WHERE orders.o_custkey = 3")
    dml.execute(c, "DELETE FROM customer WHERE customer.c_custkey = 3")
    return query(c, "SELECT lineitem.l_returnflag, COUNT(lineitem.l_orderkey) AS n FROM lineitem GROUP BY lineitem.l_returnflag")


def fetcher_contains(spark, sf_dir) -> DataFrame:
    fetchers = sources.Fetchers()

    @fetchers.register("documents.by_text")
    def by_text(part: str, lang: str | None) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/documents.parquet").where(sources.contains("text", part) & sources.equals_if_given("lang", lang)).select("doc_id", "lang")

    return fetchers.fetch("documents.by_text", part="that", lang="en")


def fetcher_null_safe(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left").select("doc_id", "toxic")
    return rows.where(sources.equals_or_null("toxic", None))


def _null(negated: bool):
    """The dialect has no words for IS NULL; its tree has."""

    def run(spark, sf_dir) -> DataFrame:
        tree = parse(f"SELECT nation.n_nationkey, customer.c_custkey {_LJ} AND {_PADDING}")
        return query(catalog(spark, sf_dir), dataclasses.replace(tree, where=IsNull(Col("customer", "c_custkey"), negated)))

    return run


_PADDED = "SELECT n_nationkey, c_custkey FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 0.0 AND n_regionkey > 1 WHERE c_custkey IS"

#: name: (callable, oracle)
MADE = {
    "filter_null": (_null(False), f"{_PADDED} NULL"),
    "filter_not_null": (_null(True), f"{_PADDED} NOT NULL"),
    "dml_insert": (_dml(_INSERT, "region"), "SELECT * FROM region UNION ALL VALUES (100, 'NORTH'), (101, NULL)"),
    "dml_update": (_dml(_UPDATE, "nation"), "SELECT n_nationkey, CASE WHEN n_regionkey = 1 OR n_nationkey = 0 THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM nation"),
    "dml_delete": (_dml(_DELETE, "nation"), "SELECT * FROM nation WHERE n_regionkey NOT IN (1, 2)"),
    "dml_change_rows": (
        _dml(_UPDATE, "nation", changes=True),
        "SELECT n_nationkey, n_name, n_regionkey, CAST(-1 AS INTEGER) AS weight FROM nation WHERE n_regionkey = 1 OR n_nationkey = 0 UNION ALL SELECT n_nationkey, 'X', n_regionkey, CAST(1 AS INTEGER) FROM nation WHERE n_regionkey = 1 OR n_nationkey = 0",
    ),
    "zset_apply_pk": (
        zset_apply_pk,
        f"WITH u AS (SELECT {_EVENT}, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type <> 'error'), g AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_type = 'error' GROUP BY 1) SELECT u.user_id, u.event_id, u.event_type, u.value FROM u LEFT JOIN g USING (user_id) WHERE rn = 1 AND (g.e IS NULL OR g.e < u.event_id)",
    ),
    "zset_apply_bag": (
        zset_apply_bag,
        "WITH b AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_linestatus AS s, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), p AS (SELECT l_linestatus AS s, count(*) AS n FROM lineitem WHERE l_linenumber = 2 GROUP BY 1), r AS (SELECT f AS l_returnflag, s AS l_linestatus, greatest(0, b.n - CASE WHEN f = 'R' THEN coalesce(m.n, 0) ELSE 0 END) + CASE WHEN f = 'N' THEN coalesce(p.n, 0) ELSE 0 END AS n FROM b LEFT JOIN m USING (s) LEFT JOIN p USING (s)) SELECT l_returnflag, l_linestatus, CAST(n AS BIGINT) AS n FROM r WHERE n > 0",
    ),
    "zset_invert": (zset_invert, "SELECT event_type, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE -1 END) AS BIGINT) AS weight FROM events GROUP BY 1"),
    "zset_extend_cancel": (zset_extend_cancel, "SELECT event_type, count(*) AS weight FROM events WHERE event_type = 'view' GROUP BY 1"),
    "latest_image": (latest_image, f"SELECT user_id, event_id, event_type, value FROM (SELECT {_EVENT}, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'"),
    **{n: (_reactive(n), _reactive_sql(n)) for n in SUBSCRIPTIONS},
    "reactive_two_conditions": (reactive_two_conditions, _TWO),
    "reactive_update_images": (reactive_update_images, "SELECT CAST(r + 1 AS BIGINT) AS sub_id FROM (VALUES (1), (4)) v(r) WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 1)"),
    **{f"sync_{n}": (_sync(s), _SYNC.format(s)) for n, s in (("confirm", "confirmed"), ("reject", "rejected"), ("wait", "wait"))},
    "invoice_gross": (invoice_gross, f"{_TOTALS} SELECT * FROM t"),
    "top_customers": (top_customers, f"{_TOTALS} SELECT o_custkey AS customer_id, CAST(sum(gross) AS BIGINT) AS gross, count(*) AS invoices FROM t JOIN orders ON o_orderkey = invoice_id GROUP BY 1 ORDER BY gross DESC, customer_id LIMIT 10"),
    "balance_due": (
        balance_due,
        f"{_TOTALS}, y AS (SELECT o_orderkey AS invoice_id, CAST(round(o_totalprice * 100) AS BIGINT) AS paid FROM orders WHERE o_orderstatus = 'F') SELECT invoice_id, gross, coalesce(paid, 0) AS paid, gross - coalesce(paid, 0) AS due FROM t LEFT JOIN y USING (invoice_id)",
    ),
    "credit_note": (credit_note, f"{_TOTALS} SELECT invoice_id, net, gross FROM t UNION ALL SELECT -1 - invoice_id, -net, -gross FROM t"),
    "cascade_delete": (cascade_delete, "SELECT l_returnflag, COUNT(l_orderkey) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = 3) GROUP BY 1"),
    "fetcher_contains": (fetcher_contains, "SELECT doc_id, lang FROM documents WHERE contains(text, 'that') AND lang = 'en'"),
    "fetcher_null_safe": (fetcher_null_safe, "SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL"),
}


def queries() -> dict:
    return {n: _text(n) for n in TEXTS} | {n: f for n, (f, _) in MADE.items()}


def oracle_sql() -> dict[str, str]:
    return {n: oracle or text for n, (text, oracle, _) in TEXTS.items()} | {n: oracle for n, (_, oracle) in MADE.items()}

"""The engine on random tables, against DuckDB or one-entry-at-a-time replays."""

import dataclasses
import random
import sqlite3
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.functions import fragments
from brindle.operators import dml
from brindle.operators.delta import ORDER, ZSet, apply_bag, apply_keyed, apply_zset, read_changes, replaced_rows, write_changes
from brindle.plans import engine_queries
from brindle.plans.dialect import BindError, DialectError
from brindle.plans.explain import access, plan_text
from brindle.plans.lower import AnalysisError, Prepared, host_params, query
from brindle.sources import catalog as sources
from brindle.sources.catalog import Catalog, ConstraintError, Fetchers
from brindle.sources.loading import Loader
from brindle.sources.requirements import Requirements, State
from brindle.streaming import commands, reactive, sync
from brindle.streaming.reactive import Registry
from brindle.trace import Trace

GAUGES = [(k, random.Random(k).choice(["fjord", "delta", "lagoon"]), random.Random(k + 50).choice([None, 3, 8, 15])) for k in range(1, 10)]
LEVELS = [(100 + k, random.Random(k).randrange(1, 12), random.Random(k + 7).randrange(-40, 90), random.Random(k + 9).choice([None, "ice", "flood"])) for k in range(45)]


@pytest.fixture
def world(spark):
    """Water gauges and the levels they measured; some gauges have none, some levels are of unknown gauges."""
    c = Catalog(spark)
    dml.execute_all(c, "CREATE TABLE gauge (gid I64 PRIMARY KEY, water STRING NOT NULL, metres I64); CREATE TABLE level (lid I64 PRIMARY KEY, gauge I64 NOT NULL, cm I64 NOT NULL, remark STRING, INDEX (gauge, cm))")
    for name, rows in (("gauge", GAUGES), ("level", LEVELS)):
        dml.append(c, name, c.typed(name, [dict(zip(c[name].domains, r, strict=True)) for r in rows]))
    return c


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    con.execute("CREATE TABLE gauge (gid BIGINT, water VARCHAR, metres BIGINT); CREATE TABLE level (lid BIGINT, gauge BIGINT, cm BIGINT, remark VARCHAR)")
    con.executemany("INSERT INTO gauge VALUES (?, ?, ?)", GAUGES)
    con.executemany("INSERT INTO level VALUES (?, ?, ?, ?)", LEVELS)
    return con


def rows(df):
    return [tuple(r) for r in df.collect()]


def some(df):
    return sorted(rows(df), key=str)


#: Dialect text, parameters, and the same for DuckDB where it differs.
SAME = [
    ("SELECT level.cm, gauge.water FROM level JOIN gauge ON level.gauge = gauge.gid AND level.cm >= 0", {}, None),
    ("SELECT gauge.gid, level.lid FROM gauge LEFT JOIN level ON gauge.gid = level.gauge AND level.remark = 'ice' WHERE gauge.metres <= 8", {}, None),
    ("SELECT gauge.water, COUNT(level.remark) AS n, SUM(level.cm) AS s, MIN(level.cm) AS low FROM gauge JOIN level ON gauge.gid = level.gauge GROUP BY gauge.water", {}, None),
    ("SELECT gauge.metres, SUM(gauge.metres) AS s, MAX(gauge.water) AS w FROM gauge GROUP BY gauge.metres", {}, None),
    ("SELECT gauge.gid FROM gauge WHERE gauge.gid IN (SELECT level.gauge FROM level WHERE level.cm < -20) OR gauge.water = 'delta'", {}, None),
    ("SELECT level.lid FROM level WHERE level.cm > (SELECT MAX(gauge.metres) AS m FROM gauge) AND level.remark != 'flood'", {}, None),
    ("SELECT lid FROM level WHERE cm IN (5, NULL, 17) OR cm < -35", {}, "SELECT lid FROM level WHERE cm IN (5, 17) OR cm < -35"),
    ("SELECT level.lid FROM level WHERE :from <= level.cm AND level.gauge IN (:g)", {"from": 10, "g": [2, 3, 5]}, "SELECT lid FROM level WHERE 10 <= cm AND gauge IN (2, 3, 5)"),
    ("SELECT gauge.gid FROM gauge WHERE gauge.metres = :none OR gauge.gid IN (:empty)", {"none": None, "empty": []}, "SELECT gid FROM gauge WHERE false"),
    ("SELECT gauge.gid FROM gauge WHERE gauge.water != 5 OR gauge.gid = 'x' OR gauge.metres = 3", {}, "SELECT gid FROM gauge WHERE metres = 3"),
    ("SELECT a.gid AS one, b.gid AS two FROM gauge AS a JOIN gauge AS b ON a.metres < b.metres", {}, None),
    ("SELECT level.remark FROM level GROUP BY level.remark", {}, None),
]


@pytest.mark.parametrize("text,params,other", SAME)
def test_query_is_duckdb(world, twin, text, params, other):
    assert some(query(world, text, params)) == sorted(twin.sql(other or text).fetchall(), key=str)


def test_order_is_duckdb_with_null_largest(world, twin):
    for text, other in (("metres, gauge.gid", "metres NULLS LAST, gid"), ("metres DESC, gauge.gid DESC LIMIT 5", "metres DESC NULLS FIRST, gid DESC LIMIT 5")):
        assert rows(query(world, f"SELECT gauge.metres, gauge.gid FROM gauge ORDER BY gauge.{text}")) == twin.sql(f"SELECT metres, gid FROM gauge ORDER BY {other}").fetchall()


def test_semantics_switch(world):
    padded = "SELECT gauge.gid, level.lid FROM gauge LEFT JOIN level ON gauge.gid = level.gauge WHERE level.cm = 1000"
    assert rows(query(world, padded)) == [] and some(query(world, padded, semantics="reference")) == [(g, None) for g, *_ in GAUGES]
    none, lone = "SELECT MAX(level.cm) AS top FROM level WHERE level.cm > 1000", "SELECT gauge.gid FROM gauge WHERE gauge.metres = (SELECT level.cm FROM level WHERE level.lid = 1)"
    assert rows(query(world, none)) == [(None,)] and rows(query(world, none, semantics="reference")) == [] == rows(query(world, lone))
    with pytest.raises(AnalysisError):
        query(world, lone, semantics="reference")


def test_names_and_prepared(world):
    assert query(world, "SELECT gauge.gid, gauge.gid, COUNT(gauge.metres) FROM gauge GROUP BY gauge.gid").columns == ["gid", "gid_2", "count_metres"]
    p = Prepared("SELECT gauge.water FROM gauge WHERE gauge.gid = :g")
    assert [rows(p.run(world, {"g": g})) for g, *_ in GAUGES[:2]] == [[(w,)] for _, w, _ in GAUGES[:2]]
    for text in ("SELECT lid FROM level JOIN level AS other ON level.lid = other.lid", "SELECT gauge.gid FROM gauge GROUP BY gauge.gid ORDER BY gauge.metres"):
        with pytest.raises(AnalysisError):
            query(world, text)


def test_uuid_columns(spark):
    c, keys = Catalog(spark), [uuid.UUID(int=k << 64) for k in range(3)]
    dml.execute(c, "CREATE TABLE buoy (tag UUID PRIMARY KEY, moored UUID)")
    dml.execute(c, "INSERT INTO buoy VALUES (:a, :b), (:b, NULL)", dict(zip("ab", keys, strict=False)))
    at = "SELECT buoy.moored FROM buoy WHERE buoy.tag = "
    assert rows(query(c, f"{at}UUID '{keys[0]}'")) == [(str(keys[1]),)] == rows(query(c, f"{at}:k", host_params({"k": str(keys[0])})))
    assert rows(query(c, f"{at}:k", {"k": str(keys[0])})) == []
    with pytest.raises(BindError):
        host_params({"x": 1.5})


def test_time_columns(spark):
    c = Catalog(spark)
    c.attach("tide", spark.sql("SELECT id AS n, timestamp'2021-05-01 06:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS high FROM range(6)"), ("n",))
    at = "2021-05-04 06:00:00"
    for text, want in ((f"tide.high = '{at}'", [3]), (f"tide.high IN ('{at}', 'never', '2021-05-01 06:00:00')", [0, 3]), (f"tide.high > '{at}'", [4, 5]), (f"tide.high IN (SELECT tide.high FROM tide WHERE tide.high < '{at}')", [0, 1, 2]), ("tide.high IN ('never')", [])):
        assert sorted(r[0] for r in rows(query(c, f"SELECT tide.n FROM tide WHERE {text}"))) == want, text
    registry = Registry(c)
    for text in (f"tide.high = '{at}'", f"tide.high IN ('never', '{at}')", f"tide.high >= '{at}' AND tide.n = 5", f"tide.high < '{at}' AND tide.n = 5", "tide.high = 'never'", f"tide.high != '{at}'"):
        registry.subscribe(f"SELECT tide.n FROM tide WHERE REACTIVE({text})")
    assert sorted(r.sub_id for r in registry.fired({"tide": c["tide"].rows}).collect()) == [1, 2, 3, 6]


def test_changes_replay(world):
    """UPDATE, DELETE and INSERT against Python dictionaries, with plans that stay short."""
    rng, want = random.Random(2), {r[0]: r for r in LEVELS}
    for k in range(20):
        g, low = rng.randrange(1, 12), rng.randrange(-40, 90)
        if k % 4 == 3:
            out = dml.execute(world, "DELETE FROM level WHERE level.gauge = :g AND level.cm < :low", {"g": g, "low": low})
            gone = [r for r in want.values() if r[1] == g and r[2] < low]
            assert sorted(r[0] for r in rows(out.changes.parts["level"].where("__weight = -1"))) == sorted(r[0] for r in gone)
            want = {i: r for i, r in want.items() if r not in gone}
        elif k % 4 == 1:
            dml.execute(world, "INSERT INTO level (cm, gauge, lid) VALUES (:c, :g, :l)", {"c": low, "g": g, "l": 500 + k})
            want[500 + k] = (500 + k, g, low, None)
        else:
            dml.execute(world, "UPDATE level SET remark = 'moved', cm = 0 WHERE level.gauge = :g OR level.cm IN (:low, NULL)", {"g": g, "low": low})
            want = {i: (i, r[1], 0, "moved") if r[1] == g or r[2] == low else r for i, r in want.items()}
    assert some(world["level"].rows) == sorted(want.values(), key=str)
    assert len(world["level"].rows._jdf.queryExecution().analyzed().toString()) < 60_000


def test_changes_by_subquery(world):
    flooded = {g for _, g, _, r in LEVELS if r == "flood"}
    out = dml.execute(world, "UPDATE gauge SET metres = NULL WHERE gauge.metres = 15 OR gauge.gid IN (SELECT level.gauge FROM level WHERE level.remark = 'flood')")
    hit = {g for g, _, m in GAUGES if m == 15 or g in flooded}
    assert some(out.changes.parts["gauge"].select("gid", "__weight")) == sorted([(g, w) for g in hit for w in (-1, 1)], key=str)
    assert dml.execute(world, "DELETE FROM gauge WHERE gauge.gid = 0").changes.is_empty() and dml.execute(world, "DELETE FROM gauge").changes.parts["gauge"].count() == len(GAUGES)


def test_keys_stay_unique(world):
    before = some(world["gauge"].rows)
    for text in ("UPDATE gauge SET gid = 4", "UPDATE gauge SET gid = 1 WHERE gauge.gid = 2"):
        with pytest.raises(ConstraintError):
            dml.execute(world, text)
    assert some(world["gauge"].rows) == before
    dml.execute(world, "UPDATE gauge SET gid = 77 WHERE gauge.gid = 2")
    dml.update(world, dml.parse("UPDATE gauge SET gid = 1 WHERE gauge.gid = 3"), strict=False)
    assert sorted(r[0] for r in rows(world["gauge"].rows)) == [1, 1, 4, 5, 6, 7, 8, 9, 77]


def test_snapshots_are_laid_out(world):
    """Once written, a table lies in the order of its index, so that lookups skip row groups."""
    from brindle.sources import catalog

    for k in range(catalog.CHANGES):
        dml.execute(world, "INSERT INTO level VALUES (:l, :g, 1, NULL)", {"l": 900 + k, "g": k % 5})
    assert world["level"].changes < catalog.CHANGES and "PushedFilters: [IsNotNull(gauge), EqualTo(gauge,3)]" in world["level"].rows.where("gauge = 3")._jdf.queryExecution().toString()
    spread = world["level"].rows.groupBy(F.spark_partition_id()).agg(F.min("gauge"), F.max("gauge")).collect()
    assert all(a[2] <= b[1] or b[2] <= a[1] for a in spread for b in spread if a[0] < b[0])


def replay(base, delta, key):
    """One entry after another."""
    out = list(base)
    for row, weight in delta:
        if weight > 0:
            if key:
                out = [r for r in out if r[:key] != row[:key]]
            out.append(row)
        elif weight < 0 and row in out:
            out.remove(row)
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_apply_is_replay(spark, seed):
    rng = random.Random(seed)
    schema = "k long, v string"
    pick = lambda: (rng.randrange(5), rng.choice(["a", "b", None]))
    delta = [(pick(), rng.choice([1, 1, -1, 0])) for _ in range(30)]
    changes = spark.createDataFrame([(*r, 0, n, w) for n, (r, w) in enumerate(delta)], f"{schema}, {ORDER[0]} int, {ORDER[1]} long, __weight int")
    keyed = [(k, rng.choice(["a", "b", None])) for k in range(4)]
    assert sorted(rows(apply_keyed(spark.createDataFrame(keyed, schema), changes, ("k",))), key=str) == replay(keyed, delta, 1)
    bag = [pick() for _ in range(8)]
    assert sorted(rows(apply_bag(spark.createDataFrame(bag, schema), changes)), key=str) == replay(bag, delta, 0)


def test_bag_of_many(spark):
    """A row that stands a thousand times is counted, not unrolled."""
    base = spark.range(3000).select((F.col("id") % 2).alias("v"))
    minus = spark.range(700).select(F.lit(0).cast("long").alias("v"), F.lit(0).alias("__epoch"), F.col("id").alias("__seq"), F.lit(-1).alias("__weight"))
    found = apply_bag(base, minus)
    assert some(found.groupBy("v").count()) == [(0, 800), (1, 1500)]


def test_inverse_undoes(world, tmp_path):
    before, work, made = some(world["gauge"].rows), world.copy(), ZSet()
    for text in ("DELETE FROM gauge WHERE gauge.water = 'fjord'", "INSERT INTO gauge VALUES (50, 'sound', NULL)", "UPDATE gauge SET metres = 1 WHERE gauge.gid = 50 OR gauge.metres = 8"):
        made = made.extend(dml.execute(work, text).changes)
    apply_zset(world, made)
    assert some(world["gauge"].rows) == some(work["gauge"].rows) != before
    write_changes(made, str(tmp_path))
    apply_zset(world, read_changes(world, str(tmp_path), "gauge").invert(backwards=True))
    assert some(world["gauge"].rows) == before and not made.is_empty() and ZSet().is_empty()
    d = ZSet.of("gauge", world.typed("gauge", [{"gid": 1, "water": "new", "metres": 2}]), 1)
    assert some(replaced_rows(world, d).parts["gauge"].select("water", "__weight")) == sorted([("new", 1), (GAUGES[0][1], -1)])


CONDITIONS = [
    ("level.gauge = {v}", lambda r, v: r[1] == v),
    ("level.gauge = {v} AND level.cm > 20", lambda r, v: r[1] == v and r[2] > 20),
    ("level.gauge IN ({v}, 4)", lambda r, v: r[1] in (v, 4)),
    ("level.gauge = {v} OR level.gauge = 3 OR level.remark = 'ice'", lambda r, v: r[1] in (v, 3) or r[3] == "ice"),
    ("level.cm < {v}", lambda r, v: r[2] < v),
    ("{v} <= level.cm", lambda r, v: v <= r[2]),
    ("level.cm != {v}", lambda r, v: r[2] != v),
    ("level.remark > 'g'", lambda r, v: (r[3] or "") > "g"),
    ("level.cm > {v} AND level.cm < 60 OR level.gauge = 2", lambda r, v: v < r[2] < 60 or r[1] == 2),
    ("level.remark = {v}", lambda r, v: False),
]


@pytest.mark.parametrize("seed", range(4))
def test_fired_is_brute_force(world, seed):
    rng = random.Random(seed)
    registry, want, changed = Registry(world), {}, rng.sample(LEVELS, 2)
    for text, f in CONDITIONS * 2:
        v = rng.choice([1, 2, 5, 30, 80])
        _, sub = registry.subscribe(f"SELECT REACTIVE(level.cm) AS any_, level.lid FROM level WHERE REACTIVE({text.format(v=v)})")
        want[sub] = [0, 1] if any(f(r, v) for r in changed) else [0]
    found = registry.fired({"level": world.spark.createDataFrame(changed, world["level"].schema)})
    assert {r.sub_id: r.conditions for r in found.collect()} == want
    assert registry.fired({"gauge": world["gauge"].rows}).isEmpty()


def test_ranges_need_no_join(world):
    registry = Registry(world)
    for k in range(30):
        registry.subscribe("SELECT level.lid FROM level WHERE REACTIVE(level.cm > :v)", {"v": k * 5})
    found = registry.fired({"level": world["level"].rows})
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert found.count() == sum(k * 5 < max(r[2] for r in LEVELS) for k in range(30))


def test_subscriptions_life(world):
    registry, woken = Registry(world), []
    registry.wake = lambda: woken.append(1)
    text = "SELECT REACTIVE(gauge.gid = 40 OR gauge.metres > 90) AS hit, gauge.gid FROM gauge"
    (h1, s1), (h2, s2) = registry.subscribe(text), registry.subscribe(text)
    assert s1 == s2 and h1 != h2
    registry.notify(dml.execute(world, "INSERT INTO gauge VALUES (41, 'bay', 1)").changes)
    assert registry.drain() == [] and not woken
    for t in ("INSERT INTO gauge VALUES (40, 'bay', 1)", "UPDATE gauge SET metres = 91 WHERE gauge.gid = 41"):
        registry.notify(dml.execute(world, t).changes)
    assert woken == [1] and registry.drain() == [(s1, frozenset({0}))] and registry.drain() == []
    assert rows(registry.rerun(s1, {0}).select("hit").distinct()) == [(1,)] and registry.log.events[-1][2]["conditions"] == {0: 1}
    registry.notify_all()
    assert registry.unsubscribe(h1) and registry.unsubscribe(h2) and not registry.unsubscribe(h2)
    assert registry.drain() == [] and not registry.templates
    with pytest.raises(BindError):
        registry.subscribe("SELECT REACTIVE(gauge.gid = :x) AS x FROM gauge")


def test_watch_stream(world, tmp_path):
    registry = Registry(world)
    _, sub = registry.subscribe("SELECT level.lid FROM level WHERE REACTIVE(level.remark = 'ice')")
    registry.subscribe("SELECT level.lid FROM level WHERE REACTIVE(level.cm > 5000)")
    world["level"].rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = world.spark.readStream.schema(world["level"].schema).parquet(str(tmp_path / "in"))
    q = reactive.watch(stream, registry, "level", lambda df, epoch: seen.extend(rows(df)), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    assert seen == [(sub, [0])]


def test_maintain_stream(spark, tmp_path):
    schema = "k long, seq long, kind string"
    feed = [(1, 1, "put"), (2, 2, "put"), (1, 3, "gone"), (2, 4, "put"), (3, 5, "put")]
    for n, part in enumerate((feed[:3], feed[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    assert sync.maintain(stream, str(tmp_path / "out"), "k", "seq", "kind = 'gone'", str(tmp_path / "ck")).awaitTermination(120)
    assert some(sync.image(spark, str(tmp_path / "out"), "kind = 'gone'")) == [(2, 4, "put"), (3, 5, "put")]


def test_sync_streams(world):
    veto = lambda c, d: "unlucky" if d.parts["gauge"].where("gid = 13").count() else None
    client, server = sync.SyncClient(Registry(world)), sync.EchoServer(world.copy(), veto)
    add = lambda k: lambda c: dml.execute(c, "INSERT INTO gauge VALUES (:k, 'weir', 0)", {"k": k}).changes
    has = lambda c: {r[0] for r in rows(c["gauge"].rows)}
    s = client.create_stream()
    sent = [client.execute(s, add(k)) for k in (20, 13)]
    assert {20, 13} <= has(world) and client.receive(s, sent[1][0], server.handle(sent[1][1])) == "wait"
    assert client.receive(s, sent[0][0], server.handle(sent[0][1])) == "rejected" and not {20, 13} & has(world)
    now = [0.0]
    late = sync.Batcher(client, server, client.create_stream(), count=9, wait_ms=500, clock=lambda: now[0])
    assert late.execute(add(30)) == "wait" and late.tick() == "wait"
    now[0] = 0.5
    assert late.tick() == "confirmed" and late.tick() == "wait" and 30 in has(server.catalog) & has(world)


@pytest.fixture
def shop(spark):
    invoices = spark.createDataFrame([(1, 9, "invoice", None), (2, 9, "invoice", None)], "invoice_id long, customer_id long, kind string, parent_id long")
    positions = spark.createDataFrame([(1, 1, 3, 1000, 10, 20), (2, 1, 1, 333, 0, 7), (3, 2, 5, 200, 0, 0)], "position_id long, invoice_id long, quantity long, unit_price long, discount_pct long, tax_rate long")
    return commands.seeded(Catalog(spark), invoices, positions)


def test_commands(shop):
    gross = 3240 + 356  # 3 * 1000 less 10 % and 20 % tax; 333 and 7 %
    server = commands.CommandServer(shop)
    assert commands.due(shop, 1) == gross and server.handle(commands.to_text(commands.Pay(1, 1, gross))).reason is None and commands.due(shop, 1) == 0
    assert "due" in server.handle(commands.to_text(commands.Pay(2, 1, 1))).reason and "no invoice" in server.handle(commands.to_text(commands.Pay(2, 5, 1))).reason
    made = server.handle(commands.to_text(commands.Credit(50, 1, 70, 1))).changes
    assert {n: d.count() for n, d in made.parts.items()} == {"invoice": 1, "position": 2, "activity": 1} and commands.due(shop, 1) == -gross
    batch = [commands.to_text(x) for x in (commands.Credit(51, 2, 80, 2), commands.Pay(9, 2, -1))]
    assert [v.reason for v in server.handle_batch(batch)] == ["batch aborted", "an amount is positive"] and commands.due(shop, 2) == 1000
    assert server.handle("rubbish").reason.startswith("not a command")


@pytest.fixture
def repeated_lines(tmp_path):
    """Orders whose line numbers repeat, as in the larger driver tables, and a connection to the same rows."""
    con = duckdb.connect()
    lines = [(4, n, q, 10.5 * q, 0.1, 0.07) for n, q in ((7, 12.0), (3, 45.0), (7, 18.0), (5, 2.0), (5, 5.0), (4, 1.0))] + [(6, 7, 3.0, 9.99, 0.0, 0.2)] * 9
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?, ?, ?)", lines)
    con.execute("CREATE TABLE orders AS SELECT DISTINCT l_orderkey AS o_orderkey, 1::BIGINT AS o_custkey FROM lineitem")
    for name in ("lineitem", "orders"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path), con


def test_recomputed_note_of_repeated_lines(spark, repeated_lines):
    folder, con = repeated_lines
    assert some(engine_queries.server_recomputes(spark, folder)) == sorted(con.execute(engine_queries.oracle_sql()["server_recomputes"]).fetchall(), key=str)


def test_served_commands_of_repeated_lines(spark, repeated_lines):
    folder, con = repeated_lines
    assert rows(engine_queries.server_commands(spark, folder).orderBy("step")) == sorted(con.execute(engine_queries.oracle_sql()["server_commands"]).fetchall())


@pytest.mark.parametrize("name", ["invoice", "position"])
def test_seeded_tables_have_unique_keys(spark, shop, name):
    twice = {n: shop[n].rows.unionByName(shop[n].rows.limit(int(n == name))) for n in ("invoice", "position")}
    with pytest.raises(ConstraintError, match=f"{name}: a key occurs twice"):
        commands.seeded(Catalog(spark), twice["invoice"], twice["position"])


def test_client_takes_the_servers_changes(shop):
    server, client = commands.CommandServer(shop.copy()), sync.SyncClient(Registry(shop))
    assert commands.exchange(client, client.create_stream(), server, [commands.to_text(commands.Pay(1, 2, 400))]) == "confirmed"
    commands.from_text(commands.to_text(commands.Pay(2, 2, 600))).run(server.catalog)  # someone else pays the rest
    assert commands.due(shop, 2) == 600 and commands.exchange(client, client.create_stream(), server, [commands.to_text(commands.Pay(3, 2, 5))]) == "rejected" and commands.due(shop, 2) == 600


def test_refused_batch_undoes_both_sides(shop):
    server, client = commands.CommandServer(shop.copy()), sync.SyncClient(Registry(shop))
    server.handle(commands.to_text(commands.Pay(1, 2, 999)))  # someone else
    assert commands.exchange(client, client.create_stream(), server, [commands.to_text(commands.Pay(k, 2, 1)) for k in (2, 3)]) == "rejected"
    assert some(shop["payment"].rows) == [] and some(server.catalog["payment"].rows) == [(1, 2, 999)]


def test_recomputes_sends_its_bad_batch(spark, repeated_lines, monkeypatch):
    seen, handle_batch = [], commands.CommandServer.handle_batch
    monkeypatch.setattr(commands.CommandServer, "handle_batch", lambda self, texts: seen.append((texts, out := handle_batch(self, texts))) or out)
    engine_queries.server_recomputes(spark, repeated_lines[0])
    assert [[type(commands.from_text(t)).__name__ for t in texts] for texts, _ in seen] == [["Pay", "Pay"], ["Credit"]]
    assert [[v.reason for v in out] for _, out in seen] == [["batch aborted", "1 paid where 0 is due"], [None]]


def test_database_sink(world):
    path = f"file:{uuid.uuid4().hex}?mode=memory&cache=shared"
    db = sqlite3.connect(path, uri=True)
    db.execute("CREATE TABLE level (lid INTEGER PRIMARY KEY, gauge INTEGER NOT NULL, cm INTEGER, remark TEXT)")
    sink = commands.DatabaseSink(lambda: sqlite3.connect(path, uri=True), world)
    sink.apply(ZSet.of("level", world["level"].rows, 1))
    for text in ("UPDATE level SET cm = 0 WHERE level.remark = 'ice'", "DELETE FROM level WHERE level.cm < 10"):
        sink.apply(dml.execute(world, text).changes)
    assert sorted(db.execute("SELECT * FROM level").fetchall(), key=str) == some(world["level"].rows)
    bad = ZSet.of("level", world["level"].rows.limit(1).withColumns({"gauge": F.lit(None).cast("long"), "lid": F.lit(1).cast("long")}), 1)
    with pytest.raises(sqlite3.IntegrityError):
        sink.apply(ZSet.of("level", world["level"].rows, -1).extend(bad))
    assert sorted(db.execute("SELECT * FROM level").fetchall(), key=str) == some(world["level"].rows)


def test_fold_is_state_of(spark):
    rng = random.Random(1)
    lanes = {s: list(range(1, rng.randrange(2, 6))) for s in range(25)}
    answers = {(s, q): rng.random() < 0.7 for s, qs in lanes.items() for q in qs if rng.random() < 0.75}
    got = sync.fold(spark.createDataFrame([(s, q) for s, qs in lanes.items() for q in qs], "stream_id long, seq_no long"), spark.createDataFrame([(*k, v) for k, v in answers.items()], "stream_id long, seq_no long, confirmed boolean"))
    assert {r.stream_id: r.state for r in got.collect()} == {s: sync.state_of(qs, {q: answers[s, q] for q in qs if (s, q) in answers}) for s, qs in lanes.items()}


def test_settle_is_fold(spark, tmp_path):
    rng = random.Random(4)
    lanes = {s: range(1, rng.randrange(2, 6)) for s in range(12)}
    answers = {(s, q): rng.random() < 0.7 for s, qs in lanes.items() for q in qs if rng.random() < 0.8}
    parts = [[(s, q, "sent") for s, qs in lanes.items() for q in qs], [], []]
    for k, ok in answers.items():
        parts[rng.randrange(3)].append((*k, "confirmed" if ok else "rejected"))
    schema = "stream_id long, seq_no long, kind string"
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    log = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
    q = sync.settle(log).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = {(s, len(qs), state) for s, qs in lanes.items() if (state := sync.state_of(list(qs), {k: answers[s, k] for k in qs if (s, k) in answers})) != "wait"}
    assert set(rows(spark.read.parquet(str(tmp_path / "out")))) == want


def test_requirements():
    asked, told = [], []
    r = Requirements(lambda k, g: asked.append((k, g)), lambda k, s: told.append((k, s)))
    a, b = r.fetched("customers", 1), r.fetched("invoices", 1)
    q = r.derived("SELECT x", {"id": 1}, (a, b))
    assert r.fetched("customers", 1) == a and r.subscribe(q) is State.LOADING and len(asked) == 2
    assert r.ready(a, 0) and r.state(q) is State.LOADING and r.ready(b, 0) and r.state(q) is State.READY
    r.invalidate(a)
    assert not r.ready(a, 0) and r.state(q) is State.READY and r.failed(a, 1, "boom") and r.state(q) is State.READY
    r.unsubscribe(q)
    assert not r.slots
    c = r.fetched("x")
    d = r.derived("SELECT y", upstream=(c,))
    r.subscribe(d)
    r.failed(c, 0, "boom")
    assert r.state(d) is State.ERROR
    with pytest.raises(DialectError):
        r.derived("SELECT z", upstream=(("fetch", "nope", ()),))


def test_loader(world):
    fetchers, calls = Fetchers(), []

    @fetchers.register("new.levels")
    def levels(gauge):
        calls.append(gauge)
        return world.spark.createDataFrame([(700 + gauge, gauge, len(calls), None)], world["level"].schema)

    loader, jobs = Loader(world, fetchers), []
    slot = loader.fetched("new.levels", "level", gauge=5)
    both = loader.derived("SELECT level.cm FROM level WHERE level.lid = :l", {"l": 705}, (slot,))
    assert loader.fetched("new.levels", "level", gauge=5) == slot and loader.subscribe(both) is State.READY and rows(loader.rows(both)) == [(1,)]
    loader.invalidate(slot)
    assert calls == [5, 5] and rows(loader.rows(both)) == [(2,)]
    loader.run = jobs.append
    loader.invalidate(slot)
    loader.invalidate(slot)  # the first answer comes too late
    jobs[0]()
    assert rows(loader.rows(both)) == [(2,)]
    jobs[1]()
    assert rows(loader.rows(both)) == [(4,)] and loader.requirements.state(slot) is State.READY
    poor = loader.fetched("nothing", "level")
    loader.run = lambda job: job()
    assert loader.subscribe(poor) is State.ERROR
    with pytest.raises(DialectError):
        loader.fetched("new.levels", "gauge", gauge=5)


def test_fragments(world, twin):
    @dataclasses.dataclass
    class Place:
        gid: int

    part = fragments.sql("level.gauge = {g} OR level.remark = {what}", g=3, what="ice")
    text, params = fragments.sql("SELECT level.lid FROM level WHERE {part} AND level.gauge != {here.gid} AND level.gauge != {here.gid} AND level.remark != '{x}'", part=part, here=Place(7)).render()
    assert len(params) == 3 and "'{x}'" in text
    assert some(query(world, text, params)) == sorted(twin.sql("SELECT lid FROM level WHERE (gauge = 3 OR remark = 'ice') AND gauge <> 7 AND remark <> '{x}'").fetchall(), key=str)
    assert fragments.sql("{{a}} :host {v}", v=False).render() == ("{a} :host :v", {"v": 0})


def test_typed_rows(world):
    @dataclasses.dataclass
    class Gauge:
        gid: int
        water: str
        metres: int | None

    c = Catalog(world.spark)
    assert c.register(Gauge).key == ("gid",) and [f.nullable for f in c["gauge"].schema] == [False, False, True]
    assert sources.read_rows(world["gauge"].rows.orderBy("gid"), Gauge) == [Gauge(*r) for r in GAUGES]
    assert some(sources.from_json_rows(sources.to_json_rows(world["gauge"].rows), world["gauge"].schema)) == sorted(GAUGES, key=str)
    with pytest.raises(DialectError):
        sources.read_row(world["gauge"].rows, Gauge)


def test_plans(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 7).alias("g")).write.parquet(str(tmp_path / "t.parquet"))
    c = Catalog(spark).attach_parquet(str(tmp_path), "t")
    explain = lambda df: df._jdf.queryExecution().toString()
    plan = explain(query(c, "SELECT t.id FROM t WHERE t.g = 3 ORDER BY t.id DESC LIMIT 5"))
    assert "PushedFilters: [IsNotNull(g), EqualTo(g,3)]" in plan and "TakeOrderedAndProject" in plan
    assert "BroadcastHashJoin" in explain(query(c, "SELECT a.id FROM t AS a JOIN t AS b ON a.id = b.id"))


def test_plan_text(world):
    world.trace = Trace()
    text = "SELECT level.lid FROM level JOIN gauge ON level.gauge = gauge.gid WHERE level.gauge = 3 AND level.cm > 5 AND gauge.water IN (SELECT gauge.water FROM gauge)"
    query(world, text)
    assert world.trace.queries[0]["plan"] == plan_text(world, text)
    assert "scan level where level.gauge = 3 AND level.cm > 5 [range after 1 of btree (gauge, cm)]" in plan_text(world, text)
    assert access(world["gauge"], []) == "full scan"


def test_trace():
    t = Trace()
    with t.query("SELECT") as entry:
        entry["rows"] = 3
    for k in range(600):
        t.event("e", n=k)
    assert len(t.events) == 512 and len(t.queries) == 1 and t.queries[0]["rows"] == 3

"""Change logs in any order, rules with ties and malformed requests, streams with state, and sources."""

import itertools
import json

from conftest import DATA

from tidemark.operators import changelog, cluster, replay, rules
from tidemark.plans import registry
from tidemark.sources import catalog
from tidemark.streaming import streams

EVENTS = [("k", "put", 1.0, "a", {"x": "1", "y": "1", "c": "5"}, None), ("k", "patch", 2.0, "b", {"x": "2"}, None), ("k", "patch", 2.0, "a", {"y": "3"}, {"c": 1.0}), ("k", "patch", 3.0, "a", None, {"c": 1.0}), ("d", "put", 1.0, "a", {"x": "1"}, None), ("d", "delete", 2.0, "b", None, None), ("r", "delete", 1.0, "a", None, None), ("r", "patch", 2.0, "b", {"x": "9"}, None)]
SCHEMA = "id string, type string, version double, node string, value map<string,string>, adds map<string,double>"


def test_changes_merge_in_any_order(spark):
    for order in itertools.islice(itertools.permutations(EVENTS), 0, 40000, 13000):
        df = spark.createDataFrame(list(order), SCHEMA)
        assert {r.id: r.record for r in changelog.merged(df).collect()} == {"k": {"x": "2", "y": "3", "c": "5"}, "r": {"x": "9"}}
        assert [(r.id, r.total) for r in changelog.counters(df).collect()] == [("k", 7.0)]
        assert sorted(r.id for r in changelog.live(df).collect()) == ["k", "r"]
    assert changelog.merged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_writes(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "id string, n int, s string")
    assert sorted(map(tuple, changelog.updates(base, spark.createDataFrame([("b", "new")], "id string, s string"), "id").collect())) == [("a", 1, "x"), ("b", 2, "new")]
    twice = spark.createDataFrame([("b", "new", 7), ("b", None, 9), ("z", "x", 1)], "id string, s string, n int")
    assert sorted(map(tuple, changelog.updates(base, twice, "id").collect())) == [("a", 1, "x"), ("b", 7, "new")]
    some = spark.createDataFrame([("a", None, 5, ["s"]), ("b", "t", 6, [])], "id string, s string, n int, given array<string>")
    assert sorted(map(tuple, changelog.updates(base, some, "id", "given").collect())) == [("a", 1, None), ("b", 2, None)]
    assert sorted(map(tuple, changelog.altered(base, {"id": "a", "s": None, "n": 9}, "id", ["s"]).collect()), key=str) == [("a", 1, None), ("b", 2, None)]


def test_transactions_and_prefix(spark):
    rows = spark.createDataFrame([("n", 1, 5.0, "put"), ("n", 2, 5.0, "put"), ("n", 3, 5.0, "end_txn"), ("n", 4, 5.0, "put"), ("n", 5, 6.0, "put")], "node string, seq long, version double, type string")
    assert [r.txn for r in replay.transactions(rows).orderBy("seq").collect()] == [1, 1, 2, 3]
    frames = spark.createDataFrame([("a", 1, True, 10.0), ("a", 2, False, 20.0), ("a", 3, True, 30.0), ("b", 1, False, 5.0), ("c", 1, True, 7.0)], "node string, frame long, settled boolean, cursor double")
    assert {r.node: r.cursor for r in replay.durable_prefix(frames, "node").collect()} == {"a": 10.0, "b": None, "c": 7.0}


def requests(spark, rows):
    return spark.createDataFrame(rows, "req int, ip string, method string, path string, query string, headers map<string,array<string>>")


def rule(i, action="block", priority=1, **match):
    return {"id": i, "phase": "request", "action": action, "priority": priority, "match": match}


def test_rules_and_malformed_requests(spark):
    rs = [rule("six", ip=["2001:db8::/32"]), rule("four", ip=["::ffff:10.0.0.0/8"]), rule("path", path={"exact": "/admin"}), rule("multi", headers=[{"name": "X-A", "op": "equals", "value": "2"}], path={"regex": "^/m"}), rule("q", query=[{"name": "Id", "op": "prefix", "value": "a b"}]), rule("any", "log", path={"prefix": "/"})]
    got = rules.evaluate(requests(spark, [
        (1, "2001:db8::5", "GET", "/x", None, None), (2, "::ffff:10.1.2.3", "GET", "/x", None, None), (3, "bad", "get", "/%61dmin", None, {}), (4, "", None, "/m", "", {"x-a": ["1", "2"]}), (5, None, "GET", "/x", "Id=a+b9", None), (6, None, "GET", "/x", "id=a+b9", None), (7, None, None, None, None, None),
    ]), rs)
    assert {r.req: (r.action, r.rule_ids) for r in got.collect()} == {1: ("block", ["six"]), 2: ("block", ["four"]), 3: ("block", ["path"]), 4: ("block", ["multi"]), 5: ("block", ["q"]), 6: ("log", ["any"])}


def test_score_resolution(spark):
    s = lambda i, p, n, **kw: rule(i, "score", p, path={"prefix": "/"}) | {"score": n} | kw
    one = requests(spark, [(1, None, "GET", "/a", None, None)])
    r = rules.evaluate(one, [s("a", 1, 4), s("b", 2, 6), s("c", 3, 9)]).first()
    assert (r.action, r.status, r.rule_ids, r.score) == ("block", 403, ["a", "b"], 10.0)
    r = rules.evaluate(one, [s("a", 1, 4), s("sh", 1, 50, shadow=True)]).first()
    assert (r.action, r.status, r.rule_ids, r.score, r.shadow_rule_ids) == ("log", 0, [], 4.0, ["sh"])
    assert rules.evaluate(one, [s("a", 1, 4)]).count() == 0
    assert rules.evaluate(one, [s("a", 1, 40)], control={"mode": "off"}).count() == 0
    assert rules.evaluate(one, [s("a", 1, 4)], control={"scoreThreshold": 3}).first().action == "block"
    assert rules.evaluate(one, [s("a", 1, 4)], control={"scoreThreshold": "x"}).count() == 0
    # Of equal priorities the rule that is probed first comes first, wherever it is listed.
    tie = [rule("method", "log", 2, method=["GET"]), rule("query", "log", 2, query=[{"name": "q", "op": "exists"}]), rule("h2", "log", 2, headers=[{"name": "B", "op": "exists"}]), rule("h1", "log", 2, headers=[{"name": "A", "op": "exists"}]), rule("h3", "log", 2, headers=[{"name": "b", "op": "equals", "value": "2"}])]
    tie += [rule("regex", "log", 2, path={"regex": "^/a"}), rule("long", "log", 2, path={"prefix": "/a"}), rule("short", "log", 2, path={"prefix": "/"}), rule("exact", "log", 2, path={"exact": "/a"}), rule("wide", "log", 2, ip=["0.0.0.0/0"]), rule("narrow", "log", 2, ip=["9.0.0.0/8", "10.0.0.0/8"]), rule("first", "log", 1, method=["GET"])]
    all_of = requests(spark, [(1, "10.0.0.1", "GET", "/a", "q=1", {"a": ["1"], "b": ["2"]})])
    assert rules.evaluate(all_of, tie).first().rule_ids == ["first", "narrow", "wide", "exact", "short", "long", "regex", "h2", "h3", "h1", "query", "method"]


def test_classification():
    bad = rule("bad", path={"regex": "("})
    got = rules.classify([bad, bad | {"enabled": False}, rule("defer", action="serve", method=["GET"]), rule("far", method=["GET"]) | {"activation": {"regions": ["eu"]}}, rule("none")], {"region": "us"})
    assert [i for i, _ in got["invalid"]] == ["bad", "none"] and got["deferred"] == ["defer"] and got["usable"] == []


def test_interval_join_with_wide_ranges(spark):
    left = spark.createDataFrame([(n,) for n in (0, 5, 70000, 2**31, 2**32 - 1, None)], "n long")
    ranges = spark.createDataFrame([("all", 0, 2**32 - 1), ("low", 0, 65536), ("one", 70000, 70000)], "id string, low long, high long")
    assert sorted((r.n, r.id) for r in rules.interval_join(left, "n", ranges).collect()) == sorted((n, i) for n in (0, 5, 70000, 2**31, 2**32 - 1) for i, a, b in (("all", 0, 2**32 - 1), ("low", 0, 65536), ("one", 70000, 70000)) if a <= n <= b)


def test_streaming_state_and_merge(spark, tmp_path):
    rows = [("k", t) for t in (0, 10, 20, 30, 2000, 2010)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "key string, t long").coalesce(1).write.parquet(src)
    batch = [(r.allowed, r.suppressed) for r in streams.rate_windows(spark.read.parquet(src), "key", "t", 2, 1000).orderBy("time_ms").collect()]
    assert batch == [(True, 0), (True, 0), (False, 0), (False, 0), (True, 2), (True, 0)]
    stream = streams.rate_windows_stream(spark.readStream.schema("key string, t long").parquet(src), "key", "t", 2, 1000)
    assert [(r.allowed, r.suppressed) for r in streams.drain(stream, "rates", checkpoint=str(tmp_path / "c")).orderBy("time_ms").collect()] == batch
    log = str(tmp_path / "log")
    spark.createDataFrame([e[:4] for e in EVENTS], "id string, type string, version double, node string").repartition(3).write.parquet(log)
    changes = streams.subscription(spark, log, "id string, type string, version double, node string", per_trigger=1)
    out = str(tmp_path / "state")
    changes.writeStream.foreachBatch(streams.merge_into(out)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination()
    assert {r.id: r.version for r in streams.merged(spark, out).collect()} == {"k": 3.0, "d": 2.0, "r": 2.0}
    spark.createDataFrame([("k", "put", 9.0, "a"), ("z", "put", 1.0, "a")], "id string, type string, version double, node string").write.mode("append").parquet(log)
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").glob("b=*/v=*/*.parquet")}
    changes.writeStream.foreachBatch(streams.merge_into(out)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination()
    assert {r.id: r.version for r in streams.merged(spark, out).collect()} == {"k": 9.0, "d": 2.0, "r": 2.0, "z": 1.0}
    assert sum(p.exists() and p.stat().st_mtime_ns == t for p, t in untouched.items()) >= 2
    # A batch that runs again, as after a failure, gives the same rows.
    again = spark.createDataFrame([("k", "put", 11.0, "a")], "id string, type string, version double, node string")
    for _ in range(2):
        streams.merge_into(out)(again, 99)
        assert {r.id: r.version for r in streams.merged(spark, out).collect()} == {"k": 11.0, "d": 2.0, "r": 2.0, "z": 1.0}


def test_rate_windows_over_many_chunks(spark, tmp_path):
    import random

    rows = [("k", t * 7) for t in range(25000)] + [("j", 5)]
    random.Random(1).shuffle(rows)
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "key string, t long").repartition(6).write.parquet(src)
    want = {(r.key, r.time_ms): (r.allowed, r.suppressed) for r in streams.rate_windows(spark.read.parquet(src), "key", "t", 3, 1000).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    stream = streams.rate_windows_stream(spark.readStream.schema("key string, t long").parquet(src), "key", "t", 3, 1000)
    got = {(r.key, r.time_ms): (r.allowed, r.suppressed) for r in streams.drain(stream, "many", checkpoint=str(tmp_path / "c")).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_excluded_origins_are_read_again_with_every_batch(spark, tmp_path):
    log, at = str(tmp_path / "log"), str(tmp_path / "out")
    kind = "node string, seq long"
    switches = []
    seen = []
    read = lambda s: s.createDataFrame(switches, "node string, excluded boolean")
    for batch, off in (([("a", 1), ("b", 1)], []), ([("a", 2), ("b", 2)], [("b", True)]), ([("a", 3), ("b", 3)], [("b", False), ("a", True)])):
        switches[:] = off
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(log)
        rows = streams.each_period(spark.readStream.schema(kind).parquet(log), at, str(tmp_path / "c"), [lambda df, e: seen.append((e, df.count()))], read)
    assert sorted(map(tuple, rows.collect())) == [("a", 1), ("a", 2), ("b", 1), ("b", 3)] and [n for _, n in seen] == [2, 1, 1]
    changes = streams.subscription(spark, log, kind, id_value=None)
    assert changes.isStreaming
    current = spark.createDataFrame([("a", 0)], kind)
    seen = streams.with_current(current, spark.createDataFrame([("a", 1, "patch")], kind + ", type string")).orderBy("seq").collect()
    assert [r.type for r in seen] == ["put", "patch"]
    one = str(tmp_path / "keyed")
    spark.createDataFrame([("x", "put"), ("y", "put"), ("x", "end_txn")], "id string, type string").write.parquet(one)
    assert [tuple(r) for r in streams.drain(streams.subscription(spark, one, "id string, type string", id_value="x"), "keyed").collect()] == [("x", "put")]


def test_streams_without_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    kind = "node string, seq long"
    none = spark.readStream.schema(kind).parquet(str(tmp_path / "none"))
    assert streams.each_period(none, str(tmp_path / "out"), str(tmp_path / "c"), []).count() == 0
    assert streams.merged(spark, str(tmp_path / "state"), kind).count() == 0


def test_deep_chains_and_cycles(spark):
    from tidemark.operators import metrics

    rows = [(i + 1, i) for i in range(1, 200)] + [(500, 501), (501, 502), (502, 500), (600, 600), (700, 699), (301, 1)]
    frame = spark.createDataFrame(rows, "pid long, ppid long")
    assert sorted(r.pid for r in metrics.descendants(frame, 1).collect()) == [*range(2, 201), 301]
    assert sorted(r.pid for r in metrics.descendants(frame, 501).collect()) == [500, 502]
    assert metrics.descendants(frame.where("false"), 1).count() == 0


def test_running_aggregates_equal_windows(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidemark.operators.running import before, running

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.randint(0, 50) if i % 7 else None) for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, i long, v long")
    w = Window.partitionBy("k").orderBy("i")
    for n in (2, 16):
        want = sorted(map(str, frame.withColumns({"s": F.sum("v").over(w), "m": F.max("v").over(w)}).collect()))
        assert sorted(map(str, running(frame, ["k"], ["i"], {"s": ("sum", "v"), "m": ("max", "v")}, n).collect())) == want
        want = sorted(map(str, frame.withColumn("_prev_v", F.lag("v").over(w)).collect()))
        assert sorted(map(str, before(frame, ["k"], "i", ["v"], n).collect())) == want
    assert running(frame.where("false"), ["k"], ["i"], {"s": ("sum", "v")}).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n2,\n")
    assert [tuple(r) for r in catalog.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "x"), ("2", None)]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r) for r in ({"id": 1, "p": {"q": 2}}, {"id": 2})))
    assert catalog.read_json(spark, str(tmp_path / "a.json")).count() == 2
    good, bad = catalog.parsed_documents(spark.createDataFrame([('{"k": 1}',), ("{",), (None,)], "t string"), "t", "k int")
    assert good.count() == 1 and bad.count() == 2
    c = catalog.Catalog(spark)
    c.create("t", key="id", attributes=[{"name": "n", "type": "Int"}])
    merged = c.merge_schema("t", spark.createDataFrame([("a", 1, "new")], "id string, n int, extra string"))
    assert merged.columns == ["id", "n", "extra"] and c.describe_table("t").first().record_count == 1
    assert c.sql("SELECT 'data.t' AS s, count(*) AS n FROM data.t").first() == ("data.t", 1)

    def load(frames):
        for f in frames:
            yield f.assign(v="loaded")

    stored, wanted = spark.createDataFrame([("a", "stored")], "id string, v string"), spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(map(tuple, catalog.read_through(wanted, stored, "id", load).collect())) == [("a", "stored"), ("b", "loaded")]
    stat = spark.createDataFrame([("12 (a (b) c) S 1 1 1 0 -1 0 0 0 0 0 7 8 9 10 20",), ("junk",)], "value string")
    assert [tuple(r) for r in catalog.process_rows(stat).collect()] == [(12, "a (b) c", 1, 7, 8, 9, 10)]
    types = catalog.declared('type A @table { id: ID @primaryKey name: String @indexed n: [Int] full: String @computed(from: "name") b: B @relationship(from: "bId") }\ntype B { x: Float }')
    assert types["A"]["key"] == "id" and catalog.struct_of(types, "A").simpleString() == "struct<id:string,name:string,n:array<int>>"


def test_empty_cluster_tables(spark):
    none = spark.createDataFrame([], "node string, shard int, connected boolean")
    assert cluster.failover(none).count() == 0
    down = spark.createDataFrame([("a", 1, False)], "node string, shard int, connected boolean")
    assert [tuple(r) for r in cluster.failover(down).collect()] == [("a", None)]
    entries = spark.createDataFrame([("w",)], "worker string")
    assert cluster.stale(entries, spark.createDataFrame([("w", False)], "worker string, live boolean")).count() == 0


def test_drained_rows_stay_out_of_the_driver(spark, tmp_path):
    from pyspark.sql import functions as F

    src, at = str(tmp_path / "src"), str(tmp_path / "c")
    part = lambda a, b: spark.createDataFrame([(i % 3, i) for i in range(a, b)], "k int, v long").repartition(3).write.mode("append").parquet(src)
    part(0, 30)
    stream = lambda: spark.readStream.schema("k int, v long").option("maxFilesPerTrigger", 1).parquet(src)
    rows = streams.drain(stream(), "rows", checkpoint=at)
    assert rows.inputFiles() and all("-rows/" in f for f in rows.inputFiles())
    assert sorted(r.v for r in rows.collect()) == list(range(30))
    part(30, 40)
    assert sorted(r.v for r in streams.drain(stream(), "rows", checkpoint=at).collect()) == list(range(40))
    totals = streams.drain(stream().groupBy("k").agg(F.sum("v").alias("total")), "totals", "complete")
    assert totals.inputFiles() and {r.k: r.total for r in totals.collect()} == {k: sum(range(k, 40, 3)) for k in range(3)}
    steps = streams.drain(stream().groupBy("k").agg(F.sum("v").alias("total")), "steps", "update").collect()
    assert {k: max(r.total for r in steps if r.k == k) for k in range(3)} == {k: sum(range(k, 40, 3)) for k in range(3)}
    (tmp_path / "none").mkdir()
    none = spark.readStream.schema("k int").parquet(str(tmp_path / "none"))
    assert [streams.drain(d, "nothing", m).count() for d, m in ((none, "append"), (none.groupBy("k").count(), "complete"))] == [0, 0]


def test_operations_and_resources(spark):
    import pytest
    from pyspark.sql import functions as F

    from tidemark.sources.operations import Operations, Resources, TableResource

    c = catalog.Catalog(spark)
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(2000)], "id long, name string")
    c.create("t", rows)
    run = Operations(c)
    assert sorted(r.id for r in run({"operation": "search_by_id", "table": "t", "ids": list(range(500, 2500))}).collect()) == list(range(500, 2000))
    assert run({"operation": "search_by_conditions", "table": "t", "conditions": [{"attribute": "name", "value": "n7"}]}).first().id == 7
    assert run({"operation": "insert", "table": "t", "records": spark.createDataFrame([(7, "again"), (5000, "new")], "id long, name string")}).count() == 2001
    assert run({"operation": "update", "table": "t", "records": spark.createDataFrame([(7, None)], "id long, name string")}).where("name is null").first().id == 7
    assert run({"operation": "delete", "table": "t", "ids": spark.createDataFrame([(7,)], "id long")}).count() == 2000
    assert run({"operation": "clear_table", "table": "t"}).count() == 0 and c.table("t").columns == ["id", "name"]
    assert run({"operation": "sql", "sql": "SELECT count(*) AS n FROM data.t"}).first().n == 0
    run.register("names", lambda r: rows.select("name").limit(r["n"]))
    assert run({"operation": "names", "n": 3}).count() == 3
    with pytest.raises(ValueError):
        run({"operation": "drop_everything"})

    class Loud(TableResource):
        def get(self, target="/"):
            return super().get(target).withColumn("name", F.upper("name"))

    c.create("u", rows)
    at = Resources()
    at.register("/u/", Loud(c, "u"))
    assert at("GET", "/u/12").first().name == "N12" and at("GET", "/u?name=n5").first().id == 5
    for method, url in (("GET", "/v/1"), ("CONNECT", "/u/")):
        with pytest.raises(ValueError):
            at(method, url)


def test_control_row_and_checks(spark):
    import pytest

    none = spark.createDataFrame([], "id string, mode string, scoreThreshold double")
    one = rules.with_control(none, threshold=4.0)
    assert [tuple(r) for r in rules.with_control(one, mode="off").collect()] == [("control", "off", 4.0)]
    for bad in ({}, {"mode": "loud"}, {"threshold": 0}, {"threshold": float("nan")}, {"threshold": True}):
        with pytest.raises(ValueError):
            rules.with_control(none, **bad)


def test_folders_texts_and_times(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.functions import scalars as S

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    assert sorted(r.value for r in streams.drain(streams.watched_texts(spark, str(tmp_path / "in")), "texts").collect()) == ["one", "two"]
    blob = catalog.read_blobs(spark, str(tmp_path / "in")).first()
    assert blob.length == 8 and bytes(blob.content) == b"one\ntwo\n"
    times = spark.createDataFrame([("2024-01-01T00:00:00Z", None), ("2024-01-01T02:00:00.5+02:00", None), ("2024-01-01", None), ("yesterday", None), ("1704067200000", None), (None, 5.0), (None, float("nan"))], "t string, n double")
    assert [r[0] for r in times.select(S.start_time_ms(F.col("t"), F.col("n"))).collect()] == [1704067200000.0, 1704067200500.0, None, None, None, 5.0, None]
    assert spark.range(1).select(S.iso_utc(F.lit(1704067200500.0))).first()[0] == "2024-01-01T00:00:00.500Z"
    urls = spark.createDataFrame([("a",), ("ws://b:1",)], "n string").select(S.node_url(F.col("n"), F.lit(9933), F.lit(False))).collect()
    assert [r[0] for r in urls] == ["ws://a:9933", "ws://b:1"]


def test_confirmed_peers_gathers_no_pairs_before_the_shuffle(spark):
    acks = spark.createDataFrame([("a", p % 7, 5) for p in range(90)] + [("a", 99, 1), ("b", 1, 3), ("b", 1, 4), ("b", 2, 2), ("c", 1, 9), ("d", None, 9), ("e", 1, None), (None, 1, 9)], "txn string, peer long, replicated_time long")
    txns = spark.createDataFrame([("a", 2), ("b", 3), ("d", 1), ("e", 1), ("f", 0), (None, 0)], "txn string, txn_time long")
    for tasks in (None, 1, 5):
        assert sorted(map(tuple, cluster.confirmed(acks, txns, 2, tasks).collect())) == [("a", 7, True), ("b", 1, False), ("d", 0, False)]
    # From the bottom up, rows are shuffled by transaction before anything is aggregated, and never again.
    plan = registry.QUERIES["confirmed_peers"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    steps = [step for line in plan.splitlines() for step in ("Aggregate(", "Exchange", "FileScan") if f" {step}" in line or f"Hash{step}" in line]
    assert steps[-4:] == ["Exchange", "FileScan"] * 2 and set(steps[:-4]) == {"Aggregate("}, plan

"""Queries of topology and status; nodes are made of suppliers, nations and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cluster as C

from .tables import registrar, table

QUERIES, ORACLES, query = registrar()


def _nodes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("node"), (F.col("s_suppkey") % 7).alias("shard"), (F.col("s_acctbal") > 3000).alias("connected"))


@query("""WITH n AS (SELECT s_name AS node, s_suppkey % 7 AS shard, s_acctbal > 3000 AS up FROM supplier)
          SELECT a.node, coalesce(min(b.node) FILTER (WHERE b.node > a.node), min(b.node)) AS backup FROM n a LEFT JOIN n b ON a.shard = b.shard AND b.up WHERE NOT a.up GROUP BY 1""")
def failover_ring(spark, sf_dir) -> DataFrame:
    return C.failover(_nodes(spark, sf_dir))


@query("""SELECT s_suppkey % 7 AS shard, string_agg(s_name, ',' ORDER BY s_name) AS nodes FROM supplier GROUP BY 1""")
def nodes_by_shard(spark, sf_dir) -> DataFrame:
    return C.by_shard(_nodes(spark, sf_dir)).select("shard", F.array_join("nodes", ",").alias("nodes"))


@query("""SELECT n_name AS db, CASE WHEN r IS NULL THEN 'pending' WHEN r >= coalesce(t, 1) THEN 'complete' ELSE 'syncing' END AS state FROM
          (SELECT n_name, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey * 400.0 END AS t, CASE WHEN n_nationkey % 8 <> 5 THEN (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) END AS r FROM nation)
          UNION ALL SELECT r_name, CASE WHEN r_regionkey = 0 THEN 'pending' ELSE 'complete' END FROM region""")
def sync_status(spark, sf_dir) -> DataFrame:
    """Nations are required, of which some have no socket; regions have one without being required."""
    required = table(spark, sf_dir, "nation").select(F.col("n_name").alias("db"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey") * 400.0).alias("target"), "n_nationkey")
    got = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("received"))
    sockets = required.where("n_nationkey % 8 <> 5").join(got, F.col("n_nationkey") == F.col("s_nationkey")).select("db", "received")
    others = table(spark, sf_dir, "region").select(F.col("r_name").alias("db"), F.col("r_regionkey").cast("double").alias("received"))
    return C.sync_status(required.select("db", "target"), sockets.union(others))


@query("""SELECT bool_and(x) AS complete FROM (SELECT coalesce(max(s_acctbal) >= 400, FALSE) AS x FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name)""")
def sync_complete(spark, sf_dir) -> DataFrame:
    required = table(spark, sf_dir, "nation").select(F.col("n_name").alias("db"), F.lit(400.0).alias("target"), "n_nationkey")
    got = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("received"))
    return C.all_complete(C.sync_status(required, required.join(got, F.col("n_nationkey") == F.col("s_nationkey")).select("db", "received")))


@query("""SELECT l_orderkey AS txn, count(DISTINCT l_suppkey) AS peers, count(DISTINCT l_suppkey) >= 3 AS reached FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1""")
def confirmed_peers(spark, sf_dir) -> DataFrame:
    acks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn"), F.col("l_suppkey").alias("peer"), F.col("l_shipdate").alias("replicated_time"))
    txns = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn"), F.col("o_orderdate").alias("txn_time"))
    return C.confirmed(acks, txns, 3)


@query("""SELECT l_orderkey AS record, arg_min(l_suppkey, (l_extendedprice, l_linenumber, l_suppkey)) AS peer FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus = 'F' GROUP BY 1""")
def nearest_peer(spark, sf_dir) -> DataFrame:
    peers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_suppkey").alias("peer"), F.col("l_extendedprice").alias("latency"), F.struct("l_linenumber", "l_suppkey").alias("ord"), (F.col("l_returnflag") != "N").alias("connected"), (F.col("l_linestatus") != "F").alias("tried"))
    # A peer is never the record itself here; names keep the two kinds of keys apart.
    found = C.nearest_peer(peers.withColumn("record", F.concat(F.lit("r"), "record")).withColumn("peer", F.concat(F.lit("p"), "peer")), "record")
    return found.select(F.substring("record", 2, 20).cast("long").alias("record"), F.substring("peer", 2, 20).cast("long").alias("peer"))


@query("""SELECT s_suppkey AS self, n_nationkey AS peer, ((s_nationkey <> n_nationkey) AND (s_suppkey % 2 = 0) AND (n_nationkey % 4 <> 1) AND (s_suppkey % 3 > 0 OR s_suppkey % 5 = n_nationkey % 5)) OR s_suppkey % 11 = 0 AS replicate FROM supplier, nation WHERE s_nationkey % 5 = n_nationkey % 5""")
def should_replicate(spark, sf_dir) -> DataFrame:
    """Suppliers and the nations whose key leaves the same over by 5 as nodes that may replicate."""
    s = table(spark, sf_dir, "supplier").withColumn("_k", F.col("s_nationkey") % 5)
    n = table(spark, sf_dir, "nation").withColumn("_k", F.col("n_nationkey") % 5)
    pairs = s.join(n, "_k")
    text = lambda c: F.col(c).cast("string")
    entry = lambda peer, db: F.struct(peer.alias("peer"), db.alias("db"))
    none = F.lit(None).cast("string")
    pairs = pairs.select(
        "s_suppkey", "n_nationkey", text("s_nationkey").alias("self"), text("n_nationkey").alias("peer"), F.lit("data").alias("db"),
        F.when(F.col("n_nationkey") % 4 != 1, F.array(entry(text("n_nationkey"), none))).otherwise(F.array(entry(F.lit("x"), none), entry(none, F.lit("other")))).alias("routes"), F.lit(True).alias("replicates"),
        (F.col("s_suppkey") % 2 == 0).alias("is_local"), F.lit(False).alias("leads"), F.array(F.struct(F.lit("data").alias("name"), (F.col("s_suppkey") % 3 == 0).alias("sharded"))).alias("databases"),
        (F.col("s_suppkey") % 5).cast("int").alias("shard"), (F.col("n_nationkey") % 5).cast("int").alias("peer_shard"), F.array(F.struct(F.lit("data").alias("db"), (F.col("s_suppkey") % 11 == 0).alias("subscribe"))).alias("subscriptions"),
    )
    return C.should_replicate(pairs).select(F.col("s_suppkey").alias("self"), F.col("n_nationkey").alias("peer"), "replicate")


@query("""SELECT c_custkey, c_nationkey % 3 = 2 AND c_acctbal > 0 AND 5000 - c_acctbal < 120000 AS connected, CASE WHEN c_nationkey % 3 = 2 AND c_acctbal > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'none' ELSE 'up' END ELSE CASE WHEN c_custkey % 2 = 0 THEN 'down' ELSE 'none' END END AS action FROM customer""")
def connection_truth(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("state"), F.col("c_acctbal").alias("liveness"))
    truth = C.connected(F.lit(5000.0))
    return c.select("c_custkey", truth.alias("connected"), C.reconciled(F.col("c_custkey") % 2 == 0, truth).alias("action"))


@query("""SELECT c_custkey AS entry FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000) AND EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 7000)""")
def stale_entries(spark, sf_dir) -> DataFrame:
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry"), F.col("c_nationkey").alias("worker"))
    workers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("worker")).agg(F.bool_or(F.col("s_acctbal") > 7000).alias("live"))
    return C.stale(entries, workers).select("entry")


@query("""SELECT DISTINCT 'u' || (c_custkey % 40) AS url FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000) AND c_acctbal < 1000 AND c_mktsegment <> 'MACHINERY' AND 9000 - c_acctbal >= 8200""")
def wedged_entries(spark, sf_dir) -> DataFrame:
    entries = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey") % 40).alias("url"), F.col("c_nationkey").alias("worker"), (F.col("c_acctbal") >= 1000).alias("connected"), (F.col("c_mktsegment") != "MACHINERY").alias("desired"), F.lit(None).cast("double").alias("disconnected_at"), F.col("c_acctbal").alias("created_at"))
    workers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("worker")).agg(F.bool_or(F.col("s_acctbal") > 7000).alias("live"))
    return C.wedged(entries, workers, 9000.0, 8200.0)


@query("""SELECT c_nationkey AS peer, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS dbs FROM customer WHERE c_custkey % 2 = 0 AND c_acctbal > 0 AND 9000 - c_acctbal >= 5000 AND (c_custkey % 3 = 0 OR c_acctbal > 500) GROUP BY 1""")
def stalled_receivers(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("peer"), F.col("c_mktsegment").alias("db"), (F.col("c_custkey") % 2 == 0).alias("receiving"), F.col("c_acctbal").alias("last_time"), F.when(F.col("c_custkey") % 3 != 0, 500.0).alias("last_kick_time"))
    return C.stalled(rows, 9000.0, 5000.0).select("peer", F.array_join("dbs", ",").alias("dbs"))


@query("""SELECT c_custkey, round(c_acctbal * 100, 4) AS backpressure_percent, CASE WHEN c_nationkey > 1 THEN c_nationkey::DOUBLE END AS last_received, CASE WHEN c_nationkey = 1 THEN 'Copying' WHEN c_nationkey > 1 THEN 'Receiving' END AS status FROM customer""")
def status_enrichment(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    sockets = c.select(F.col("c_mktsegment").alias("db"), F.col("c_custkey").alias("peer"))
    slots = c.select(F.col("c_mktsegment").alias("db"), F.col("c_custkey").alias("peer"), F.col("c_acctbal").alias("ratio"), F.col("c_nationkey").cast("double").alias("last_received"))
    return C.enriched_status(sockets, slots).select(F.col("peer").alias("c_custkey"), F.round("backpressure_percent", 4).alias("backpressure_percent"), "last_received", "status")


@query("""SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'wss://' || s_name || ':9933' ELSE 'wss://' || s_name END AS url, s_suppkey % 4 <> 0 AS replicates FROM supplier WHERE s_suppkey % 7 <> 0""")
def route_normaliser(spark, sf_dir) -> DataFrame:
    k, name = F.col("s_suppkey"), F.col("s_name")
    rows = table(spark, sf_dir, "supplier").select(k, F.lit(None).cast("string").alias("url"), F.when(k % 7 != 0, name).alias("host"), F.when(k % 3 == 0, 9933).alias("port"), F.lit(None).cast("boolean").alias("replicates"), (k % 4 == 0).alias("subscribed"), F.lit(None).cast("string").alias("text"))
    return C.normal_routes(rows).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("name") == F.col("s_name")).select(F.col("s_suppkey").alias("k"), "name", "url", "replicates")


@query("""SELECT s_nationkey AS node, bool_or(s_suppkey % 3 = 0) AS directional, CASE WHEN bool_or(s_suppkey % 3 = 0) THEN coalesce(string_agg(DISTINCT s_name, ',' ORDER BY s_name) FILTER (WHERE s_suppkey % 3 = 1 OR s_suppkey % 6 = 0), '') END AS sends_to FROM supplier GROUP BY 1""")
def self_record_fold(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("node"), F.col("s_name").alias("peer"), (k % 3 == 1).alias("plain"), F.when(k % 3 == 0, k % 6 == 0).alias("sends"), F.when(k % 3 == 0, k % 6 != 0).alias("receives"))
    return C.fold_self(rows).select("node", "directional", F.array_join("sends_to", ",").alias("sends_to"))


@query("""WITH s AS (SELECT event_type AS db, min(event_id // 1000) AS f FROM events GROUP BY 1), p AS (SELECT DISTINCT event_id // 1000 AS poll FROM events)
          SELECT poll, db FROM p JOIN s ON poll >= f UNION SELECT poll, 'base' FROM p""")
def required_ratchet(spark, sf_dir) -> DataFrame:
    seen = table(spark, sf_dir, "events").select(F.expr("event_id div 1000").alias("poll"), F.col("event_type").alias("db"))
    return C.required_ratchet(spark.createDataFrame([("base",)], "db string"), seen)


@query("""SELECT event_type AS db, event_id AS poll, max(value) OVER (PARTITION BY event_type ORDER BY event_id) + 30 AS deadline FROM events""")
def stall_deadline(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("db"), F.col("event_id").alias("poll"), F.col("value").alias("arrived"))
    return C.stall_deadline(rows, 30.0).select("db", "poll", "deadline")


@query("""SELECT n_nationkey AS peer, CASE WHEN s.c > 4 THEN s.c END AS answer, CASE WHEN s.c IS NULL THEN 'no answer' WHEN s.c <= 4 THEN 'refused' END AS error FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""")
def peer_gather(spark, sf_dir) -> DataFrame:
    answers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("peer")).agg(F.count(F.lit(1)).alias("c"))
    answers = answers.select("peer", F.when(F.col("c") > 4, F.col("c")).alias("answer"), F.when(F.col("c") <= 4, "refused").alias("error"))
    return C.gathered(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("peer")), answers)

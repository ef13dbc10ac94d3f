"""Queries of the change-log engine over events taken as changes of users' records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import changelog, replay
from tidemark.sources.shared import shared_path
from tidemark.streaming import streams

from .tables import registrar, table

QUERIES, ORACLES, query = registrar()

#: Events as changes: a record a user, three nodes, versions in ms that repeat across nodes.
LOG = """SELECT user_id::VARCHAR AS id, CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'patch' END AS type,
         (epoch_us(ts) // 1000000)::DOUBLE AS version, 'n' || (event_id % 3) AS node, event_id AS seq, value, event_type, event_id,
         (event_id * 10)::DOUBLE AS local_time FROM events"""


def log(spark, sf_dir) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "error", "delete").otherwise("patch")
    value = F.when(F.col("event_type") == "signup", F.create_map(F.lit("a"), F.col("value").cast("string"), F.lit("b"), F.lit("0"))).when(F.col("event_type") == "click", F.create_map(F.lit("a"), F.col("value").cast("string"))).when(F.col("event_type") == "view", F.create_map(F.lit("b"), F.col("value").cast("string")))
    adds = F.when(F.col("event_type") == "purchase", F.create_map(F.lit("c"), (F.col("event_id") % 10).cast("double")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), kind.alias("type"), F.floor(ms / 1000).cast("double").alias("version"), F.concat(F.lit("n"), F.col("event_id") % 3).alias("node"), F.col("event_id").alias("seq"), value.alias("value"), adds.alias("adds"),
        (F.col("event_id") * 10).cast("double").alias("local_time"), (F.col("event_id") % 4).cast("int").alias("flags"), F.concat(F.lit("t"), F.col("event_id") % 5).alias("tbl"),
        F.when(F.col("event_id") % 6 == 0, F.array(F.lit("p2"))).alias("residency"), F.when(F.col("event_id") % 12 == 0, F.array(F.lit("p2"))).alias("prev_residency"), "event_id", "event_type",
    )


@query(f"""SELECT id, type, version, node FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, node DESC) AS r FROM ({LOG})) WHERE r = 1""")
def lww_latest(spark, sf_dir) -> DataFrame:
    return changelog.latest(log(spark, sf_dir)).select("id", "type", "version", "node")


@query(f"""SELECT id, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, node DESC) AS r FROM ({LOG})) WHERE r = 1 AND type <> 'delete'""")
def tombstone_live(spark, sf_dir) -> DataFrame:
    return changelog.live(log(spark, sf_dir)).select("id", "version")


@query(f"""SELECT count(*) AS record_count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, node DESC) AS r FROM ({LOG})) WHERE r = 1 AND type <> 'delete'""")
def live_record_count(spark, sf_dir) -> DataFrame:
    return changelog.record_count(log(spark, sf_dir))


SINCE = f"""l AS ({LOG}), base AS (SELECT id, max((version, node)) AS b FROM l WHERE type IN ('put', 'delete') GROUP BY 1),
            since AS (SELECT l.* FROM l LEFT JOIN base USING (id) WHERE (b IS NULL OR (version, node) >= b) AND type <> 'delete')"""


@query(f"""WITH {SINCE}, f AS (SELECT id, version, node, 'a' AS field, value::VARCHAR AS v FROM since WHERE event_type IN ('signup', 'click')
           UNION ALL SELECT id, version, node, 'b', CASE WHEN event_type = 'signup' THEN '0' ELSE value::VARCHAR END FROM since WHERE event_type IN ('signup', 'view'))
           SELECT id, field, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY id, field ORDER BY version DESC, node DESC) AS r FROM f) WHERE r = 1""")
def lww_patch_merge(spark, sf_dir) -> DataFrame:
    return changelog.merged_fields(log(spark, sf_dir))


@query(f"""WITH {SINCE} SELECT id, 'c' AS field, sum(event_id % 10)::DOUBLE AS total FROM since WHERE event_type = 'purchase' GROUP BY 1""")
def counter_merge(spark, sf_dir) -> DataFrame:
    return changelog.counters(log(spark, sf_dir))


@query(f"""WITH {SINCE}, s AS (SELECT id, arg_max(event_id % 7, (version, node)) AS s, max((version, node)) AS put_at FROM since WHERE event_type = 'signup' GROUP BY 1)
           SELECT id, 'c' AS field, (coalesce(any_value(s), 0) + coalesce(sum(event_id % 10) FILTER (WHERE put_at IS NULL OR (version, node) > put_at), 0))::DOUBLE AS total
           FROM since LEFT JOIN s USING (id) WHERE event_type = 'purchase' GROUP BY 1""")
def counter_set_then_add(spark, sf_dir) -> DataFrame:
    """A signup sets the counter, purchases add to it; what came before the signup is gone."""
    rows = log(spark, sf_dir)
    signup = F.map_concat("value", F.create_map(F.lit("c"), (F.col("event_id") % 7).cast("string")))
    return changelog.counters(rows.withColumn("value", F.when(F.col("event_type") == "signup", signup).otherwise(F.col("value"))))


@query("""SELECT c_custkey::VARCHAR AS id, 'put' AS type, c_acctbal AS version, 'n' || (c_nationkey % 3) AS node, c_name AS name, c_mktsegment AS segment FROM customer""")
def copies_as_puts(spark, sf_dir) -> DataFrame:
    """Records sent as a copy are puts that keep the origin of their last write."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    puts = changelog.as_puts(c, "c_custkey", F.col("c_acctbal"), F.concat(F.lit("n"), F.col("c_nationkey") % 3))
    return puts.select("id", "type", "version", "node", F.col("value")["c_name"].alias("name"), F.col("value")["c_mktsegment"].alias("segment"))


@query("""SELECT 'p' || p_partkey AS tbl, p_size AS rank, p_partkey % 13 AS made, row_number() OVER (ORDER BY p_size, p_partkey % 13, 'p' || p_partkey) AS place FROM part""")
def copy_order(spark, sf_dir) -> DataFrame:
    p = F.col("p_partkey")
    return replay.copy_order(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), p).alias("tbl"), F.col("p_size").alias("rank"), (p % 13).alias("made")))


@query(f"""SELECT id, count(*) FILTER (WHERE type = 'put') AS puts, count(*) AS n FROM (SELECT id, type FROM ({LOG}) UNION ALL SELECT c_custkey::VARCHAR, 'put' FROM customer) GROUP BY 1""")
def subscribe_with_current(spark, sf_dir) -> DataFrame:
    """Customers as current state, then the changes of the log."""
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return streams.with_current(current, log(spark, sf_dir).select("id", "type")).groupBy("id").agg(F.count_if(F.col("type") == "put").alias("puts"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT id, type, version, node FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, node DESC) AS r FROM ({LOG})) WHERE r = 1""")
def stream_merge(spark, sf_dir) -> DataFrame:
    """The log as a stream, merged batch by batch into buckets of winning changes, read through the last pointer."""
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    kind = F.when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "error", "delete").otherwise("patch")
    rows = e.select(F.col("user_id").cast("string").alias("id"), kind.alias("type"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).cast("double").alias("version"), F.concat(F.lit("n"), F.col("event_id") % 3).alias("node"))
    path = shared_path(spark, "merged")
    rows.writeStream.foreachBatch(streams.merge_into(path, buckets=8)).trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").start().awaitTermination()
    return streams.merged(spark, path, rows.schema)


@query("""SELECT event_id, 'n' || (event_id % 3) AS node FROM events WHERE event_id % 3 NOT IN (SELECT n_nationkey % 3 FROM nation WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey = 4))""")
def stream_exclusions(spark, sf_dir) -> DataFrame:
    """The log as a stream; origins that a table switches off, read again with every batch, are left out."""
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")

    def switches(session):
        return table(session, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey") % 3).alias("node"), (F.col("n_nationkey") == 4).alias("excluded"))

    path = shared_path(spark, "kept")
    return streams.each_period(e.select("event_id", F.concat(F.lit("n"), F.col("event_id") % 3).alias("node")), f"{path}/rows", f"{path}/checkpoint", [], switches)


@query("""SELECT event_type AS metric, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def stream_usage_hook(spark, sf_dir) -> DataFrame:
    """A hook rolls every micro-batch up into files of its own; usage is their sum."""
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    path = shared_path(spark, "usage")

    def record(rows, epoch):
        rows.groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{path}/used/_epoch={epoch}")

    streams.each_period(e.select("event_type", "value"), f"{path}/rows", f"{path}/checkpoint", [record])
    used = spark.read.schema("metric string, n long, total double").parquet(f"{path}/used")
    return used.groupBy("metric").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query(f"""SELECT seq FROM ({LOG}) WHERE event_id % 3 <> 2 OR event_id % 5 = 1""")
def identity_tie_dedupe(spark, sf_dir) -> DataFrame:
    """Changes that a local side lacks, which holds all of node n2's but those of event ids with 1 left over by 5."""
    rows = log(spark, sf_dir).withColumn("id", F.concat_ws(":", "id", "seq"))
    return changelog.without_ties(rows, rows.where("node = 'n2' and event_id % 5 <> 1")).select("seq")


@query(f"""WITH l AS ({LOG}), c AS (SELECT node, quantile_disc(version, 0.25) AS cursor FROM l GROUP BY 1),
           f AS (SELECT l.node, min(seq) AS first FROM l JOIN c USING (node) WHERE version > cursor GROUP BY 1)
           SELECT seq FROM l LEFT JOIN f USING (node) WHERE NOT ((first IS NULL OR seq < first) AND event_id % 2 = 0)""")
def leading_duplicate_skip(spark, sf_dir) -> DataFrame:
    """Half of the log is held already; of it, only what comes before an origin's cursor is passed is skipped."""
    rows = log(spark, sf_dir).withColumn("id", F.concat_ws(":", "id", "seq"))
    cursors = rows.groupBy("node").agg(F.expr("percentile_disc(0.25) within group (order by version)").alias("cursor"))
    return changelog.skip_leading(rows, cursors, rows.where("event_id % 2 = 0")).select("seq")


@query(f"""SELECT seq FROM ({LOG}) WHERE event_id % 2 = 0 AND event_id % 5 NOT IN (1, 3) AND node <> 'n1'
           AND (node <> 'n2' OR (100 < local_time AND local_time < 50000))""")
def replay_filter(spark, sf_dir) -> DataFrame:
    rows = replay.not_from(replay.wanted_tables(replay.replicable(log(spark, sf_dir)), ["t1", "t3"], True), "n1", "n0")
    ranges = spark.createDataFrame([("n2", 100.0, 50000.0)], "node string, start double, end double")
    return replay.in_ranges(rows, ranges).select("seq")


@query(f"""SELECT seq FROM ({LOG}) WHERE NOT (event_id % 5 = 2 OR (event_id % 5 = 4))""")
def route_exclusions(spark, sf_dir) -> DataFrame:
    routes = spark.createDataFrame([("p1", None, ["t2"]), (None, "data", ["t4"]), ("p9", None, ["t0"]), (None, "other", ["t1"])], "peer string, db string, excluded array<string>")
    return replay.not_excluded(log(spark, sf_dir).withColumn("db", F.lit("data")), routes, "p1").select("seq")


@query(f"""SELECT seq, CASE WHEN event_id % 6 = 0 AND type IN ('put', 'patch') THEN 'invalidate' ELSE type END AS type FROM ({LOG})
           WHERE NOT (event_id % 12 = 0 AND type IN ('put', 'patch'))""")
def residency_invalidate(spark, sf_dir) -> DataFrame:
    return replay.for_residency(log(spark, sf_dir), "p1").select("seq", "type")


@query(f"""WITH l AS ({LOG}), o AS (SELECT min(coalesce(local_time, version)) FILTER (WHERE type <> 'put') AS oldest, max(local_time) / 64 AS cutoff FROM l),
           c AS (SELECT id AS node, min(local_time) AS start FROM l GROUP BY 1) SELECT node, start, start > 0 AND start < greatest(oldest, cutoff) AS full_copy FROM c, o""")
def retention_fallback(spark, sf_dir) -> DataFrame:
    rows = log(spark, sf_dir)
    oldest = replay.oldest_retained(rows.where("type <> 'put'")).join(rows.agg((F.max("local_time") / 64).alias("cutoff")))  # one row each
    cursors = rows.groupBy(F.col("id").alias("node")).agg(F.min("local_time").alias("start"))
    return cursors.join(F.broadcast(oldest)).select("node", "start", replay.too_old(F.col("start"), F.col("oldest"), F.col("cutoff")).alias("full_copy"))


@query(f"""WITH l AS ({LOG}), m AS (SELECT *, floor(version / 600) AS v FROM l), n AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL OR lag(v) OVER w <> v THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY node ORDER BY seq))
           SELECT seq, node, sum(new) OVER (PARTITION BY node ORDER BY seq)::BIGINT AS txn FROM n""")
def txn_grouping(spark, sf_dir) -> DataFrame:
    return replay.transactions(log(spark, sf_dir).withColumn("version", F.floor(F.col("version") / 600))).select("seq", "node", "txn")


@query(f"""WITH l AS ({LOG}), b AS (SELECT node, min(seq) FILTER (WHERE value > 480) AS stop FROM l GROUP BY 1)
           SELECT b.node, max(version) AS cursor FROM b LEFT JOIN l ON l.node = b.node AND (stop IS NULL OR seq < stop) GROUP BY 1""")
def durable_prefix(spark, sf_dir) -> DataFrame:
    frames = table(spark, sf_dir, "events").select(F.concat(F.lit("n"), F.col("event_id") % 3).alias("node"), F.col("event_id").alias("frame"), (F.col("value") <= 480).alias("settled"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).cast("double").alias("cursor"))
    return replay.durable_prefix(frames, "node")


@query(f"""SELECT seq, max(value) OVER (PARTITION BY node ORDER BY seq) AS high FROM ({LOG})""")
def monotone_watermark(spark, sf_dir) -> DataFrame:
    rows = log(spark, sf_dir).drop("value").join(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "value"), "seq")
    return replay.monotone_watermark(rows, "node", "value").select("seq", "high")


@query("""SELECT node, CASE WHEN s = 1 THEN 0 ELSE s END AS start FROM (SELECT user_id::VARCHAR AS node, greatest(coalesce(max(event_id) FILTER (WHERE event_type = 'click'), 0)::DOUBLE, 40.0::DOUBLE, coalesce(max(event_id) FILTER (WHERE event_type = 'view'), 0)::DOUBLE) AS s FROM events GROUP BY 1)""")
def origin_starts(spark, sf_dir) -> DataFrame:
    of = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("seq"))).cast("double")
    cursors = log(spark, sf_dir).groupBy(F.col("id").alias("node")).agg(of("click").alias("seq_id"), of("view").alias("last_txn"))
    return replay.starts(cursors, 40.0)


@query(f"""WITH l AS ({LOG}), m AS (SELECT max(local_time) AS m FROM l)
           SELECT id, max(version) AS version FROM (SELECT id, version FROM l, m WHERE local_time < m * 0.8 AND type <> 'delete' UNION ALL SELECT id, version FROM l, m WHERE local_time >= m * 0.7) GROUP BY 1""")
def snapshot_log_handoff(spark, sf_dir) -> DataFrame:
    """A snapshot of the records up to four fifths of the log and the log from an anchor before that, merged."""
    rows = log(spark, sf_dir)
    end = rows.agg(F.max("local_time")).first()[0] or 0.0
    both = replay.handoff(rows.where((F.col("local_time") < end * 0.8) & (F.col("type") != "delete")).withColumn("type", F.lit("put")), rows, end * 0.7)
    return changelog.latest(both).select("id", "version")


@query(f"""SELECT id, seq FROM ({LOG}) WHERE event_id % 4 = 0 OR local_time * 2 > 100000""")
def expiration(spark, sf_dir) -> DataFrame:
    rows = log(spark, sf_dir).withColumn("expires_at", F.when(F.col("event_id") % 4 != 0, F.col("local_time") * 2))
    return changelog.unexpired(rows, 100000.0).select("id", "seq")


@query("""SELECT c_custkey, c_nationkey, NULL::VARCHAR AS c_name, 'invalidate' AS type FROM customer""")
def invalidate_projection(spark, sf_dir) -> DataFrame:
    return changelog.invalidated(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name"), "c_custkey", ["c_nationkey"])


@query("""SELECT e.event_id, o.event_id AS asof_event_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup') o ON e.user_id = o.user_id AND e.ts >= o.ts WHERE e.event_type = 'purchase'""")
def asof_signup(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return changelog.nearest(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'signup'").select("user_id", "ts", "event_id"), "user_id", "ts", ["event_id"]).select("event_id", "asof_event_id")


@query("""SELECT 'n' || (event_id % 3) AS source, max(value) AS last FROM events WHERE event_id % 4 <> 0 GROUP BY 1""")
def last_txn_per_source(spark, sf_dir) -> DataFrame:
    source = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("n"), F.col("event_id") % 3))
    e = table(spark, sf_dir, "events").select(F.array(F.struct(source.alias("id"), F.col("value").alias("time"))).alias("items"))
    return replay.last_per_source(e)


@query("""WITH b AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS position, l_partkey::VARCHAR AS blob, l_quantity FROM lineitem)
          SELECT id, position::INT AS position, blob FROM b WHERE l_quantity > 48""")
def damaged_blobs(spark, sf_dir) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("s"))
    return replay.damaged_blobs(rows.select("id", F.transform("s", lambda x: F.struct(x["l_partkey"].cast("string").alias("name"), (x["l_quantity"] <= 48).alias("complete"))).alias("blobs")))


@query("""WITH h AS (SELECT l_orderkey AS id, l_suppkey % 4 AS ord, bool_and(l_quantity < 40) AS ok FROM lineitem GROUP BY 1, 2),
          g AS (SELECT id, min(ord) AS ord FROM h WHERE ok GROUP BY 1)
          SELECT DISTINCT l_orderkey AS id, 'p' || g.ord AS peer FROM lineitem LEFT JOIN g ON g.id = l_orderkey""")
def blob_repair(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 4).alias("ord"), (F.col("l_quantity") < 40).alias("complete"))
    return replay.repair_sources(li.select("id"), li.withColumn("peer", F.concat(F.lit("p"), F.col("ord"))))

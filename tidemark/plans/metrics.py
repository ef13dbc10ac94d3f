"""Queries of metrics, metering, profiling and streams over events and derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.sources import catalog
from tidemark.streaming import streams

from .tables import registrar, table

QUERIES, ORACLES, query = registrar()


@query("""SELECT time_bucket(INTERVAL '3600 seconds', ts) AS period, event_type, count(*) AS count, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def metric_rollup(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return M.rollup(rows, "t", "value", ["event_type"], "3600 seconds").select(F.col("period").cast("timestamp_ntz").alias("period"), "event_type", "count", F.round("mean", 6).alias("mean"))


def _actions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    metric = F.when(F.col("event_type") == "view", "db-read").when(F.col("event_type") == "purchase", "db-write").when(F.col("event_type") == "click", "db-message").otherwise("cpu-usage")
    return e.select(metric.alias("metric"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("system").alias("path"), "value", (F.col("user_id") % 10).alias("account"))


@query("""WITH a AS (SELECT user_id % 10 AS account, event_type, event_id, value FROM events)
          SELECT account, count(*) FILTER (WHERE event_type = 'view')::DOUBLE AS reads, count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE AS writes,
          round(coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0), 4) AS read_bytes, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS write_bytes,
          count(*) FILTER (WHERE event_type = 'click')::DOUBLE AS messages, round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0), 4) AS message_bytes,
          round(coalesce(sum(value) FILTER (WHERE event_type IN ('signup', 'error') AND event_id % 2 = 0), 0) / 3600, 6) AS cpu_time FROM a GROUP BY 1""")
def metering_rollup(spark, sf_dir) -> DataFrame:
    rolled = _actions(spark, sf_dir).groupBy("account", "metric", "path").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"))
    out = M.metering(rolled, ["account"])
    return out.select("account", "reads", "writes", *[F.round(c, 4).alias(c) for c in ("read_bytes", "write_bytes")], "messages", F.round("message_bytes", 4).alias("message_bytes"), F.round("cpu_time", 6).alias("cpu_time"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
          SELECT event_type, any_value(n) AS count, round(avg(value), 6) AS mean, min(value) FILTER (WHERE i = least(n - 1, floor(n * 0.5))) AS p50,
          min(value) FILTER (WHERE i = least(n - 1, floor(n * 0.95))) AS p95, min(value) FILTER (WHERE i = least(n - 1, floor(n * 0.99))) AS p99 FROM r GROUP BY 1""")
def latency_percentiles(spark, sf_dir) -> DataFrame:
    return M.index_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumn("mean", F.round("mean", 6))


@query("""WITH RECURSIVE s AS (SELECT user_id, event_type = 'error' AS paused, value / 100 AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
          f AS (SELECT user_id, 0::BIGINT AS i, 0.0::DOUBLE AS r FROM (SELECT DISTINCT user_id FROM events) UNION ALL
                SELECT f.user_id, s.i, (f.r * 30 + CASE WHEN paused THEN d ELSE 0 END) / (30 + d) FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
          SELECT user_id, round(arg_max(r, i), 9) AS ratio FROM f GROUP BY 1""")
def backpressure_ratio(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("paused"), (F.col("value") / 100).alias("duration"))
    return M.backpressure(rows, "user_id", "event_id").select("user_id", F.round("ratio", 9).alias("ratio"))


FRAMES = """fr AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
    CASE WHEN l_partkey % 3 = 0 THEN '/app/f' || (l_partkey % 20) WHEN l_partkey % 3 = 1 THEN '/pkg/g' || (l_partkey % 20) ELSE 'native' END AS frame FROM lineitem),
  firsts AS (SELECT id, min(pos) FILTER (WHERE starts_with(frame, '/app/')) AS u, min(pos) FILTER (WHERE starts_with(frame, '/pkg/')) AS p FROM fr GROUP BY 1),
  w AS (SELECT fr.*, u, p, id % 7 + 1 AS value FROM fr JOIN firsts USING (id) WHERE u IS NULL OR pos <= u)"""


def _samples(spark, sf_dir) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    part = lambda x: x["l_partkey"]
    named = lambda x: F.when(part(x) % 3 == 0, F.concat(F.lit("/app/f"), part(x) % 20)).when(part(x) % 3 == 1, F.concat(F.lit("/pkg/g"), part(x) % 20)).otherwise("native")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("s"))
    return rows.select("id", (F.col("id") % 7 + 1).alias("value"), F.transform("s", named).alias("frames"))


@query(f"""WITH {FRAMES}, c AS (SELECT frame, sum(value) AS hits FROM w WHERE (pos = p AND starts_with(frame, '/pkg/')) OR (pos = u AND (p IS NULL OR p > u)) GROUP BY 1)
           SELECT frame AS location, round(hits * 0.05, 6) AS seconds FROM c WHERE hits > 100""")
def cpu_attribution(spark, sf_dir) -> DataFrame:
    return M.attribute_cpu(_samples(spark, sf_dir), "/app/", "/pkg/")[1].select("location", F.round("seconds", 6).alias("seconds"))


@query(f"""WITH {FRAMES} SELECT round(sum(value) FILTER (WHERE pos = u) * 0.05, 6) AS "user", round(sum(value) FILTER (WHERE starts_with(frame, '/pkg/')) * 0.05, 6) AS platform FROM w""")
def cpu_totals(spark, sf_dir) -> DataFrame:
    return M.attribute_cpu(_samples(spark, sf_dir), "/app/", "/pkg/")[0].select(F.round("user", 6).alias("user"), F.round("platform", 6).alias("platform"))


@query("""WITH s AS (SELECT l_orderkey AS id, l_orderkey % 7 + 1 AS value, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem)
          SELECT id, value, string_agg(n_name || ':' || (p_partkey % 100), '|' ORDER BY pos) AS frames FROM s JOIN part ON p_partkey = l_partkey JOIN nation ON n_nationkey = p_size % 25 GROUP BY 1, 2""")
def star_samples(spark, sf_dir) -> DataFrame:
    """Order lines as stacks of locations, which lie in functions, which lie in files."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    stacks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("s"))
    samples = stacks.select("id", (F.col("id") % 7 + 1).alias("value"), F.transform("s", lambda x: x["l_partkey"]).alias("location_ids"))
    part = table(spark, sf_dir, "part")
    locations = part.select(F.col("p_partkey").alias("location_id"), F.col("p_size").alias("function_id"), (F.col("p_partkey") % 100).alias("line"))
    functions = part.select(F.col("p_size").alias("function_id"), (F.col("p_size") % 25).alias("file_id")).distinct()
    strings = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("string_id"), F.col("n_name").alias("text"))
    return M.star_samples(samples, locations, functions, strings).select("id", "value", F.array_join("frames", "|").alias("frames"))


@query("""SELECT event_id % 4 AS gpu, user_id AS pid, floor(value)::BIGINT AS sm FROM events WHERE event_type <> 'error' AND event_id % 50 <> 0""")
def gpu_lines(spark, sf_dir) -> DataFrame:
    """Events as lines of a process monitor, headings and idle rows among them."""
    used = F.when(F.col("event_type") == "error", "-").otherwise(F.floor("value").cast("string"))
    line = F.when(F.col("event_id") % 50 == 0, "# gpu pid type sm").otherwise(F.concat_ws("   ", F.lit(" "), F.col("event_id") % 4, "user_id", F.lit("C"), used, F.lit("-")))
    return catalog.gpu_rows(table(spark, sf_dir, "events").select(line.alias("value")))


@query("""WITH RECURSIVE t(pid) AS (SELECT c_custkey FROM customer WHERE c_custkey // 3 = 5 AND c_custkey <> 5 UNION SELECT c.c_custkey FROM customer c JOIN t ON c.c_custkey // 3 = t.pid AND c.c_custkey <> c.c_custkey // 3) SELECT pid FROM t""")
def process_closure(spark, sf_dir) -> DataFrame:
    """Customers as processes, the parent of k being k div 3."""
    return M.descendants(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.expr("c_custkey div 3").alias("ppid")), 5)


@query("""SELECT round(coalesce(sum(value), 0) / 100 * 60, 6) AS gpu_seconds FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def gpu_seconds(spark, sf_dir) -> DataFrame:
    usage = table(spark, sf_dir, "events").select(F.col("user_id").alias("pid"), F.col("value").alias("sm"))
    return M.gpu_seconds(usage, table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("pid")), 60.0).select(F.round("gpu_seconds", 6).alias("gpu_seconds"))


@query("""WITH s AS (SELECT user_id % 5 AS grp, date_trunc('day', ts) AS day, sum(event_id % 100)::DOUBLE / 100 AS cpu FROM events GROUP BY 1, 2),
          d AS (SELECT grp, day, round(cpu - lag(cpu) OVER (PARTITION BY grp ORDER BY day), 6) AS delta FROM s) SELECT grp, day, delta FROM d WHERE delta > 0.001""")
def child_cpu_delta(spark, sf_dir) -> DataFrame:
    zero = F.lit(0)
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("grp"), F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day"), (F.col("event_id") % 100).alias("utime"), zero.alias("stime"), zero.alias("cutime"), zero.alias("cstime"))
    return M.child_cpu(rows, "grp", "day").select("grp", "day", F.round("delta", 6).alias("delta"))


@query("""WITH f AS (SELECT event_type, min(ts) AS first FROM events WHERE value > 0 GROUP BY 1)
          SELECT event_type, time_bucket(INTERVAL '43200 seconds', ts) AS "window", round(sum(value) / 1e6 / 43200, 12) AS mb_s FROM events JOIN f USING (event_type) WHERE ts >= first GROUP BY 1, 2""")
def windowed_throughput(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return M.throughput(rows, "event_type", "t", "value", "43200 seconds").select("event_type", F.col("window").cast("timestamp_ntz").alias("window"), F.round("mb_s", 12).alias("mb_s"))


def _rates(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"))
    return streams.rate_windows(rows, "event_type", "time_ms", 5, 3600_000)


@query("""WITH RECURSIVE e AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events),
          w AS (SELECT key, i, t, t AS opened, 1 AS n FROM e WHERE i = 1 UNION ALL
                SELECT e.key, e.i, e.t, CASE WHEN e.t - opened >= 3600000 THEN e.t ELSE opened END, CASE WHEN e.t - opened >= 3600000 THEN 1 ELSE n + 1 END FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1)
          SELECT key, t AS time_ms, n <= 5 AS allowed FROM w""")
def rate_window(spark, sf_dir) -> DataFrame:
    return _rates(spark, sf_dir).select("key", "time_ms", "allowed")


@query("""WITH RECURSIVE e AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events),
          w AS (SELECT key, i, t, t AS opened, 1 AS n, 0 AS said FROM e WHERE i = 1 UNION ALL
                SELECT e.key, e.i, e.t, CASE WHEN e.t - opened >= 3600000 THEN e.t ELSE opened END, CASE WHEN e.t - opened >= 3600000 THEN 1 ELSE n + 1 END, CASE WHEN e.t - opened >= 3600000 THEN greatest(n - 5, 0) ELSE 0 END FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1)
          SELECT key, sum(said)::BIGINT AS suppressed, count(*) FILTER (WHERE n > 5) AS refused FROM w GROUP BY 1""")
def rate_suppressed(spark, sf_dir) -> DataFrame:
    return _rates(spark, sf_dir).groupBy("key").agg(F.sum("suppressed").alias("suppressed"), F.count_if(~F.col("allowed")).alias("refused"))


def _arriving(spark, sf_dir) -> DataFrame:
    """The events table as a stream of its files; the pattern finds it as one file or as a folder of files."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


@query("""SELECT time_bucket(INTERVAL '300 seconds', ts) AS period, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, sf_dir) -> DataFrame:
    """The same roll-up as a stream over the table's files, drained."""
    rows = streams.tumbling(_arriving(spark, sf_dir), "ts", ["event_type"], "value", "300 seconds")
    return streams.drain(rows, "tidemark_tumbling", "complete").select(F.col("period").cast("timestamp_ntz").alias("period"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT event_id, event_type || '/' || (user_id % 10)::VARCHAR AS topic FROM events WHERE event_type IN ('click', 'error') OR user_id % 10 = 4""")
def stream_topic_filter(spark, sf_dir) -> DataFrame:
    rows = _arriving(spark, sf_dir).select("event_id", F.concat_ws("/", "event_type", F.col("user_id") % 10).alias("topic"))
    return streams.drain(streams.on_topics(rows, "topic", ["click/+", "error/#", "+/4"]), "tidemark_topics")


@query("""SELECT event_type || '/' || (user_id % 10)::VARCHAR AS topic, max(event_id) AS event_id FROM events GROUP BY 1""")
def retained_topics(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", F.col("user_id") % 10).alias("topic"), F.col("event_id").cast("double").alias("version"), F.lit("n").alias("node"), "event_id")
    return streams.retained(rows, "topic").select("topic", "event_id")

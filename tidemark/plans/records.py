"""Queries of record edits, dictionaries, exclusions over time and row serialisers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import changelog, cluster, replay, rules
from tidemark.sources import responses

from .tables import registrar, table

QUERIES, ORACLES, query = registrar()


@query("""SELECT o_orderkey, o_orderstatus AS status, 'seen' AS priority, o_orderpriority || ',seen' AS tags FROM orders""")
def nested_edit(spark, sf_dir) -> DataFrame:
    """One field inside a structure is set and one item put at the end of a list."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("state"), F.array("o_orderpriority").alias("tags"))
    done = changelog.edited(o, {"state.priority": F.lit("seen")}, {"tags": F.lit("seen")})
    return done.select("o_orderkey", "state.status", "state.priority", F.array_join("tags", ",").alias("tags"))


@query("""SELECT event_id, n_name || ',' || (n_nationkey + 1) AS residency FROM events LEFT JOIN nation ON n_nationkey = event_id % 30""")
def residency_dictionary(spark, sf_dir) -> DataFrame:
    """Changes carry a short number that stands for the list of their places."""
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("residency_id"), F.array("n_name", (F.col("n_nationkey") + 1).cast("string")).alias("residency"))
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 30).alias("residency_id"))
    return replay.translated(rows, places, "residency_id").select("event_id", F.array_join("residency", ",").alias("residency"))


@query("""WITH t AS (SELECT user_id, event_id AS at, event_type = 'error' AS out FROM events WHERE event_type IN ('error', 'signup'))
          SELECT e.event_id FROM events e ASOF LEFT JOIN t ON e.user_id = t.user_id AND e.event_id >= t.at WHERE NOT coalesce(t.out, FALSE)""")
def dynamic_exclusions(spark, sf_dir) -> DataFrame:
    """A user's error takes the user's changes out from there on, a signup brings them back."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), "event_type")
    switches = rows.where("event_type in ('error', 'signup')").select("node", "seq", (F.col("event_type") == "error").alias("excluded"))
    return replay.excluding(rows.select("node", "seq"), switches).select(F.col("seq").alias("event_id"))


@query("""SELECT l_suppkey AS db, min(l_orderkey) AS start, arg_max(l_partkey, (l_orderkey, l_linenumber, l_partkey)) AS cursor FROM lineitem GROUP BY 1""")
def resume_points(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("db"), F.col("l_orderkey").alias("start"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("time"), F.col("l_partkey").alias("cursor"))
    return replay.resume_points(rows, "db")


@query("""SELECT event_id, event_type = 'error' OR event_id % 5 IN (1, 3) AS permanent FROM events""")
def permanent_errors(spark, sf_dir) -> DataFrame:
    code = F.when(F.col("event_type") == "error", "ENOENT").when(F.col("event_type") == "view", "EIO")
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 404, 503, 500, 204)]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", replay.permanent_blob_error(code, status).alias("permanent"))


@query("""SELECT count(*) AS checked, count(*) FILTER (WHERE l_returnflag = 'N') AS repaired, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_returnflag NOT IN ('N', 'R')) AS no_connection FROM lineitem""")
def repair_counters(spark, sf_dir) -> DataFrame:
    flag = F.col("l_returnflag")
    return replay.repair_counts(table(spark, sf_dir, "lineitem").select(F.when(flag == "N", "repaired").when(flag == "R", "failed").otherwise("noConnection").alias("outcome")))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN 'undecodable' ELSE 'deleted' END AS fate FROM customer""")
def row_fates(spark, sf_dir) -> DataFrame:
    value = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), cluster.row_fate(value, F.col("c_custkey") % 3 == 0).alias("fate"))


@query("""SELECT 'p' || p_brand AS tbl, 'reload' AS type FROM part GROUP BY p_brand HAVING count(*) FILTER (WHERE p_size > 49) > 0 OR p_brand = 'Brand#1'""")
def base_copy_markers(spark, sf_dir) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("p"), "p_brand").alias("tbl")).agg(F.count_if(F.col("p_size") > 49).alias("snapshot_rows"))
    return cluster.copy_markers(counts, ["pBrand#1"])


@query("""SELECT s_suppkey, s_nationkey % 3 = 0 AS publish, s_suppkey % 2 = 0 AS subscribe FROM supplier""")
def reverse_subscriptions(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 2 == 0).alias("publish"), (F.col("s_nationkey") % 3 == 0).alias("subscribe"))
    return cluster.reversed_subscriptions(rows)


@query("""SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 IN (0, 1) OR (s_suppkey % 4 = 2 AND s_nationkey % 2 = 0)""")
def change_recipients(spark, sf_dir) -> DataFrame:
    """No list, one with the peer, one with the database where the nation is even, or one with neither."""
    entry = lambda peer, db: F.array(F.struct(F.lit(peer).cast("string").alias("peer"), db.cast("string").alias("db")))
    k, none = F.col("s_suppkey") % 4, F.lit(None).cast("string")
    lists = F.when(k == 1, entry("p1", none)).when(k == 2, entry(None, F.when(F.col("s_nationkey") % 2 == 0, "data").otherwise("other"))).when(k == 3, entry("p2", none))
    return cluster.recipients(table(spark, sf_dir, "supplier").select("s_suppkey", lists.alias("sends_to")), "sends_to", "p1", "data").select("s_suppkey")


@query("""WITH h AS (SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM part)
          SELECT p_partkey, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 16 AS bucket FROM h""")
def size_buckets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.size_bucket(F.col("p_name"), 16).alias("bucket"))


@query("""SELECT event_id, s_suppkey AS net FROM events JOIN supplier ON event_id >= s_suppkey * 64 AND event_id <= s_suppkey * 64 + CASE WHEN s_suppkey % 3 = 0 THEN 63 ELSE 15 END""")
def cidr6_match(spark, sf_dir) -> DataFrame:
    """Addresses of events in the networks of suppliers, a /122 or /124 each, joined on the bits of the prefix."""

    def address(n):
        return F.concat(F.lit("fd00::"), F.lower(F.hex(F.expr(f"({n}) div 65536"))), F.lit(":"), F.lower(F.hex(F.expr(f"({n}) % 65536"))))

    nets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("net"), S.cidr6_prefix(F.concat(address("s_suppkey * 64"), F.when(F.col("s_suppkey") % 3 == 0, "/122").otherwise("/124")))["prefix"].alias("prefix"))
    events = table(spark, sf_dir, "events").select("event_id", S.ipv6_bits(address("event_id")).alias("bits"))
    return rules.prefix_join(events, "bits", nets, "prefix", [122, 124]).select("event_id", "net")


@query("""SELECT n_nationkey AS k, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json, n_nationkey || ',' || n_name AS csv FROM nation""")
def response_rows(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    as_json = rows.select(F.col("n_nationkey").alias("k"), responses.body(rows, "application/json").alias("json"), responses.body(rows, "text/csv").alias("csv"))
    return as_json

"""Queries of the document-table API: searches, REST, SQL, relationships, key sets, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import changelog, relations, search
from tidemark.sources import catalog, operations

from .tables import registrar, table

QUERIES, ORACLES, query = registrar()


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 200000 AND o_orderpriority > '2'")
def search_conditions_sorted(spark, sf_dir) -> DataFrame:
    return search.search(
        table(spark, sf_dir, "orders"),
        {
            "conditions": [{"search_attribute": "o_orderstatus", "search_value": "F"}, {"attribute": "o_totalprice", "comparator": "greater_than_equal", "value": 200000}, {"search_attribute": "o_orderpriority", "search_type": "greater_than", "search_value": "2"}],
            "sort": {"attribute": "o_totalprice"},
            "get_attributes": ["o_orderkey", "o_custkey", "o_totalprice"],
        },
        key="o_orderkey",
    )


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (1, 17, 333, 999)")
def search_by_id_multi(spark, sf_dir) -> DataFrame:
    return search.search_by_id(table(spark, sf_dir, "customer"), "c_custkey", [1, "17", 333, 999, 10**12], ["c_custkey", "c_name", "c_acctbal"])


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
def search_by_value(spark, sf_dir) -> DataFrame:
    return search.search_by_value(table(spark, sf_dir, "customer"), "c_mktsegment", "MACHINERY", ["c_custkey", "c_nationkey"])


@query("SELECT * FROM customer")
def search_wildcard(spark, sf_dir) -> DataFrame:
    return search.search_by_value(table(spark, sf_dir, "customer"), "c_custkey", "*", ["*"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 0")
def search_from_start(spark, sf_dir) -> DataFrame:
    return search.search_by_conditions(table(spark, sf_dir, "orders"), [{"search_attribute": "o_orderkey", "search_type": "greater_than_equal", "search_value": ""}], ["o_orderkey"])


@query("SELECT p_partkey, p_brand FROM part WHERE (p_size < 5 OR p_brand = 'Brand#7') AND p_name LIKE '%ring%' AND p_retailprice BETWEEN 900 AND 950")
def search_groups(spark, sf_dir) -> DataFrame:
    either = {"operator": "or", "conditions": [{"attribute": "p_size", "comparator": "less_than", "value": 5}, {"attribute": "p_brand", "value": "Brand#7"}]}
    return search.search_by_conditions(table(spark, sf_dir, "part"), [either, {"attribute": "p_name", "comparator": "contains", "value": "ring"}, {"attribute": "p_retailprice", "comparator": "between", "value": [900, 950]}], ["p_partkey", "p_brand"])


@query("SELECT * FROM customer WHERE c_custkey = 42")
def point_get(spark, sf_dir) -> DataFrame:
    return search.get(table(spark, sf_dir, "customer"), "c_custkey", "42")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000")
def key_range_resume(spark, sf_dir) -> DataFrame:
    return search.key_range(table(spark, sf_dir, "orders"), "o_orderkey", 1000, exclusive=True).select("o_orderkey", "o_totalprice")


@query("SELECT c_nationkey, c_custkey FROM customer")
def index_scan(spark, sf_dir) -> DataFrame:
    return search.index_scan(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey")


@query("SELECT * FROM nation WHERE n_regionkey = 3")
def rest_query_filter(spark, sf_dir) -> DataFrame:
    return search.rest(table(spark, sf_dir, "nation"), "n_nationkey", "/?n_regionkey=3")


@query("SELECT * FROM nation WHERE n_nationkey = 7")
def rest_item(spark, sf_dir) -> DataFrame:
    return search.rest(table(spark, sf_dir, "nation"), "n_nationkey", "/7")


def _catalog(spark, sf_dir) -> catalog.Catalog:
    c = catalog.Catalog(spark)
    c.create("orders", table(spark, sf_dir, "orders"), "o_orderkey", updated="o_orderdate")
    c.create("lineitem", table(spark, sf_dir, "lineitem"), "l_orderkey", updated="l_shipdate")
    c.create("customer", table(spark, sf_dir, "customer"), "c_custkey", database="crm")
    return c


@query("SELECT count(*) AS c FROM lineitem")
def sql_count(spark, sf_dir) -> DataFrame:
    return _catalog(spark, sf_dir).sql("SELECT COUNT(*) AS c FROM data.lineitem")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '5-LOW'")
def sql_filter(spark, sf_dir) -> DataFrame:
    return _catalog(spark, sf_dir).sql("SELECT o_orderkey AS id FROM data.orders WHERE o_orderpriority = '5-LOW'")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def sql_join_group(spark, sf_dir) -> DataFrame:
    return _catalog(spark, sf_dir).sql("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM data.orders JOIN crm.customer ON o_custkey = c_custkey GROUP BY c_mktsegment")


@query("""SELECT 'data' AS database, 'orders' AS "table", 'o_orderkey' AS hash_attribute, count(*) AS record_count, coalesce(max(epoch_ms(o_orderdate)), 0)::DOUBLE AS last_updated_record FROM orders
          UNION ALL SELECT 'data', 'lineitem', 'l_orderkey', count(*), coalesce(max(epoch_ms(l_shipdate)), 0)::DOUBLE FROM lineitem
          UNION ALL SELECT 'crm', 'customer', 'c_custkey', count(*), 0::DOUBLE FROM customer""")
def describe_tables(spark, sf_dir) -> DataFrame:
    return _catalog(spark, sf_dir).describe_all().drop("attributes")


@query("""SELECT 'data' AS database, greatest((SELECT max(epoch_ms(o_orderdate)) FROM orders), (SELECT max(epoch_ms(l_shipdate)) FROM lineitem))::DOUBLE AS high_water
          UNION ALL SELECT 'crm', 0::DOUBLE""")
def high_water_marks(spark, sf_dir) -> DataFrame:
    return catalog.high_water(_catalog(spark, sf_dir).describe_all())


@query("""SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def rel_many_to_one(spark, sf_dir) -> DataFrame:
    customers = relations.many_to_one(table(spark, sf_dir, "customer"), "c_nationkey", table(spark, sf_dir, "nation"), "n_nationkey", "nation")
    return relations.many_to_one(table(spark, sf_dir, "orders"), "o_custkey", customers, "c_custkey", "customer").select("o_orderkey", F.col("customer.c_name").alias("c_name"), F.col("customer.nation.n_name").alias("n_name"))


@query("""SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS orders, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def rel_one_to_many(spark, sf_dir) -> DataFrame:
    found = relations.one_to_many(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "orders", "o_orderkey")
    return found.select("c_custkey", F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("orders"), F.size("orders").cast("long").alias("n"))


def _parts_of_orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("part_ids"))


@query("""SELECT l_orderkey, string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def rel_many_to_many(spark, sf_dir) -> DataFrame:
    found = relations.many_to_many(_parts_of_orders(spark, sf_dir), "l_orderkey", "part_ids", table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "parts")
    return found.select("l_orderkey", F.array_join(F.transform("parts", lambda p: p["p_name"]), "|").alias("parts")).where("parts <> ''")


@query("""SELECT p_partkey, count(DISTINCT l_orderkey) AS n_orders, min(l_orderkey) AS first_order FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def rel_many_to_many_reverse(spark, sf_dir) -> DataFrame:
    found = relations.many_to_many_reverse(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", _parts_of_orders(spark, sf_dir), "l_orderkey", "part_ids", "orders")
    return found.select("p_partkey", F.coalesce(F.size("orders"), F.lit(0)).cast("long").alias("n_orders"), F.try_element_at("orders", F.lit(1)).alias("first_order")).withColumn("n_orders", F.when(F.col("n_orders") < 0, 0).otherwise(F.col("n_orders")))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)""")
def index_lookup(spark, sf_dir) -> DataFrame:
    index = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return relations.index_lookup(index, table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("""SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)) AS common,
          (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS missing,
          (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS extra""")
def keyset_diff(spark, sf_dir) -> DataFrame:
    return relations.keyset_diff(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("""WITH c AS (SELECT CASE WHEN c_custkey % 10 = 3 THEN c_custkey + 10000000 ELSE c_custkey END AS k FROM customer)
          SELECT 'left' AS side, k FROM c WHERE k NOT IN (SELECT o_custkey FROM orders)
          UNION ALL SELECT 'right', o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT k FROM c)""")
def dangling_refs(spark, sf_dir) -> DataFrame:
    """Every tenth customer has moved to another key."""
    k = F.col("c_custkey")
    moved = table(spark, sf_dir, "customer").select(F.when(k % 10 == 3, k + 10000000).otherwise(k).alias("k"))
    return relations.dangling(moved, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 5 <> 1""")
def update_and_delete(spark, sf_dir) -> DataFrame:
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    patch = base.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 10).alias("c_acctbal"), F.lit("MOVED").alias("c_mktsegment"))
    return changelog.deletes(changelog.updates(base, patch, "c_custkey"), base.where("c_custkey % 5 = 1"), "c_custkey")


@query("""SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 0.0 FROM supplier WHERE s_suppkey % 2 = 0""")
def upsert_records(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return changelog.upserts(s.where("s_suppkey % 3 > 0"), s.where("s_suppkey % 2 = 0").withColumn("s_acctbal", F.lit(0.0)).unionByName(s.where("s_suppkey % 3 = 0 and s_suppkey % 2 = 1")), "s_suppkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 409 ELSE 200 END AS status FROM customer""")
def insert_conflicts(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    new, refused = changelog.inserts(c, c.where("c_custkey % 4 = 0"), "c_custkey")
    return new.withColumn("status", F.lit(200)).union(refused)


@query("""SELECT p_partkey, p_name || ' ' || p_type AS name_type, p_size * 12 AS months FROM part""")
def computed_attributes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr("p_name || ' ' || p_type").alias("name_type"), (F.col("p_size") * 12).alias("months"))


@query("""SELECT user_id, event_id, props::JSON->>'k' AS k FROM events WHERE (props::JSON->>'k')::INT >= 50""")
def json_documents(spark, sf_dir) -> DataFrame:
    good, _ = catalog.parsed_documents(table(spark, sf_dir, "events"), "props", "k int")
    return good.where("_doc.k >= 50").select("user_id", "event_id", F.col("_doc.k").cast("string").alias("k"))


@query("""SELECT event_id, left(props, length(props) - 1) AS props FROM events WHERE event_id % 9 = 4""")
def json_undecodable(spark, sf_dir) -> DataFrame:
    """Every ninth document has lost its last brace."""
    damaged = F.when(F.col("event_id") % 9 == 4, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    _, bad = catalog.parsed_documents(table(spark, sf_dir, "events").withColumn("props", damaged), "props", "k int")
    return bad.select("event_id", "props")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (2, 18, 400)""")
def search_by_hash(spark, sf_dir) -> DataFrame:
    c = _catalog(spark, sf_dir)
    return operations.Operations(c)({"operation": "search_by_hash", "database": "crm", "table": "customer", "hash_values": [2, "18", 400, 10**12], "get_attributes": ["c_custkey", "c_name"]})


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0.0 WHEN s_suppkey % 5 = 1 THEN 1.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 5 <> 2 UNION ALL SELECT s_suppkey + 1000000, 7.0 FROM supplier""")
def rest_writes(spark, sf_dir) -> DataFrame:
    """PUT, PATCH, POST (of which what is there is refused) and DELETE of a table at a path, then GET."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    c, paths = catalog.Catalog(spark), operations.Resources()
    c.create("supplier", s, "s_suppkey")
    paths.register("/Supplier", operations.TableResource(c, "supplier"))
    paths("PUT", "/Supplier/", s.where("s_suppkey % 5 = 0").withColumn("s_acctbal", F.lit(0.0)))
    paths("PATCH", "/Supplier/", s.where("s_suppkey % 5 = 1").withColumn("s_acctbal", F.lit(1.0)))
    paths("POST", "/Supplier/", s.union(s.withColumn("s_suppkey", F.col("s_suppkey") + 1000000)).withColumn("s_acctbal", F.lit(7.0)))
    paths("DELETE", "/Supplier/", s.where("s_suppkey % 5 = 2"))
    return paths("GET", "/Supplier/")


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R'""")
def key_prefix_range(spark, sf_dir) -> DataFrame:
    """Order lines by composite key, of one return flag."""
    keys = ["l_returnflag", "l_orderkey", "l_linenumber"]
    return search.prefix_range(table(spark, sf_dir, "lineitem").select(*keys, "l_partkey"), keys, ["R"])


@query("""SELECT 'data' AS database, 'orders' AS "table", 'o_orderkey' AS primary_key, 'o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string' AS attributes
          UNION ALL SELECT 'crm', 'customer', 'c_custkey', 'c_custkey:bigint,c_name:string,c_nationkey:int,c_acctbal:double,c_mktsegment:string'""")
def create_statements(spark, sf_dir) -> DataFrame:
    """Operations that make described tables anew, without managed attributes and system tables."""
    c = catalog.Catalog(spark)
    c.create("orders", table(spark, sf_dir, "orders").withColumn("__createdtime__", F.lit(0)), "o_orderkey")
    c.create("customer", table(spark, sf_dir, "customer"), "c_custkey", database="crm")
    c.create("nodes", table(spark, sf_dir, "supplier"), "s_suppkey", database="system")
    return catalog.create_statements(c.describe_all())


@query("""SELECT o_custkey AS id, CASE WHEN c_custkey IS NULL THEN 'loaded ' || o_custkey ELSE c_name END AS v FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 4) ON o_custkey = c_custkey""")
def read_through(spark, sf_dir) -> DataFrame:
    """Customers that orders name; those of one nation aren't stored and are loaded."""

    def load(frames):
        for f in frames:
            yield f.assign(v="loaded " + f["id"].astype(str))

    stored = table(spark, sf_dir, "customer").where("c_nationkey <> 4").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("v"))
    return catalog.read_through(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), stored, "id", load)


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id::DOUBLE WHEN event_id % 5 = 1 THEN (epoch_us(ts) // 1000)::DOUBLE WHEN event_id % 5 = 2 THEN (epoch_us(ts) // 1000000 * 1000 - 7200000)::DOUBLE END AS start_ms FROM events""")
def start_times(spark, sf_dir) -> DataFrame:
    """Numbers, UTC texts and texts with an offset are start times; dates and words are not."""
    k, ts = F.col("event_id") % 5, F.col("ts")
    text = F.when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(k == 3, F.date_format(ts, "yyyy-MM-dd")).when(k == 4, "yesterday")
    return table(spark, sf_dir, "events").select("event_id", S.start_time_ms(text, F.when(k == 0, F.col("event_id").cast("double"))).alias("start_ms"))


@query("""SELECT event_id, (props::JSON->>'k')::INT AS k, (props::JSON->>'absent') IS NULL AS absent FROM events""")
def schemaless_attributes(spark, sf_dir) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.absent", "string").isNull().alias("absent"))


@query("""SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '[redacted]' END AS token, c_mktsegment FROM customer""")
def redaction(spark, sf_dir) -> DataFrame:
    return S.redacted(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("token"), "c_mktsegment"))


@query("""SELECT quantile_in AS seg, c_custkey FROM (SELECT c_mktsegment AS quantile_in, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer
          WHERE (c_nationkey = -1 OR c_nationkey > 3) AND c_acctbal < 5000) WHERE r = 1 AND seg = 'BUILDING'""")
def quota_first_active(spark, sf_dir) -> DataFrame:
    """The first customer of a segment whose limits (read from its columns) still leave room."""
    from tidemark.operators.metrics import within_quota

    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_mktsegment").alias("seg"), "c_custkey", F.col("c_nationkey").alias("reads"), F.lit(3).alias("used_reads"), F.lit(5000.0).alias("writes"), F.col("c_acctbal").alias("used_writes"))
    return search.first_passing(c, within_quota(["reads", "writes"]), ["c_custkey"]).select("seg", "c_custkey")


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END AS path FROM pages""")
def url_parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.url_host(F.col("url")).alias("host"), S.url_path(F.col("url")).alias("path"))


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM pages)
           SELECT page_id, p AS canonical FROM u""")
def canonical_path(spark, sf_dir) -> DataFrame:
    """Every page's path, disguised by a dot segment, a double slash, a detour and an escaped letter, comes back as it was."""
    p = S.url_path(F.col("url"))
    last = F.substring_index(p, "/", -1)
    disguised = F.concat(F.lit("/./"), F.lit("%2e%2E//x/../"), F.substring(p, F.lit(2), F.length(p) - F.length(last) - 1), F.when(last == "", "").otherwise(F.concat(F.lit("%25"), F.hex(F.substring(last, 1, 1)), F.substring(last, 2, 500))))
    return table(spark, sf_dir, "pages").select("page_id", S.canonical_path(disguised).alias("canonical"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '-') AS page, coalesce(nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), ''), '-') AS ref FROM pages""")
def parse_query(spark, sf_dir) -> DataFrame:
    q = S.url_query(F.col("url"))
    first = lambda name: F.coalesce(F.try_element_at(S.query_values(q, name), F.lit(1)), F.lit("-"))
    return table(spark, sf_dir, "pages").select("page_id", first("page").alias("page"), first("ref").alias("ref"))


@query("""SELECT event_id, (10::BIGINT << 24) + ((event_id // 65536) % 256) * 65536 + ((event_id // 256) % 256) * 256 + event_id % 256 AS number FROM events WHERE event_id % 7 <> 0
          UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 7 = 0""")
def ipv4_to_int(spark, sf_dir) -> DataFrame:
    """Addresses made of event ids; every seventh has a leading zero and is malformed."""
    e = F.col("event_id")
    ip = F.concat_ws(".", F.when(e % 7 == 0, "010").otherwise("10"), F.expr("(event_id div 65536) % 256"), F.expr("(event_id div 256) % 256"), e % 256)
    return table(spark, sf_dir, "events").select("event_id", S.ipv4_number(S.normal_ip(F.when(e % 2 == 0, F.concat(F.lit("::ffff:"), ip)).otherwise(ip))).alias("number"))


@query("""SELECT event_id, event_type || '/' || (user_id % 10)::VARCHAR || '/' || (event_id % 3)::VARCHAR AS topic FROM events
          WHERE event_type = 'click' OR ((user_id % 10) = 4 AND (event_id % 3) = 1)""")
def topic_match(spark, sf_dir) -> DataFrame:
    from tidemark.streaming.streams import on_topics

    rows = table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", "event_type", F.col("user_id") % 10, F.col("event_id") % 3).alias("topic"))
    return on_topics(rows, "topic", ["click/#", "+/4/1"])

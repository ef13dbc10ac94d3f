"""Queries of the rule-matching engine; requests are made of pages' URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import changelog, rules

from .tables import registrar, table

QUERIES, ORACLES, query = registrar()

RULES = [
    {"id": "net", "priority": 5, "phase": "request", "action": "score", "score": 4, "match": {"ip": ["10.0.0.0/26", "10.0.1.0/25"]}},
    {"id": "fr", "priority": 10, "phase": "request", "action": "log", "match": {"path": {"prefix": "/fr/"}}},
    {"id": "digits", "priority": 20, "phase": "request", "action": "score", "score": 7, "match": {"path": {"regex": "^/[a-z]+/[5-9][0-9]*"}}},
    {"id": "ref", "priority": 30, "phase": "request", "action": "block", "blockStatus": 429, "match": {"query": [{"name": "ref", "op": "exists"}], "method": ["get"]}},
    {"id": "bot", "priority": 30, "phase": "request", "action": "score", "score": 6, "match": {"headers": [{"name": "User-Agent", "op": "contains", "value": "bot"}]}},
    {"id": "shade", "priority": 1, "phase": "request", "action": "block", "shadow": True, "match": {"headers": [{"name": "x-host", "op": "prefix", "value": "blog."}], "method": ["POST"]}},
    {"id": "spam", "priority": 2, "phase": "request", "action": "block", "match": {"headers": [{"name": "X-Host", "op": "equals", "value": "spam-farm.example.org"}]}},
    {"id": "admin", "priority": 30, "phase": "request", "action": "score", "score": 5, "match": {"path": {"exact": "/admin"}}},
    {"id": "off", "enabled": False, "priority": 0, "phase": "request", "action": "block", "match": {"method": ["GET"]}},
    {"id": "later", "priority": 0, "phase": "request", "action": "challenge", "match": {"method": ["GET"]}},
    {"id": "bad", "priority": 0, "phase": "request", "action": "block", "match": {"path": {"regex": "(a)\\1"}}},
]

#: Requests and what matches them; `rule` is when a rule is probed, which settles equal priorities.
REQUESTS = r"""q AS (SELECT page_id AS req, page_id % 256 AS d, (page_id // 256) % 256 AS c, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
    regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CASE WHEN page_id % 11 = 0 THEN '/admin' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END AS path, regexp_extract(url, '\?([^#]*)', 1) AS query,
    CASE WHEN page_id % 5 = 0 THEN 'crawler-bot/1' ELSE 'browser' END AS agent FROM pages),
  m AS (SELECT req, 0 AS rule, 'net' AS id, 'score' AS action, 5 AS priority, 4.0 AS score, 403 AS status, FALSE AS shadow FROM q WHERE (c = 0 AND d < 64) OR (c = 1 AND d < 128)
    UNION ALL SELECT req, 40, 'fr', 'log', 10, 0, 403, FALSE FROM q WHERE starts_with(path, '/fr/')
    UNION ALL SELECT req, 50, 'digits', 'score', 20, 7, 403, FALSE FROM q WHERE regexp_matches(path, '^/[a-z]+/[5-9][0-9]*')
    UNION ALL SELECT req, 70, 'ref', 'block', 30, 0, 429, FALSE FROM q WHERE regexp_matches(query, '(^|&)ref(=|&|$)') AND method = 'GET'
    UNION ALL SELECT req, 60, 'bot', 'score', 30, 6, 403, FALSE FROM q WHERE contains(agent, 'bot')
    UNION ALL SELECT req, 61, 'shade', 'block', 1, 0, 403, TRUE FROM q WHERE starts_with(host, 'blog.') AND method = 'POST'
    UNION ALL SELECT req, 62, 'spam', 'block', 2, 0, 403, FALSE FROM q WHERE host = 'spam-farm.example.org'
    UNION ALL SELECT req, 30, 'admin', 'score', 30, 5, 403, FALSE FROM q WHERE path = '/admin')"""

#: The first decision of one track, from running sums in order of priority.
TRACK = """SELECT req, arg_min(id, o) FILTER (WHERE hit) AS one, arg_min(action, o) FILTER (WHERE hit) AS action, arg_min(status, o) FILTER (WHERE hit) AS status, min(o) FILTER (WHERE hit) AS o, arg_min(run, o) FILTER (WHERE hit) AS total, max(run) AS most
           FROM (SELECT *, action = 'block' OR run >= 10 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY req ORDER BY priority, rule) AS o, sum(score) OVER (PARTITION BY req ORDER BY priority, rule) AS run FROM m WHERE action <> 'log' AND shadow = {shadow})) GROUP BY 1"""


def requests(spark, sf_dir) -> DataFrame:
    url, p = F.col("url"), F.col("page_id")
    headers = F.create_map(F.lit("X-Host"), F.array(S.url_host(url)), F.lit("User-Agent"), F.array(F.when(p % 5 == 0, "crawler-bot/1").otherwise("browser")))
    return table(spark, sf_dir, "pages").select(p.alias("req"), F.concat_ws(".", F.lit("10.0"), F.expr("(page_id div 256) % 256"), p % 256).alias("ip"), F.when(p % 3 == 0, "post").otherwise("get").alias("method"), F.when(p % 11 == 0, "/admin").otherwise(S.url_path(url)).alias("path"), S.url_query(url).alias("query"), headers.alias("headers"))


def _matched(spark, sf_dir) -> DataFrame:
    return rules.matches(requests(spark, sf_dir), *rules.plan_rules(spark, rules.classify(RULES)["usable"]))


def _flat(decisions: DataFrame) -> DataFrame:
    return decisions.select("req", "action", "status", F.array_join("rule_ids", ",").alias("rule_ids"), "score", F.array_join("log_rule_ids", ",").alias("log_rule_ids"), F.array_join("shadow_rule_ids", ",").alias("shadow_rule_ids"))


@query(f"""WITH {REQUESTS}, real AS ({TRACK.format(shadow="FALSE")}), shade AS ({TRACK.format(shadow="TRUE")}),
  o AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY priority, rule) AS o FROM m WHERE action <> 'log' AND NOT shadow),
  ids AS (SELECT o.req, string_agg(id, ',' ORDER BY o.o) AS ids FROM o JOIN real ON o.req = real.req WHERE o.o <= real.o AND o.action = 'score' GROUP BY 1),
  logs AS (SELECT req, string_agg(id, ',' ORDER BY priority, rule) AS logs FROM m WHERE action = 'log' GROUP BY 1)
  SELECT q.req, CASE WHEN real.o IS NOT NULL THEN 'block' ELSE 'log' END AS action, CASE WHEN real.o IS NULL THEN 0 WHEN real.action = 'block' THEN real.status ELSE 403 END AS status,
         CASE WHEN real.o IS NULL THEN coalesce(logs, '') WHEN real.action = 'block' THEN real.one ELSE ids END AS rule_ids,
         CASE WHEN real.o IS NULL AND real.most > 0 THEN real.most WHEN real.o IS NOT NULL AND real.action <> 'block' THEN real.total END AS score,
         CASE WHEN real.o IS NOT NULL THEN logs END AS log_rule_ids, shade.one AS shadow_rule_ids
  FROM q LEFT JOIN real USING (req) LEFT JOIN shade USING (req) LEFT JOIN ids USING (req) LEFT JOIN logs USING (req) WHERE real.o IS NOT NULL OR shade.o IS NOT NULL OR logs IS NOT NULL""")
def rule_decisions(spark, sf_dir) -> DataFrame:
    return _flat(rules.evaluate(requests(spark, sf_dir), RULES))


@query(f"""WITH {REQUESTS} SELECT id AS rule_id, count(*) AS hit_count, make_timestamp(max(req % 1000) * 1000000) AS last_matched FROM m GROUP BY 1""")
def rule_stats(spark, sf_dir) -> DataFrame:
    timed = _matched(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.col("req") % 1000))
    return rules.statistics(timed, "at").withColumn("last_matched", F.col("last_matched").cast("timestamp_ntz"))


@query(f"""WITH {REQUESTS}, a AS (SELECT *, TRUE AS s FROM m WHERE action <> 'log'), t AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY priority, rule) AS o, sum(score) OVER (PARTITION BY req ORDER BY priority, rule) AS run FROM a),
  h AS (SELECT req, min(o) AS o, arg_min(id, o) AS one, arg_min(action, o) AS action FROM t WHERE action = 'block' OR run >= 10 GROUP BY 1),
  ids AS (SELECT t.req, string_agg(id, ',' ORDER BY t.o) AS ids FROM t JOIN h ON t.req = h.req WHERE t.o <= h.o AND t.action = 'score' GROUP BY 1),
  logs AS (SELECT req, string_agg(id, ',' ORDER BY priority, rule) AS logs FROM m WHERE action = 'log' GROUP BY 1)
  SELECT q.req, coalesce(logs, '') AS rule_ids, CASE WHEN h.action = 'block' THEN one ELSE ids END AS shadow_rule_ids FROM q LEFT JOIN h USING (req) LEFT JOIN ids USING (req) LEFT JOIN logs USING (req) WHERE h.o IS NOT NULL OR logs IS NOT NULL""")
def rule_shadow_monitor(spark, sf_dir) -> DataFrame:
    return _flat(rules.evaluate(requests(spark, sf_dir), RULES, mode="monitor")).select("req", "rule_ids", "shadow_rule_ids")


@query(f"""WITH {REQUESTS} SELECT req, count(*) AS n_rules FROM m GROUP BY 1""")
def rule_matches(spark, sf_dir) -> DataFrame:
    return _matched(spark, sf_dir).groupBy("req").agg(F.count(F.lit(1)).alias("n_rules"))


@query("""SELECT l_orderkey AS low, l_orderkey + l_partkey AS high, max(l_orderkey + l_partkey) OVER (ORDER BY l_orderkey, l_orderkey + l_partkey) AS most FROM lineitem""")
def interval_prefix_max(spark, sf_dir) -> DataFrame:
    """Order lines as ranges of numbers, sorted, with the highest end up to each."""
    return rules.prefix_max_ends(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("low"), (F.col("l_orderkey") + F.col("l_partkey")).alias("high")))


@query("""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 2 = 0 THEN 'off' END AS mode, c_acctbal AS "scoreThreshold" FROM customer WHERE c_custkey <> 7
          UNION ALL SELECT 'control', 'monitor', c_acctbal FROM customer WHERE c_custkey = 7""")
def control_row(spark, sf_dir) -> DataFrame:
    """The mode is set; the threshold, which another call set, stays."""
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.when(c == 7, rules.CONTROL).otherwise(c.cast("string")).alias("id"), F.when(c % 2 == 0, "off").alias("mode"), F.col("c_acctbal").alias("scoreThreshold"))
    return rules.with_control(rows, mode="monitor")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
          CASE WHEN c_custkey % 3 = 0 THEN 'balance,segment' WHEN c_acctbal < 0 THEN 'balance' ELSE '' END AS problems FROM customer""")
def alter_revalidate(spark, sf_dir) -> DataFrame:
    """Allowed fields are put in, null included, one that isn't allowed stays out, and the whole record is checked again."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_name")
    patch = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(-1.0).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    done = rules.problems_of(changelog.updates(c, patch, "c_custkey"), {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isNotNull()})
    return done.select("c_custkey", "c_acctbal", "c_mktsegment", F.array_join("problems", ",").alias("problems"))


NETS = "SELECT s_suppkey AS net, (10::BIGINT << 24) + s_suppkey * 64 AS low, (10::BIGINT << 24) + s_suppkey * 64 + CASE WHEN s_suppkey % 3 = 0 THEN 63 ELSE 15 END AS high FROM supplier"


@query(f"""SELECT event_id, net FROM events JOIN ({NETS}) ON (10::BIGINT << 24) + event_id BETWEEN low AND high""")
def cidr_match(spark, sf_dir) -> DataFrame:
    """Addresses of events in the networks of suppliers, a /26 or /28 each."""
    s = F.col("s_suppkey")
    cidr = F.concat(F.lit("10."), F.expr("(s_suppkey * 64) div 65536"), F.lit("."), F.expr("((s_suppkey * 64) div 256) % 256"), F.lit("."), (s * 64) % 256, F.when(s % 3 == 0, "/26").otherwise("/28"))
    nets = table(spark, sf_dir, "supplier").select(s.alias("net"), S.cidr_range(cidr).alias("r")).select("net", "r.low", "r.high")
    events = table(spark, sf_dir, "events").select("event_id", ((F.lit(10).cast("long") * (1 << 24)) + F.col("event_id")).alias("ip"))
    return rules.interval_join(events, "ip", nets).select("event_id", "net")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages), x AS (SELECT DISTINCT '/' || lang || '/' || (doc_id % 10) AS prefix FROM documents UNION SELECT DISTINCT '/' || lang FROM documents)
           SELECT page_id, prefix FROM p JOIN x ON starts_with(path, prefix)""")
def path_prefix_match(spark, sf_dir) -> DataFrame:
    """Page paths and the prefixes that languages of documents give."""
    d = table(spark, sf_dir, "documents").where("lang is not null")
    prefixes = d.select(F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id") % 10).alias("prefix")).union(d.select(F.concat(F.lit("/"), "lang"))).distinct()
    lengths = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())
    found = rules.prefix_join(table(spark, sf_dir, "pages").select("page_id", S.url_path(F.col("url")).alias("path")), "path", prefixes.withColumn("p", F.col("prefix")), "p", lengths)
    return found.select("page_id", "prefix")


@query(r"""SELECT page_id, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page FROM pages WHERE regexp_matches(url, '\?([^#]*&)?page=[0-9]+(&|#|$)')""")
def query_param_match(spark, sf_dir) -> DataFrame:
    value = F.try_element_at(S.query_values(S.url_query(F.col("url")), "page"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", value.alias("page")).where(S.compare("regex", F.col("page"), "^[0-9]+$"))


@query(r"""SELECT page_id, regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '\.html$') AS html, regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^/en/') AS english FROM pages""")
def path_regex_match(spark, sf_dir) -> DataFrame:
    p = S.url_path(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", S.compare("regex", p, r"\.html$").alias("html"), S.compare("regex", p, "^/en/").alias("english"))

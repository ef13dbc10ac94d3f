"""Topology and status of nodes as relational transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.running import running

CONNECTED = 2
#: A task that counts peers gets about this many rows; up to 200 tasks the shuffle before it writes rows without holding them.
TASK_ROWS, MOST_TASKS = 1 << 18, 200


def normal_routes(routes: DataFrame) -> DataFrame:
    """(name, url, port, replicates) of routes with text or host/url/port/replicates/subscribed; those without url and host go.

    Without an explicit flag a route replicates unless it has subscriptions.
    """
    url = F.coalesce("url", F.when(F.col("host").isNotNull(), F.concat(F.lit("wss://"), "host", F.coalesce(F.concat(F.lit(":"), F.col("port").cast("string")), F.lit("")))), F.when(F.col("text").contains("://"), F.col("text")), F.when(F.col("text").isNotNull(), F.concat(F.lit("wss://"), "text")))
    name = F.coalesce("host", F.try_parse_url(url, F.lit("HOST")))
    return routes.select(name.alias("name"), url.alias("url"), "port", F.coalesce("replicates", ~F.coalesce("subscribed", F.lit(False))).alias("replicates")).where("url is not null")


def fold_self(neighbours: DataFrame, by: str = "node") -> DataFrame:
    """One row a node: directional if any route is; both directions' peers, a peer that is simply true counting in both."""
    directional = F.bool_or(F.col("sends").isNotNull() | F.col("receives").isNotNull())
    both = F.coalesce(F.col("plain"), F.lit(False))
    sends = F.array_sort(F.collect_set(F.when(both | F.coalesce("sends", F.lit(False)), F.col("peer"))))
    receives = F.array_sort(F.collect_set(F.when(both | F.coalesce("receives", F.lit(False)), F.col("peer"))))
    out = neighbours.groupBy(by).agg(directional.alias("directional"), sends.alias("sends_to"), receives.alias("receives_from"))
    return out.select(by, "directional", F.when(F.col("directional"), F.col("sends_to")).alias("sends_to"), F.when(F.col("directional"), F.col("receives_from")).alias("receives_from"))


def reversed_subscriptions(subs: DataFrame) -> DataFrame:
    """publish and subscribe change places."""
    return subs.withColumns({"publish": F.col("subscribe"), "subscribe": F.col("publish")})


def authorises(entries: Column, peer: Column, db: Column) -> Column:
    """Whether an array of (peer, db) entries lets a peer have a database; a missing part matches all."""
    return F.exists(entries, lambda e: (e["peer"].isNull() | (e["peer"] == peer)) & (e["db"].isNull() | (e["db"] == db)))


def recipients(nodes: DataFrame, sends_to: str, peer: str, db: str) -> DataFrame:
    """Nodes that send to a peer: no list, or one that authorises it."""
    return nodes.where(F.col(sends_to).isNull() | authorises(F.col(sends_to), F.lit(peer), F.lit(db)))


def replicated(databases: Column, db: Column, same_shard: Column, fallback: bool = True) -> Column:
    """Whether a list of (name, sharded) holds a database; `*` or an empty list is all, no list the fallback."""
    listed = F.exists(databases, lambda d: (d["name"] == db) & (~F.coalesce(d["sharded"], F.lit(False)) | same_shard))
    return F.when(databases.isNull(), F.lit(fallback)).otherwise((F.size(databases) == 0) | F.exists(databases, lambda d: d["name"] == "*") | listed)


def should_replicate(pairs: DataFrame) -> DataFrame:
    """Adds replicate to (self, peer, db) rows with routes, flags, databases, shards and subscriptions.

    authorised, and the database local or led here, and replicated (its shard
    being this one where it is sharded), and not itself; or subscribed by name.
    """
    explicit = F.exists("subscriptions", lambda s: (s["db"] == F.col("db")) & s["subscribe"])
    by_rule = F.when(F.col("routes").isNotNull(), authorises(F.col("routes"), F.col("peer"), F.col("db"))).otherwise(F.coalesce("replicates", F.lit(True)))
    listed = replicated(F.col("databases"), F.col("db"), F.col("shard").eqNullSafe(F.col("peer_shard")))
    usual = by_rule & (F.col("is_local") | F.col("leads")) & listed & (F.col("self") != F.col("peer"))
    return pairs.withColumn("replicate", F.coalesce(usual, F.lit(False)) | F.coalesce(explicit, F.lit(False)))


def excluded_tables(routes: DataFrame, peer: str, db: str) -> DataFrame:
    """(tbl): the union of what matching routes exclude."""
    hit = (F.col("peer").isNull() | (F.col("peer") == peer)) & (F.col("db").isNull() | (F.col("db") == db))
    return routes.where(hit).select(F.explode("excluded").alias("tbl")).distinct()


def connected(now_ms: Column, ping_timeout_ms: float = 60000.0) -> Column:
    """A socket in state 2 with signs of life no older than two minutes or twice the ping timeout."""
    return (F.col("state") == CONNECTED) & (F.col("liveness") > 0) & (now_ms - F.col("liveness") < F.greatest(F.lit(120000.0), F.lit(2 * ping_timeout_ms)))


def enriched_status(sockets: DataFrame, slots: DataFrame) -> DataFrame:
    """Sockets with their status slots: the ratio in percent; a time of 0 is absent, 1 is a copy under way."""
    joined = sockets.join(slots, ["db", "peer"], "left")
    t = F.col("last_received")
    return joined.select(*sockets.columns, (F.col("ratio") * 100).alias("backpressure_percent"), F.when(t > 1, t).alias("last_received"), F.when(t == 1, "Copying").otherwise(F.when(t > 1, "Receiving")).alias("status"))


def stale(entries: DataFrame, workers: DataFrame) -> DataFrame:
    """Entries without a worker that lives; none if no worker lives."""
    alive = workers.where("live").select(F.col("worker").alias("_w"))
    some = alive.agg((F.count(F.lit(1)) > 0).alias("_some"))
    left = entries.join(alive, F.col("worker") == F.col("_w"), "left_anti")
    return left.join(F.broadcast(some), F.col("_some")).drop("_some")


def wedged(entries: DataFrame, workers: DataFrame, now_ms: float, threshold_ms: float) -> DataFrame:
    """(url) of desired entries with a live worker that haven't been connected for the threshold."""
    alive = workers.where("live").select("worker")
    since = F.coalesce("disconnected_at", "created_at")
    return entries.join(alive, "worker", "left_semi").where(~F.col("connected") & F.col("desired") & (F.lit(now_ms) - since >= threshold_ms)).select("url").distinct()


def stalled(receivers: DataFrame, now_ms: float, threshold_ms: float) -> DataFrame:
    """(peer, dbs) of receivers under way that stopped, and had moved since they were last kicked."""
    t = F.col("last_time")
    rows = receivers.where(F.col("receiving") & (t > 0) & (F.lit(now_ms) - t >= threshold_ms) & (F.col("last_kick_time").isNull() | (t > F.col("last_kick_time"))))
    return rows.groupBy("peer").agg(F.array_sort(F.collect_set("db")).alias("dbs"))


def reconciled(entry: Column, truth: Column) -> Column:
    """What to do about an entry that says one thing where the truth is another: down, up or none."""
    return F.when(entry & ~truth, "down").when(~entry & truth, "up").otherwise("none")


def failover(nodes: DataFrame) -> DataFrame:
    """(node, backup): for each node that is down, the next connected one of its shard in the ring of sorted names."""
    ring = Window.partitionBy("shard").orderBy("node")
    after = ring.rowsBetween(1, Window.unboundedFollowing)
    up = F.when(F.col("connected"), F.col("node"))
    found = nodes.withColumn("_next", F.first(up, ignorenulls=True).over(after)).withColumn("_first", F.min(up).over(Window.partitionBy("shard")))
    return found.where("not connected").select("node", F.coalesce("_next", "_first").alias("backup"))


def by_shard(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("shard").agg(F.array_sort(F.collect_list("node")).alias("nodes"))


def confirmed(acks: DataFrame, txns: DataFrame, needed: int, tasks: int | None = None) -> DataFrame:
    """(txn, peers, reached): distinct peers (txn, peer, replicated_time) that have replicated up to each transaction's time (txn, txn_time).

    Pairs of transaction and peer hardly repeat, so none are gathered before
    the shuffle, and its tasks are in proportion to the rows.
    """
    tasks = tasks or max(1, min(MOST_TASKS, -(-acks.count() // TASK_ROWS)))
    both = acks.repartition(tasks, "txn").join(txns.repartition(tasks, "txn").hint("merge"), "txn")
    return both.where(F.col("replicated_time") >= F.col("txn_time")).groupBy("txn").agg(F.countDistinct("peer").alias("peers")).withColumn("reached", F.col("peers") >= needed)


def nearest_peer(peers: DataFrame, by: str) -> DataFrame:
    """(by, peer): the lowest latency among connected peers other than itself that weren't tried; the first wins a tie.

    A link that was never measured reads 0 and so comes first.
    """
    fair = peers.where(F.col("connected") & ~F.col("tried") & (F.col("peer") != F.col(by)))
    return fair.groupBy(by).agg(F.min_by("peer", F.struct(F.coalesce("latency", F.lit(0.0)), "ord")).alias("peer"))


def sync_status(required: DataFrame, sockets: DataFrame) -> DataFrame:
    """(db, state) of required databases (db, target) and of all that have a socket (db, received).

    No socket, or one that received nothing, is pending; behind its target (no
    target or 0: anything received) syncing; else complete.
    """
    joined = required.join(sockets, "db", "full")
    nothing = F.coalesce(F.col("received"), F.lit(0.0)) == 0
    wanted = F.when(F.coalesce("target", F.lit(0.0)) == 0, 1.0).otherwise(F.col("target"))
    return joined.select("db", F.when(nothing, "pending").when(F.col("received") >= wanted, "complete").otherwise("syncing").alias("state"))


def all_complete(status: DataFrame) -> DataFrame:
    return status.agg(F.coalesce(F.bool_and(F.col("state") == "complete"), F.lit(True)).alias("complete"))


def required_ratchet(base: DataFrame, seen: DataFrame) -> DataFrame:
    """(poll, db): what is required at each poll, which is the base and all that was ever seen up to it."""
    polls = seen.select("poll").distinct()
    first = seen.groupBy("db").agg(F.min("poll").alias("_from"))
    wanted = first.union(base.select("db", F.lit(None).cast("long"))).groupBy("db").agg(F.min(F.coalesce("_from", F.lit(-1))).alias("_from"))
    return polls.join(wanted, F.col("poll") >= F.col("_from")).select("poll", "db")


def stall_deadline(arrivals: DataFrame, window_ms: float) -> DataFrame:
    """Adds deadline: the latest arrival so far and the window."""
    return running(arrivals, ["db"], ["poll"], {"deadline": ("max", "arrived")}).withColumn("deadline", F.col("deadline") + window_ms)


def gathered(peers: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for every peer asked: its answer, or the failure."""
    return peers.join(answers, "peer", "left").select("peer", "answer", F.when(F.col("answer").isNull() & F.col("error").isNull(), "no answer").otherwise(F.col("error")).alias("error"))


def row_fate(value: Column, failed: Column) -> Column:
    """A row that reads as a clean null is deleted; one that fails or holds something else can't be decoded."""
    return F.when(~failed & value.isNull(), "deleted").otherwise("undecodable")


def copy_markers(tables: DataFrame, system: list[str]) -> DataFrame:
    """(tbl, reload): system tables, and user tables that got rows from a snapshot."""
    return tables.where(F.col("tbl").isin(system) | (F.col("snapshot_rows") > 0)).select("tbl", F.lit("reload").alias("type"))

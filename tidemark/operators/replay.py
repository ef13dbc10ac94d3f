"""Replaying a change log: which changes go to a peer, in which transactions, from where, and how far it is safe.

Changes carry seq (order in the log), local_time, version, node, type, flags
and residency; see changelog for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import changelog
from tidemark.operators.running import before, running

LOCAL_ONLY = 1


def replicable(changes: DataFrame) -> DataFrame:
    """Without changes that are flagged as local."""
    return changes.where(F.col("flags").bitwiseAND(LOCAL_ONLY) == 0)


def wanted_tables(changes: DataFrame, names: list[str], by_default: bool) -> DataFrame:
    """A deny list if tables replicate by default, else an allow list."""
    listed = F.col("tbl").isin(names)
    return changes.where(~listed if by_default else listed)


def not_excluded(changes: DataFrame, routes: DataFrame, peer: str) -> DataFrame:
    """Without tables that a matching route excludes; a route matches if its peer and db are this one or absent."""
    out = routes.where(F.col("peer").isNull() | (F.col("peer") == peer)).select("db", F.explode("excluded").alias("tbl")).distinct()
    return changes.alias("c").join(out.alias("r"), (F.col("c.tbl") == F.col("r.tbl")) & (F.col("r.db").isNull() | (F.col("r.db") == F.col("c.db"))), "left_anti")


def in_ranges(changes: DataFrame, ranges: DataFrame, has_exclusions: bool = True) -> DataFrame:
    """Changes inside their origin's (start, end), both strict, an end of null or 0 being open.

    Origins that aren't listed pass if the subscription has an exclusion list.
    """
    inside = (F.col("start") < F.col("local_time")) & (F.col("end").isNull() | (F.col("end") == 0) | (F.col("end") > F.col("local_time")))
    joined = changes.join(ranges.select("node", "start", "end", F.lit(True).alias("_listed")), "node", "left")
    return joined.where(F.when(F.col("_listed"), inside).otherwise(F.lit(has_exclusions))).select(*changes.columns)


def for_residency(changes: DataFrame, peer: str) -> DataFrame:
    """A put or patch that doesn't reside at the peer becomes an invalidation, or goes if it didn't reside there before either."""
    here = F.col("residency").isNull() | F.array_contains("residency", peer)
    before = F.col("prev_residency").isNull() | F.array_contains("prev_residency", peer)
    write = F.col("type").isin("put", "patch")
    kept = changes.where(here | ~write | before)
    return kept.withColumn("type", F.when(write & ~here, "invalidate").otherwise(F.col("type")))


def not_from(changes: DataFrame, peer, own) -> DataFrame:
    """Without what the peer itself wrote (no node: written here)."""
    return changes.where(F.coalesce(F.col("node"), F.lit(own)) != F.lit(peer))


def too_old(start: Column, oldest: Column, cutoff: Column) -> Column:
    """Whether a cursor lies before what the log still holds, so a full copy is needed."""
    return (start > 0) & (start < F.greatest(F.coalesce(oldest, F.lit(0.0)), cutoff))


def oldest_retained(changes: DataFrame) -> DataFrame:
    return changes.agg(F.min(F.coalesce("local_time", "version")).alias("oldest"))


def starts(cursors: DataFrame, cutoff: float, system: bool = False) -> DataFrame:
    """(node, start): where to read each origin from; 1 means nothing was read yet, which is a full copy from 0."""
    from_ = F.greatest(F.coalesce("seq_id", F.lit(0.0)), F.lit(0.0 if system else float(cutoff)), F.coalesce("last_txn", F.lit(0.0)))
    return cursors.select("node", F.when(from_ == 1, 0.0).otherwise(from_).alias("start"))


def transactions(changes: DataFrame, by: str = "node") -> DataFrame:
    """Adds txn: consecutive changes of an origin with equal versions are one transaction; end_txn closes it."""
    known = before(changes, [by], "seq", ["version", "type"])
    new = F.col("_prev_version").isNull() | (F.col("_prev_version") != F.col("version")) | (F.col("_prev_type") == "end_txn")
    numbered = running(known.withColumn("_new", new.cast("long")), [by], ["seq"], {"txn": ("sum", "_new")})
    return numbered.where("type <> 'end_txn'").select(*changes.columns, "txn")


def durable_prefix(frames: DataFrame, by: str) -> DataFrame:
    """(by, cursor): the cursor of the last frame before the first unsettled one; null if there is none."""
    barrier = frames.groupBy(by).agg(F.min(F.when(~F.col("settled"), F.col("frame"))).alias("_stop"))
    safe = frames.join(barrier, by).where(F.col("_stop").isNull() | (F.col("frame") < F.col("_stop"))).groupBy(by).agg(F.max_by("cursor", "frame").alias("cursor"))
    return barrier.select(by).join(safe, by, "left")


def monotone_watermark(changes: DataFrame, by: str, value: str) -> DataFrame:
    """Adds high: the highest value of an origin so far."""
    return running(changes, [by], ["seq"], {"high": ("max", value)})


def handoff(snapshot: DataFrame, log: DataFrame, anchor: float) -> DataFrame:
    """The snapshot's puts and all log changes from the anchor on, which was taken before the copy; merging them again changes nothing."""
    return snapshot.unionByName(log.where(F.col("local_time") >= anchor), allowMissingColumns=True)


def copy_order(tables: DataFrame) -> DataFrame:
    """Tables with their place in the order of a copy: by rank, then as they were made, then by name."""
    return running(tables.withColumn("_one", F.lit(1).cast("long")), [], ["rank", "made", "tbl"], {"place": ("sum", "_one")}).drop("_one")


def last_per_source(entries: DataFrame) -> DataFrame:
    """(source, last): the highest transaction time, malformed entries and null ids left out."""
    rows = entries.select(F.explode("items").alias("e")).where("e.id is not null and e.time is not null and not isnan(e.time)")
    return rows.groupBy(F.col("e.id").alias("source")).agg(F.max("e.time").alias("last"))


def damaged_blobs(records: DataFrame) -> DataFrame:
    """(id, position, blob) of blobs that aren't complete, with their place in the record."""
    return records.select("id", F.posexplode("blobs").alias("position", "b")).where("not b.complete").select("id", "position", F.col("b.name").alias("blob"))


def repair_sources(damaged: DataFrame, holdings: DataFrame) -> DataFrame:
    """For each damaged record, the first peer (by order) that holds all of its blobs complete, at least one."""
    whole = holdings.groupBy("id", "peer", "ord").agg(F.min(F.col("complete").cast("int")).alias("_all"), F.count(F.lit(1)).alias("_n")).where("_all = 1 and _n > 0")
    best = whole.groupBy("id").agg(F.min_by("peer", "ord").alias("peer"))
    return damaged.select("id").distinct().join(best, "id", "left")


def repair_counts(outcomes: DataFrame) -> DataFrame:
    """checked, repaired, failed and no_connection."""
    n = lambda s: F.count_if(F.col("outcome") == s)
    return outcomes.agg(F.count(F.lit(1)).alias("checked"), n("repaired").alias("repaired"), n("failed").alias("failed"), n("noConnection").alias("no_connection"))


def permanent_blob_error(code: Column, status: Column) -> Column:
    """Errors that won't go away: a missing file, 404 or 500; 503 may."""
    return F.coalesce(code == "ENOENT", F.lit(False)) | F.coalesce(status.isin(404, 500), F.lit(False))


def translated(changes: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """Changes with what their short number stands for; unknown numbers stand for null."""
    return changes.join(dictionary, key, "left").drop(key)


def excluding(changes: DataFrame, switches: DataFrame) -> DataFrame:
    """Changes (node, seq) whose node isn't switched off by the last of (node, seq, excluded) at or before them."""
    known = changelog.nearest(changes, switches, "node", "seq", ["excluded"])
    return known.where(~F.coalesce("asof_excluded", F.lit(False))).drop("asof_excluded")


def resume_points(subscriptions: DataFrame, by: str) -> DataFrame:
    """Where to start again: the earliest start, and the cursor with the latest time."""
    return subscriptions.groupBy(by).agg(F.min("start").alias("start"), F.max_by("cursor", "time").alias("cursor"))

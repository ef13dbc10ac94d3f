"""Versioned records from a change log: last write wins, field patches, counters, tombstones.

A change has id, type (put, patch, delete, invalidate), version (double, epoch
ms), node (name of its origin), value (map<string,string>), adds
(map<string,double>) and optionally expires_at. All results depend on the set
of changes only and not on their order, and all of them are grouped aggregates
that Spark combines before it shuffles, so a hot record does no harm. Equal
versions of different nodes are settled by the higher node name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import running

STAMP = ["version", "node"]


def stamp() -> Column:
    return F.struct(*STAMP)


def latest(changes: DataFrame, key: str = "id") -> DataFrame:
    """The winning change of each record."""
    rest = [c for c in changes.columns if c != key]
    best = changes.groupBy(key).agg(F.max_by(F.struct(*rest), stamp()).alias("_w"))
    return best.select(key, *[F.col(f"_w.{c}").alias(c) for c in rest])


def live(changes: DataFrame, key: str = "id") -> DataFrame:
    """Winning changes that aren't deletes; a delete beats older copies and loses to later writes."""
    return latest(changes, key).where("type <> 'delete'")


def record_count(changes: DataFrame, key: str = "id") -> DataFrame:
    return live(changes, key).agg(F.count(F.lit(1)).alias("record_count"))


def _after_base(changes: DataFrame, key: str) -> DataFrame:
    """Changes that count for a record: its last put or delete and what is newer; deletes themselves are left out."""
    base = changes.where(F.col("type").isin("put", "delete")).groupBy(key).agg(F.max(stamp()).alias("_base"))
    return changes.join(base, key, "left").where(F.col("_base").isNull() | (stamp() >= F.col("_base"))).where("type <> 'delete'").drop("_base")


def merged_fields(changes: DataFrame, key: str = "id") -> DataFrame:
    """(key, field, value): each field's last writer since the last put or delete."""
    fields = _after_base(changes, key).select(key, *STAMP, F.explode("value").alias("field", "value"))
    return fields.groupBy(key, "field").agg(F.max_by("value", stamp()).alias("value"))


def merged(changes: DataFrame, key: str = "id") -> DataFrame:
    """(key, record): field patches of concurrent writers merged into one map."""
    return merged_fields(changes, key).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("record"))


def counters(changes: DataFrame, key: str = "id") -> DataFrame:
    """(key, field, total): the last value set, 0 if none, plus all that was added since."""
    rows = _after_base(changes, key)
    added = rows.select(key, *STAMP, F.explode("adds").alias("field", "n"))
    names = added.select("field").distinct()
    put = rows.select(key, *STAMP, F.explode("value").alias("field", "value")).join(names, "field", "left_semi")
    base = put.groupBy(key, "field").agg(F.max(stamp()).alias("_at"), F.max_by("value", stamp()).try_cast("double").alias("_set"))
    total = added.join(base, [key, "field"], "left").groupBy(key, "field").agg(F.sum(F.when(F.col("_at").isNull() | (stamp() > F.col("_at")), F.col("n")).otherwise(0.0)).alias("_sum"), F.max("_set").alias("_set"))
    return total.select(key, "field", (F.coalesce("_set", F.lit(0.0)) + F.col("_sum")).alias("total"))


def without_ties(incoming: DataFrame, local: DataFrame, key: str = "id") -> DataFrame:
    """Incoming changes of which the local side doesn't hold the same version from the same origin (no origin: 0)."""
    origin = lambda df: df.withColumn("_n", F.coalesce(F.col("node").cast("string"), F.lit("0")))
    return origin(incoming).join(origin(local).select(key, "version", "_n"), [key, "version", "_n"], "left_anti").select(*incoming.columns)


def skip_leading(stream: DataFrame, cursors: DataFrame, local: DataFrame, key: str = "id") -> DataFrame:
    """Drops repeated changes at the head of each origin's stream.

    A change is only looked up while no version of its origin has passed the
    origin's cursor; from the first newer version on everything stays.
    """
    first = stream.join(cursors, "node", "left").where(F.col("version") > F.coalesce("cursor", F.lit(0.0))).groupBy("node").agg(F.min("seq").alias("_first"))
    marked = stream.join(first, "node", "left").withColumn("_head", F.col("_first").isNull() | (F.col("seq") < F.col("_first")))
    head = without_ties(marked.where("_head"), local, key)
    return head.unionByName(marked.where("not _head")).select(*stream.columns)


def unexpired(changes: DataFrame, now_ms: float) -> DataFrame:
    """Changes without an expiry or with one still to come."""
    return changes.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(float(now_ms))))


def invalidated(records: DataFrame, key: str, indexed: list[str]) -> DataFrame:
    """What an invalidation keeps of records: key and indexed attributes, others null."""
    return records.select(*[F.col(c) if c in (key, *indexed) else F.lit(None).cast(records.schema[c].dataType).alias(c) for c in records.columns], F.lit("invalidate").alias("type"))


def inserts(records: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to write, rows refused): an insert only adds keys that aren't there."""
    return records.join(existing.select(key), key, "left_anti"), records.join(existing.select(key), key, "left_semi").withColumn("status", F.lit(409))


def upserts(existing: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Existing records with those of equal key replaced."""
    return existing.join(records.select(key), key, "left_anti").unionByName(records, allowMissingColumns=True)


def updates(existing: DataFrame, patch: DataFrame, key: str, given: str | None = None) -> DataFrame:
    """Existing records with the patch's attributes put in, null included.

    `given` names a column of the patch that lists the attributes a row sets;
    without it a row sets all of the patch's. Of rows with the same key the one
    with the greatest values counts, attribute by attribute in their order, so
    a record stays one record. Keys that aren't there are left out.
    """
    names = [c for c in patch.columns if c not in (key, given) and c in existing.columns]
    sets = {c: F.array_contains(given, c) if given else F.lit(True) for c in names}
    one = patch.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*[F.struct(F.coalesce(sets[c], F.lit(False)).alias("set"), F.col(c).alias("new")).alias(c) for c in names])).alias("_p"))
    joined = existing.join(one, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.when(F.col(f"_p.{c}.set"), F.col(f"_p.{c}.new")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in existing.columns])


def altered(existing: DataFrame, request: dict, key: str, allowed: list[str]) -> DataFrame:
    """One record with the allowed fields that the request names put in, null included."""
    hit = F.col(key) == F.lit(request[key])
    return existing.select(*[F.when(hit, F.lit(request[c]).cast(existing.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in allowed and c in request and c != key else F.col(c) for c in existing.columns])


def edited(records: DataFrame, fields: dict[str, Column], items: dict[str, Column]) -> DataFrame:
    """Records with fields inside structures set (`struct.field` by its new value) and items put at the end of lists."""
    changed = {}
    for path, value in fields.items():
        name, inner = path.split(".", 1)
        changed[name] = changed.get(name, F.col(name)).withField(inner, value)
    return records.withColumns({**changed, **{c: F.array_append(F.coalesce(F.col(c), F.array().cast(records.schema[c].dataType)), v) for c, v in items.items()}})


def deletes(existing: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return existing.join(ids.select(key), key, "left_anti")


def as_puts(records: DataFrame, key: str, version: Column, node: Column) -> DataFrame:
    """Records as put changes that carry their origin's node, so a copy isn't taken for a new write."""
    pairs = [p for c in records.columns if c != key for p in (F.lit(c), F.col(c).cast("string"))]
    return records.select(F.col(key).cast("string").alias("id"), F.lit("put").alias("type"), version.cast("double").alias("version"), node.alias("node"), F.create_map(*pairs).alias("value"))


def nearest(left: DataFrame, right: DataFrame, by: str, time: str, columns: list[str]) -> DataFrame:
    """As-of join: the last row of `right` at or before each row of `left`; of several at that time the one with the greatest values."""
    found = F.struct(F.col(time).alias("at"), F.struct(*columns).alias("row"))
    kind = right.select(found.alias("s")).schema["s"].dataType
    both = left.select("*", F.lit(None).cast(kind).alias("_right"), F.lit(1).alias("_side")).unionByName(right.select(by, time, found.alias("_right"), F.lit(0).alias("_side")), allowMissingColumns=True)
    known = running(both, [by], [time, "_side"], {"_last": ("max", "_right")}).where("_side = 1")
    return known.select(*left.columns, *[F.col(f"_last.row.{c}").alias(f"asof_{c}") for c in columns])

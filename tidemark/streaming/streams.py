"""Subscriptions over change streams, tumbling periods, topic filters and per-key rate windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import topic_regex
from tidemark.operators.changelog import latest, stamp
from tidemark.sources.shared import shared_path


def subscription(spark: SparkSession, path: str, schema, id_value=None, per_trigger: int | None = None) -> DataFrame:
    """Changes as they arrive in a folder of parquet files; end_txn markers are left out, an id narrows to one key."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    rows = reader.parquet(path)
    rows = rows.where("type <> 'end_txn'") if "type" in rows.columns else rows
    return rows if id_value is None else rows.where(F.col("id") == id_value)


def watched_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files as they appear in a folder."""
    return spark.readStream.text(folder)


def with_current(current: DataFrame, changes: DataFrame) -> DataFrame:
    """What a subscriber with current state sees: the records as puts, then the changes."""
    return current.withColumn("type", F.lit("put")).unionByName(changes, allowMissingColumns=True)


def tumbling(events: DataFrame, time: str, dims: list[str], value: str, period: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """period, dims, n, total per period; batch and stream alike."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_t", late) if events.isStreaming else timed
    return timed.groupBy(F.window("_t", period).alias("_w"), *dims).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("_w.start").alias("period"), *dims, "n", "total")


def on_topics(messages: DataFrame, topic: str, filters: list[str]) -> DataFrame:
    """Messages of which the topic matches any filter, each once."""
    return messages.where(F.col(topic).rlike("|".join(f"(?:{topic_regex(f)})" for f in filters)))


def retained(messages: DataFrame, topic: str) -> DataFrame:
    """The latest message of each topic."""
    rest = [c for c in messages.columns if c != topic]
    return messages.groupBy(topic).agg(F.max_by(F.struct(*rest), stamp()).alias("_m")).select(topic, *[F.col(f"_m.{c}").alias(c) for c in rest])


def merge_into(path: str, key: str = "id", buckets: int = 64):
    """A foreachBatch function that keeps winning changes of each key in a folder, bucket by bucket.

    A batch rewrites only the buckets that its keys fall into, each as a new
    version `b=<bucket>/v=<epoch>`, and then names the current version of every
    bucket in `current/e=<epoch>`; `merged` reads through the latest of these. A
    batch that runs again finds the pointer of the batch before it and gives the
    same rows. Versions that the last two pointers don't name are removed.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = _pointer(spark, path, before=epoch)
        rows = batch.withColumn("b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        rows.write.mode("overwrite").partitionBy("b").parquet(f"{path}/incoming/e={epoch}")  # the source is read once
        incoming = spark.read.schema(rows.schema).parquet(f"{path}/incoming/e={epoch}")
        touched = sorted(r.b for r in incoming.select("b").distinct().collect())  # `buckets` at most
        held = [f"{path}/b={b}/v={before[b]}" for b in touched if b in before]
        if held:
            incoming = incoming.unionByName(spark.read.parquet(*held), allowMissingColumns=True)
        for_bucket = latest(incoming.drop("b"), key).withColumn("b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        for_bucket.withColumn("_b", F.col("b")).write.mode("overwrite").partitionBy("_b").parquet(f"{path}/merged/e={epoch}")
        fs, root = _folder(spark, path)
        at = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *parts]))
        for b in touched:
            fs.mkdirs(at(f"b={b}"))
            fs.delete(at(f"b={b}", f"v={epoch}"), True)
            fs.rename(at("merged", f"e={epoch}", f"_b={b}"), at(f"b={b}", f"v={epoch}"))
        now = before | dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(now.items()), "b int, v long").coalesce(1).write.mode("overwrite").parquet(f"{path}/current/e={epoch}")
        for b in touched:
            if b in before:
                older = [s.getPath() for s in fs.listStatus(at(f"b={b}"))]
                for p in older:
                    if int(p.getName()[2:]) < before[b]:
                        fs.delete(p, True)
        for old in ("incoming", "merged"):
            fs.delete(at(old, f"e={epoch}"), True)

    return run


def _folder(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _pointer(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket that the latest pointer (of a batch before this one) names."""
    fs, root = _folder(spark, f"{path}/current")
    done = [int(s.getPath().getName()[2:]) for s in (fs.listStatus(root) if fs.exists(root) else []) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    done = [e for e in done if before is None or e < before]
    return {r.b: r.v for r in spark.read.parquet(f"{path}/current/e={max(done)}").collect()} if done else {}


def merged(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows that merge_into keeps at a path, of its latest finished batch; with a schema, none before the first."""
    if schema is not None and not _pointer(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("mergeSchema", True).parquet(*[f"{path}/b={b}/v={v}" for b, v in sorted(_pointer(spark, path).items())]).drop("b")


def excluding_stream(changes: DataFrame, switches) -> DataFrame:
    """Changes of a stream without those of origins that are switched off, by a table that is read again with every batch.

    `switches` gives rows (node, excluded) when called with the session; of a
    node's rows any that excludes it counts. Runs inside foreachBatch, so that
    an origin put on the list or taken off it takes effect with the next batch.
    """
    off = switches(changes.sparkSession).where("excluded").select("node").distinct()
    return changes.join(off, "node", "left_anti").select(*changes.columns)


def each_period(stream: DataFrame, path: str, checkpoint: str, hooks: list, switches=None):
    """Runs a stream over all that is there; each micro-batch goes to every hook, a function of (rows, epoch), and to files.

    Rows of excluded origins are left out first (excluding_stream). A batch
    that runs again overwrites its own files.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        rows = excluding_stream(batch, switches) if switches else batch
        rows.write.mode("overwrite").parquet(f"{path}/_batch={epoch}")
        kept = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/_batch={epoch}")
        for hook in hooks:
            hook(kept, epoch)

    stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{path}/_batch=-1")
    stream.writeStream.foreachBatch(run).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path).select(*stream.columns)


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives its rows.

    The rows go to files beside the checkpoint, both in the shared folder if no
    checkpoint is given, and are read from there; none pass the driver. With
    the checkpoint of an earlier call a stream goes on and gives all its rows.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or f"{shared_path(spark, name)}/checkpoint"
    out = f"{checkpoint.rstrip('/')}-rows"
    writer = stream.writeStream.outputMode(mode).queryName(name).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    nothing = spark.createDataFrame([], stream.schema).write.mode("ignore")
    if mode == "append":
        nothing.parquet(out)
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_written={0 if mode == 'complete' else epoch}")

    nothing.parquet(f"{out}/_written=-1")
    writer.foreachBatch(run).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


RATE_SCHEMA = "key string, time_ms long, allowed boolean, suppressed long"


def rate_windows(events: DataFrame, key: str, time_ms: str, limit: int, interval_ms: int) -> DataFrame:
    """(key, time_ms, allowed, suppressed) of each event under a limit per key and interval.

    A key's window opens at its first event and again at the first event that
    comes `interval_ms` or more later. The first `limit` events are allowed;
    `suppressed` is the count that an opening window reports of the one before.
    Partitions are sorted and read as a stream, so memory doesn't grow with a key.
    """

    def run(batches):
        import pandas as pd

        at, opened, count, held = None, 0, 0, 0
        for batch in batches:
            allowed, summary = [], []
            for k, t in zip(batch["key"], batch["time_ms"], strict=True):
                if k != at or t - opened >= interval_ms:
                    summary.append(held if k == at else 0)
                    at, opened, count, held = k, t, 1, 0
                    allowed.append(True)
                else:
                    ok = count < limit
                    count, held = count + ok, held + (not ok)
                    allowed.append(ok)
                    summary.append(0)
            yield pd.DataFrame({"key": batch["key"], "time_ms": batch["time_ms"], "allowed": allowed, "suppressed": summary})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(time_ms).cast("long").alias("time_ms")).where("key is not null and time_ms is not null")
    return rows.repartition("key").sortWithinPartitions("key", "time_ms").mapInPandas(run, RATE_SCHEMA)


def rate_windows_stream(events: DataFrame, key: str, time_ms: str, limit: int, interval_ms: int) -> DataFrame:
    """The same over a stream, with the open window of each key as state.

    What a key brings in one trigger is sorted by time, 8 bytes a row; events
    that come after later ones were decided count at the time of their trigger.
    """

    def run(k, batches, state):
        import numpy as np
        import pandas as pd

        opened, count, held = state.get if state.exists else (None, 0, 0)
        # A trigger's rows of a key may come in several chunks, in any order between them.
        whole = np.sort(np.concatenate([b["time_ms"].to_numpy(np.int64) for b in batches]))
        for at in range(0, len(whole), 65536):
            allowed, summary = [], []
            times = whole[at : at + 65536].tolist()
            for t in times:
                if opened is None or t - opened >= interval_ms:
                    summary.append(held)
                    opened, count, held = t, 1, 0
                    allowed.append(True)
                else:
                    ok = count < limit
                    count, held = count + ok, held + (not ok)
                    allowed.append(ok)
                    summary.append(0)
            yield pd.DataFrame({"key": [k[0]] * len(times), "time_ms": times, "allowed": allowed, "suppressed": summary})
        state.update((int(opened), int(count), int(held)))

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(time_ms).cast("long").alias("time_ms"))
    return rows.groupBy("key").applyInPandasWithState(run, RATE_SCHEMA, "opened long, count long, held long", "append", "NoTimeout")

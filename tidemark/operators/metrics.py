"""Metric roll-ups, usage metering, profile attribution and throughput figures."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import before, running, stretch
from tidemark.sources.shared import shared_path

LIMITS = ["reads", "writes", "readBytes", "writeBytes", "realTimeMessages", "realTimeBytes", "cpuTime", "storage"]


def rollup(actions: DataFrame, time: str, value: str, dims: list[str], period: str = "60 seconds") -> DataFrame:
    """period start, dims, count, mean of recorded actions."""
    return actions.groupBy(F.window(time, period).alias("_w"), *dims).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean")).select(F.col("_w.start").alias("period"), *dims, "count", "mean")


def metering(rolled: DataFrame, by: list[str]) -> DataFrame:
    """Usage from rolled-up metrics (metric, path, count, mean): counts, bytes (mean x count) and CPU hours of user code."""
    amount = F.col("mean") * F.col("count")

    def total(metric: str, what, extra=None):
        hit = F.col("metric") == metric
        return F.sum(F.when(hit if extra is None else hit & extra, what).otherwise(0.0))

    return rolled.groupBy(*by).agg(
        total("db-read", F.col("count")).alias("reads"), total("db-write", F.col("count")).alias("writes"), total("db-read", amount).alias("read_bytes"), total("db-write", amount).alias("write_bytes"),
        total("db-message", F.col("count")).alias("messages"), total("db-message", amount).alias("message_bytes"), total("cpu-usage", amount / 3600, F.coalesce(F.col("path") == "user", F.lit(False))).alias("cpu_time"),
    )


def within_quota(limits: list[str] = LIMITS) -> Column:
    """Every limit is -1 or more than what was used; nothing used counts as 0."""
    out = F.lit(True)
    for name in limits:
        out = out & ((F.col(name) == -1) | (F.coalesce(F.col(f"used_{name}"), F.lit(0)) < F.col(name)))
    return out


def attribute_cpu(samples: DataFrame, user_prefix: str, package_prefix: str, seconds: float = 0.05, least_hits: int = 100) -> tuple[DataFrame, DataFrame]:
    """(totals of user and platform seconds, seconds by location) of samples (id, value, frames array<string> from the top).

    Walking down a stack, every platform frame adds the sample to the platform
    total, and the first user frame adds it to the user total and ends the
    walk. The first platform frame is credited with the sample; the user frame
    only where no platform frame came before it. Locations of `least_hits` or
    fewer are left out.
    """
    frames = samples.select("id", "value", F.posexplode("frames").alias("pos", "frame"))
    user, platform = F.col("frame").startswith(user_prefix), F.col("frame").startswith(package_prefix) & ~F.col("frame").startswith(user_prefix)
    firsts = frames.groupBy("id").agg(F.min(F.when(user, F.col("pos"))).alias("_user"), F.min(F.when(platform, F.col("pos"))).alias("_platform"))
    walked = frames.join(firsts, "id").where(F.col("_user").isNull() | (F.col("pos") <= F.col("_user")))
    is_user, is_platform = F.col("pos") == F.col("_user"), platform
    totals = walked.agg(F.coalesce(F.sum(F.when(is_user, F.col("value"))), F.lit(0)).alias("u"), F.coalesce(F.sum(F.when(is_platform, F.col("value"))), F.lit(0)).alias("p")).select((F.col("u") * seconds).alias("user"), (F.col("p") * seconds).alias("platform"))
    credited = walked.where((is_platform & (F.col("pos") == F.col("_platform"))) | (is_user & (F.col("_platform").isNull() | (F.col("_platform") > F.col("_user")))))
    places = credited.groupBy("frame").agg(F.sum("value").alias("hits")).where(F.col("hits") > least_hits).select(F.col("frame").alias("location"), (F.col("hits") * seconds).alias("seconds"))
    return totals, places


def star_samples(samples: DataFrame, locations: DataFrame, functions: DataFrame, strings: DataFrame) -> DataFrame:
    """(id, value, frames): samples whose location ids are resolved to `file:line` through functions and strings."""
    steps = samples.select("id", "value", F.posexplode("location_ids").alias("pos", "location_id"))
    named = steps.join(locations, "location_id").join(functions, "function_id").join(strings, F.col("file_id") == F.col("string_id"))
    ordered = named.groupBy("id", "value").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", "text", "line").alias("f")))).alias("_f"))
    return ordered.select("id", "value", F.transform("_f", lambda x: x["f"]).alias("frames"))


def gpu_seconds(usage: DataFrame, pids: DataFrame, period: float) -> DataFrame:
    """GPU seconds of a set of processes in a period: sum of percent / 100 x seconds."""
    return usage.join(pids.select("pid").distinct(), "pid", "left_semi").agg((F.coalesce(F.sum("sm"), F.lit(0)) / 100 * period).alias("gpu_seconds"))


def child_cpu(samples: DataFrame, by: str, order: str) -> DataFrame:
    """Seconds of CPU since the sample before, where over a thousandth; samples hold ticks of 1/100 s."""
    total = F.col("utime") + F.col("stime") + F.col("cutime") + F.col("cstime")
    sums = samples.groupBy(by, order).agg((F.sum(total) / 100).alias("cpu"))
    return before(sums, [by], order, ["cpu"]).withColumn("delta", F.col("cpu") - F.col("_prev_cpu")).drop("_prev_cpu").where("delta > 0.001")


def descendants(processes: DataFrame, root: int) -> DataFrame:
    """(pid) of all descendants of a process, however deep; a cycle is walked once.

    Each round doubles the length of the ways up that are known, until they have
    met the root or an end, so n processes take log n rounds at most. Rounds
    are written to the shared folder.
    """
    spark, path = processes.sparkSession, shared_path(processes.sparkSession, "descendants")
    ways = processes.select(F.col("pid").cast("long").alias("pid"), F.col("ppid").cast("long").alias("up")).where(f"pid <> up and pid <> {int(root)}")
    ways = ways.distinct().withColumn("found", F.col("up") == int(root))
    for k in itertools.count():
        ways.write.parquet(f"{path}/{k}")
        ways = spark.read.parquet(f"{path}/{k}")
        n, unsettled = ways.agg(F.count(F.lit(1)), F.count_if(~F.col("found"))).first()
        if not unsettled or 1 << k > n:  # whoever isn't settled now walks in a circle
            break
        a, b = ways.alias("a"), ways.alias("b")
        further = a.where("not found").join(b, F.col("a.up") == F.col("b.pid")).select("a.pid", "b.up", "b.found")
        ways = ways.where("found").union(further).distinct()
    return ways.where("found").select("pid").distinct()


def index_percentiles(values: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """count, mean and the sorted values at place min(n - 1, floor(n q)), counted from 0; nothing is interpolated.

    Equal values are counted before they are sorted, so a group has no more
    rows in its window than it has distinct values.
    """
    counted = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    sizes = counted.groupBy(*by).agg(F.sum("_c").alias("_n"))
    placed = running(counted, by, [value], {"_end": ("sum", "_c")}).join(sizes, by)
    out = [F.max("_n").alias("count"), (F.sum(F.col(value) * F.col("_c")) / F.max("_n")).alias("mean")]
    for name, q in at.items():
        place = F.least(F.col("_n") - 1, F.floor(F.col("_n") * q))
        out.append(F.min(F.when(F.col("_end") > place, F.col(value))).alias(name))
    return placed.groupBy(*by).agg(*out)


def backpressure(samples: DataFrame, by: str, order: str, window_s: float = 30.0) -> DataFrame:
    """(by, ratio): an exponentially weighted share of paused time; each step is (r T + paused d) / (T + d).

    A step is the affine map r -> a r + b, and maps compose, so runs of up to a
    hundred samples are folded first, then the runs of a stretch of the order,
    then the stretches of a key.
    """
    numbered = samples.withColumn("_stretch", stretch(samples, order))
    numbered = numbered.withColumn("_run", F.expr(f"(row_number() over (partition by {by}, _stretch order by {order}) - 1) div 100"))
    a = F.lit(window_s) / (F.lit(window_s) + F.col("duration"))
    b = F.when(F.col("paused"), F.col("duration")).otherwise(0.0) / (F.lit(window_s) + F.col("duration"))

    def fold(rows: DataFrame, keys: list[str], first: str) -> DataFrame:
        listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(first).alias("_o"), F.col("_a"), F.col("_b")))).alias("_l"))
        start = F.struct(F.lit(1.0).alias("_a"), F.lit(0.0).alias("_b"))
        done = F.aggregate("_l", start, lambda s, x: F.struct((s["_a"] * x["_a"]).alias("_a"), (s["_b"] * x["_a"] + x["_b"]).alias("_b")))
        return listed.select(*keys, done.alias("_m")).select(*keys, F.col("_m._a").alias("_a"), F.col("_m._b").alias("_b"))

    runs = fold(numbered.select(by, "_stretch", "_run", F.col(order).alias("_t"), a.alias("_a"), b.alias("_b")), [by, "_stretch", "_run"], "_t")
    return fold(fold(runs, [by, "_stretch"], "_run"), [by], "_stretch").select(by, F.col("_b").alias("ratio"))


def throughput(progress: DataFrame, by: str, time: str, size: str, window: str = "180 seconds") -> DataFrame:
    """(by, window start, mb_s) from byte counts, windows before the first byte left out."""
    first = progress.where(F.col(size) > 0).groupBy(by).agg(F.min(time).alias("_first"))
    rows = progress.join(first, by).where(F.col(time) >= F.col("_first"))
    spans = rows.groupBy(by, F.window(time, window).alias("_w")).agg(F.sum(size).alias("_bytes"))
    return spans.select(by, F.col("_w.start").alias("window"), (F.col("_bytes") / 1e6 / (F.unix_seconds("_w.end") - F.unix_seconds("_w.start"))).alias("mb_s"))


def slow_share(spans: DataFrame, by: str, floor: float) -> DataFrame:
    """Peak, mean and how many windows were below a floor."""
    return spans.groupBy(by).agg(F.max("mb_s").alias("peak"), F.avg("mb_s").alias("mean"), F.count_if(F.col("mb_s") < floor).alias("slow"))

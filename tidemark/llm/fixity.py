"""WARC fixity audit with Merkle trees.

Pages become WARC records, laid by a hash of their ids into files of about
`file_records` records, in order of their ids; a record's range starts where
the one before it ends. A leaf is the hash of a record's range and bytes, a node the hash of up
to `fan` children in order, and each file has one root. Two replicas are
compared root by root; of files whose roots differ, only the branches that
differ are followed down, one join a level, and what is left at the leaves is
where the damage lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, key60, pick


def record(url: Column, html: Column) -> Column:
    """The text of a WARC response record; a null url is empty, a null html has no length and no body, unlike an empty one."""
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")))
    length = F.coalesce(F.concat(F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string")), F.lit(""))
    return F.concat(head, length, F.lit("\r\n\r\n"), F.coalesce(html, F.lit("")), F.lit("\r\n\r\n"))


def hashed(pages: DataFrame) -> DataFrame:
    """page_id, length, sha, copies: the distinct records of a replica; texts are read once and don't leave their tasks."""
    rows = pick(pages, page_id="bigint", url="string", html="string").select("page_id", record(F.col("url"), F.col("html")).alias("_text"))
    rows = rows.select("page_id", F.octet_length("_text").cast("long").alias("length"), F.sha2("_text", 256).alias("sha"))
    return rows.groupBy("page_id", "length", "sha").agg(F.count(F.lit(1)).alias("copies"))


def crowded(*replicas: DataFrame, file_records: int = 256) -> DataFrame:
    """(page_id) of which a replica holds more different records than a file should; also the missing id."""
    counts = [r.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n")) for r in replicas]
    every = counts[0]
    for c in counts[1:]:
        every = every.union(c)
    return every.where((F.col("_n") > file_records) | F.col("page_id").isNull()).select("page_id").distinct()


def laid(replica: DataFrame, files: int, many: DataFrame) -> DataFrame:
    """page_id, file, at (place in the file), offset, length, sha, leaf of all records.

    `replica` is what hashed() gives. A file holds the ids whose hashes give its
    number. The records of the ids in `many` (and those without one) are spread
    by their own hashes instead, over the negative numbers. Records of one id lie beside each
    other, ordered by their hashes; equal ones are counted and not sorted.
    """
    rows = replica.join(many.withColumn("_many", F.lit(True)), replica.page_id.eqNullSafe(many.page_id), "left").select(replica["*"], "_many")
    rows = rows.withColumn("file", F.when(F.col("_many"), -1 - key60(F.col("sha")) % files).otherwise(key60(F.col("page_id")) % files).cast("long"))
    upto = Window.partitionBy("file").orderBy("page_id", "sha").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_at", F.sum("copies").over(upto) - F.col("copies")).withColumn("_offset", F.sum(F.col("length") * F.col("copies")).over(upto) - F.col("length") * F.col("copies"))
    rows = rows.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = rows.select("page_id", "file", (F.col("_at") + F.col("_nth")).alias("at"), (F.col("_offset") + F.col("_nth") * F.col("length")).alias("offset"), "length", "sha")
    return rows.withColumn("leaf", F.sha2(F.concat_ws(":", "offset", "length", "sha"), 256))


def records(pages: DataFrame, file_records: int = 256) -> DataFrame:
    """The records of one replica in files of about `file_records`, as laid() gives them."""
    own = cut(hashed(pages))
    return laid(own, files_for(own, file_records), crowded(own, file_records=file_records))


def files_for(replica: DataFrame, file_records: int) -> int:
    n = replica.agg(F.sum("copies")).first()[0] or 0
    return max(1, -(-int(n) // file_records))


def levels(leaves: DataFrame, fan: int = 16) -> list[DataFrame]:
    """(file, at, hash) from the leaves up to the roots; each level has a fan-th of the rows of the one below."""
    out = [leaves.select("file", "at", F.col("leaf").alias("hash"))]
    most = out[0].agg(F.max("at")).first()[0] or 0
    while most > 0 or len(out) == 1:
        most //= fan
        below = out[-1].groupBy("file", F.expr(f"at div {fan}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("_c"))
        out.append(below.select("file", F.col("up").alias("at"), F.sha2(F.concat_ws("", F.transform("_c", lambda c: c["hash"])), 256).alias("hash")))
    return out


def audit(left: DataFrame, right: DataFrame, fan: int = 16) -> DataFrame:
    """(file, at) of the records in which two replicas differ, records of one side only included.

    Both sides have file, at and leaf, as laid() gives them, none of them null;
    each (file, at) is there once. An empty side differs in all records of the
    other, two empty ones in none.
    """
    left, right = cut(left.select("file", "at", "leaf")), cut(right.select("file", "at", "leaf"))
    a, b = levels(left, fan), levels(right, fan)
    while len(a) < len(b):
        a.append(a[-1])
    while len(b) < len(a):
        b.append(b[-1])
    differ = None
    for down, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=True)):
        if down:
            up = [F.col("file"), F.expr(f"at div {fan}").alias("_up")]
            x, y = (s.withColumn("_up", up[1]).join(differ, ["file", "_up"], "left_semi").select("file", "at", "hash") for s in (x, y))
        x, y = x.withColumnRenamed("hash", "_x"), y.withColumnRenamed("hash", "_y")
        found = x.join(y, ["file", "at"], "full").where(~F.col("_x").eqNullSafe(F.col("_y")))
        differ = found.select("file", F.col("at").alias("_up"))
    return differ.select("file", F.col("_up").alias("at"))


def located(pages: DataFrame, replica: DataFrame, file_records: int = 256, fan: int = 16) -> DataFrame:
    """page_id, file, offset, length, damaged, status: every record of `pages`, and those that only the replica holds.

    Of records that differ, those of the same id (without one, or of an id with
    more than `file_records` different records: of the same bytes) and file are
    compared, repeated ones in order: `changed` in bytes, `moved` to another
    range, `lost` by the replica, or `gained` by it, with the replica's range.
    All others are `same` and not damaged. A null url counts as empty; a null
    html differs from an empty one. Of an empty side all records are gained or
    lost; extra columns are not looked at.
    """
    left, right = cut(hashed(pages)), cut(hashed(replica))
    files, many = files_for(left, file_records), cut(crowded(left, right, file_records=file_records))
    own, other = cut(laid(left, files, many)), cut(laid(right, files, many))
    bad = cut(audit(own, other, fan))
    who = [F.col("file"), F.coalesce("page_id", F.lit(0)), F.col("page_id").isNull(), F.when(F.col("file") < 0, F.col("sha")).otherwise("")]
    # Equal records are told apart by their number, so the key of a row is its own.
    nth = F.row_number().over(Window.partitionBy(*who).orderBy("at"))
    a, b = (s.join(bad, ["file", "at"], "left_semi").select("page_id", "file", "at", "offset", "length", "sha", *[w.alias(f"_w{k}") for k, w in enumerate(who)], nth.alias("_w4")) for s in (own, other))
    a, b = a.alias("a"), b.alias("b")
    pair = a.join(b, [F.col(f"a._w{k}") == F.col(f"b._w{k}") for k in range(5)], "full")
    status = F.when(F.col("b.file").isNull(), "lost").when(F.col("a.file").isNull(), "gained").when(F.col("a.sha") != F.col("b.sha"), "changed").otherwise("moved")
    differ = pair.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("page_id", "file", "offset", "length")], F.lit(True).alias("damaged"), status.alias("status"))
    same = own.join(bad, ["file", "at"], "left_anti").select("page_id", "file", "offset", "length", F.lit(False).alias("damaged"), F.lit("same").alias("status"))
    return same.unionByName(differ)

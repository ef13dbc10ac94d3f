"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; a bit is set where over half of the hashes of the
text's word shingles have it. Two fingerprints within three bits of each other
differ by at most one bit in one of their 32-bit halves. So for each half a
fingerprint emits all variants within half the radius (one bit), the halves of
even parity standing still and those of odd parity moving, and the shuffle is
on variants: 17 rows on average for a half instead of the 2,081 variants of
the whole word. Fingerprints that meet in a cell are verified on all 64 bits.

Equal fingerprints are one before anything is emitted. A cell of up to
`cell_limit` fingerprints is verified as bit operations on one small array. In
a larger cell the other half is hashed in the same way once more: even halves
emit themselves and their two-bit variants, odd ones their one-bit variants,
and whoever meets at a variant is linked to the nearest there as far as both
distances sum to three at most, which the triangle inequality makes a true
link. Either way rows grow with the members of a cell and not with its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import cut, numbered, pick

SEED = 42
RADIUS = 3


def fingerprint(text: bytes, words_per: int = 3) -> int:
    """The fingerprint of a text, as a signed 64-bit number. No words: 0."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words) - words_per + 1
    if not words:
        return 0
    if n < 2:
        h = xxh64_intdigest(b" ".join(words), SEED)
        return h - (1 << 64) if h >> 63 else h
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    total = np.zeros(64, np.int64)
    spans = zip(starts, (ends[words_per - 1 :] - 1).tolist(), strict=True)
    for k in range(0, n, 65536):
        part = min(65536, n - k)
        h = np.fromiter((xxh64_intdigest(whole[a:b], SEED) for (a, b), _ in zip(spans, range(part), strict=False)) if part < n - k else (xxh64_intdigest(whole[a:b], SEED) for a, b in spans), np.uint64, part)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) of each row; null and empty texts have fingerprint 0.

    Repeated rows come out each time, an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            raw = batch.column("text").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t.as_py() or b"") for t in raw], pa.int64())], ["doc_id", "fp"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id long, fp long")


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """For every fingerprint that links to others here, an edge to the first of its group."""
    n = len(fps)
    bits = fps.view(np.uint64)  # of a signed number, numpy counts the bits of its absolute value
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= RADIUS
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(1)
        least = least[least]
        if (least == label).all():
            return [(int(fps[i]), int(fps[j])) for i, j in enumerate(label) if i != j]
        label = least


def links(fps: DataFrame, cell_limit: int = 256) -> DataFrame:
    """Edges (u, v) that join all distinct fingerprints `fp` within three bits into the right groups."""
    half = {0: F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), 1: F.shiftrightunsigned("fp", 32)}

    def variants(h: int):
        # A cell is the half's number above its 32 bits; flips tells how far the half was moved.
        still = F.struct((F.lit(h << 32).bitwiseOR(half[h])).alias("cell"), F.lit(0).alias("flips"))
        moved = F.transform(F.lit([1 << b for b in range(32)]).cast("array<bigint>"), lambda m: F.struct(F.lit(h << 32).bitwiseOR(half[h].bitwiseXOR(m)).alias("cell"), F.lit(1).alias("flips")))
        return F.when(F.bit_count(half[h]) % 2 == 1, F.concat(F.array(still), moved)).otherwise(F.array(still))

    emitted = fps.select("fp", F.explode(F.concat(variants(0), variants(1))).alias("c")).select("c.cell", "fp", "c.flips")
    standing = fps.select(F.explode(F.array(half[0], F.lit(1 << 32).bitwiseOR(half[1]))).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("_still"))
    met = emitted.join(standing, "cell").select("cell", "fp", "flips")
    counts = met.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(met.join(counts, "cell"))

    def verify(batches):
        for batch in batches:
            found = [e for fs in batch.column("fps").to_pylist() for e in _forest(np.array(fs, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], ["u", "v"])

    small = members.where(F.col("n") <= cell_limit).groupBy("cell").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(verify, "u long, v long")

    other = F.when(F.col("cell") < (1 << 32), half[1]).otherwise(half[0])
    one = [1 << b for b in range(32)]
    two = [a | b for i, a in enumerate(one) for b in one[i + 1 :]]

    def moves(masks: list[int], far: int):
        return F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.struct(F.col("_other").bitwiseXOR(m).alias("w"), (F.col("flips") + far).alias("s")))

    large = members.where(F.col("n") > cell_limit).select("cell", "fp", "flips", other.alias("_other"))
    balls = large.select("cell", "fp", F.explode(F.when(F.bit_count("_other") % 2 == 1, moves(one, 1)).otherwise(F.concat(moves([0], 0), moves(two, 2)))).alias("x"))
    balls = balls.select("cell", "x.w", "x.s", "fp").where("s <= 2")
    centres = balls.groupBy("cell", "w").agg(F.min(F.struct("s", "fp")).alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1 and centre.s <= 1").select("cell", "w", "centre")
    far = balls.join(centres, ["cell", "w"]).where((F.col("s") + F.col("centre.s") <= RADIUS) & (F.col("fp") != F.col("centre.fp"))).select(F.col("fp").alias("u"), F.col("centre.fp").alias("v"))
    return small.union(far)


def components(docs: DataFrame, cell_limit: int = 256) -> DataFrame:
    """doc_id, fp, component_id for every row.

    component_id is the smallest doc_id that links reach, the row's own
    included; null only where a whole group has no doc_id. Texts without words
    have fingerprint 0 and link like any other. Repeated rows are equal
    fingerprints. An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(distinct.select("fp"), cell_limit))
    grouped = roots.join(distinct, roots.node == distinct.fp).groupBy("root").agg(F.min("first").alias("least"))
    of = roots.join(grouped, "root").select(F.col("node").alias("fp"), "least")
    # A table of its own, so that the join below has an exchange on either side and Spark can split a hot fingerprint.
    named = cut(distinct.join(of, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """The documents without those whose group has a smaller doc_id; columns as given.

    Rows without a doc_id stay. Of rows that repeat a doc_id, one stays.
    Extra columns may have any names.
    """
    found = components(docs, **kw).groupBy("doc_id").agg(F.min("component_id").alias("_c"), F.count(F.lit(1)).alias("_n"))
    ruled = found.where("doc_id is not null and (doc_id <> _c or _n > 1)").select(F.col("doc_id").alias("_id"), (F.col("doc_id") == F.col("_c")).alias("_again"))
    ruled = cut(ruled)
    rows, (own,) = numbered(docs, "doc_id")
    once = rows.join(ruled, F.col(own) == F.col("_id"), "left_anti")
    again = rows.join(ruled.where("_again"), F.col(own) == F.col("_id"), "left_semi").dropDuplicates([own])
    return once.union(again).toDF(*docs.columns)

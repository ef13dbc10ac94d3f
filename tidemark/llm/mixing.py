"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Size of a document: its count of words. Sources weigh 1, 2, 3, repeating by
code point (null last) and share the wanted total; a target stops at `cap`
times its source's size and the excess is shared again by weight.

The wanted total is cut into blocks of `block_words` words. Highest quotients
target / (2 k + 1) give every source its whole number of blocks, and highest
quotients of shard sizes give every shard of a source its quota. Inside a
shard, documents lie in seeded order; a quota of q blocks over n takes every
block q div n times and q mod n evenly spread blocks once more, from a seeded
start. What a document gives is the overlap of its words with the taken
blocks, which has a closed form, so no block is ever a row.

Both apportionments rank only the quotients between two divisors that bracket
the answer, at most two rows a party and two of slack, whatever the number of
seats. A source of n documents has about the square root of n / 16 shards, so
neither the shards of a source nor the documents of a shard become too many for
one window. Rows that agree in id, source and size are laid as one with a
count, in pieces of up to `piece_rows`, so that neither rows without an id nor
repeated ones crowd a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, key60, numbered, pick

WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """How many words the text has (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apportion(parties: DataFrame, votes: str, seats: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds `quota`: the seats of each party within `by`, by highest v / (2 k + 1).

    `seats` holds the same number in all rows of a group. Ties go to the first
    in `order`. Parties without votes get none.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    v = F.col(votes).cast("double")
    bracket = (
        parties.withColumn("_v", F.sum(v).over(group))
        .withColumn("_n", F.sum((v > 0).cast("double")).over(group))
        .withColumn("_low", F.when((v > 0) & (F.col(seats) > F.col("_n") / 2), F.greatest(F.lit(0.0), F.floor(v * (F.col(seats) - F.col("_n") / 2) / F.col("_v") + 0.5) - 1)).otherwise(0.0).cast("long"))
        .withColumn("_high", F.when(v > 0, F.floor(v * (F.col(seats) + F.col("_n") / 2) / F.col("_v") + 0.5) + 1).otherwise(0.0).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    )
    ranked = Window.partitionBy(*by).orderBy(F.desc("_q"), *[F.col(c).asc_nulls_last() for c in order]) if by else Window.orderBy(F.desc("_q"), *[F.col(c).asc_nulls_last() for c in order])
    quotients = (
        bracket.select("*", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1))).alias("_k"))
        .withColumn("_q", F.when(F.col("_k").isNotNull(), v / (2 * F.col("_k") + 1)).otherwise(-1.0))
        .withColumn("_won", ((F.row_number().over(ranked) <= F.col("_open")) & (F.col("_q") > 0)).cast("long"))
    )
    return quotients.groupBy(*parties.columns, "_low").agg(F.sum("_won").alias("_won")).select(*parties.columns, (F.col("_low") + F.col("_won")).alias("quota"))


def targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Adds `weight` and `target` to one row per source with its source_size.

    There is one row per source, so the windows without a partition are over a
    table that grows with the number of sources and not with the documents.
    """
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    ratio = Window.orderBy((F.col("source_size") * cap / F.col("weight")), "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    most = F.col("source_size") * cap
    filled = (
        ranked.withColumn("_total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("_weights", F.sum("weight").over(Window.partitionBy()))
        .withColumn("_before", F.sum(most).over(ratio) - most)
        .withColumn("_weights_before", F.sum("weight").over(ratio) - F.col("weight"))
        .withColumn("_capped", most * (F.col("_weights") - F.col("_weights_before")) <= F.col("weight") * (F.col("_total") - F.col("_before")))
        .withColumn("_fixed", F.sum(F.when(F.col("_capped"), most).otherwise(0)).over(Window.partitionBy()))
        .withColumn("_free", F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("weight"))).over(Window.partitionBy()))
    )
    share = (F.col("weight") * (F.col("_total") - F.col("_fixed"))).cast("double") / F.col("_free")
    return filled.withColumn("target", F.when(F.col("_capped"), most.cast("double")).otherwise(share)).select(*sources.columns, "weight", "_total", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block_words: int = 16, shard_docs: int = 16, piece_rows: int = 256, seed: int = 17) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    Null text has size 0; null sources are one source, last in order; rows
    without a doc_id are mixed like others. Repeated rows are mixed as rows of
    their own. Equal quotients go to the first source by code point and to the
    smaller shard number. An empty table gives an empty result, extra columns
    aren't looked at. A document whose size is 0 gives nothing. taken <= cap *
    size always. Neither the order nor the partitions of the rows matter.
    """
    sized = pick(docs, doc_id="bigint", source="string", text="string").select("doc_id", "source", words_in(F.col("text")).alias("size"))
    rows = cut(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_rows")))
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("_rows")).alias("source_size"), F.sum("_rows").alias("_docs"))
    aimed = targets(sources, weights, cap).withColumn("_seats", F.round(F.col("_total") / block_words).cast("long"))
    aimed = apportion(aimed, "target", "_seats", [], ["source"]).withColumn("_shards", F.ceil(F.sqrt(F.col("_docs") / shard_docs)).cast("long"))
    aimed = cut(aimed.select("source", "source_size", "target", F.col("quota").alias("_source_quota"), "_shards"))

    pieces = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_rows - 1) div {piece_rows}"))))
    pieces = pieces.withColumn("_rows", F.least(F.lit(piece_rows), F.col("_rows") - piece_rows * F.col("_piece")).cast("long"))
    placed = (
        pieces.alias("d").join(aimed.alias("a"), F.col("d.source").eqNullSafe(F.col("a.source")))
        .select("d.doc_id", "d.source", "d.size", "d._rows", "d._piece", "a.source_size", "a.target", "a._source_quota", "a._shards", key60(F.lit(seed), F.col("d.doc_id"), F.col("d.size"), F.col("d._piece")).alias("_key"))
        .withColumn("_shard", F.col("_key") % F.col("_shards"))
    )
    shards = placed.groupBy("source", "_shard", "_source_quota").agg(F.sum(F.col("size") * F.col("_rows")).alias("_words"))
    planned = (
        apportion(shards, "_words", "_source_quota", ["source"], ["_shard"])
        .withColumn("_blocks", F.ceil(F.col("_words") / block_words).cast("long"))
        .where("_blocks > 0")
        .withColumn("_quota", F.least("quota", F.col("_blocks") * cap))
        .select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), "_blocks", F.expr("_quota div _blocks").alias("_passes"), (F.col("_quota") % F.col("_blocks")).alias("_rest"), (key60(F.lit(seed), F.col("source"), F.col("_shard")) % F.col("_blocks")).alias("_start"))
    )
    laid = placed.withColumn("_upto", F.sum(F.col("size") * F.col("_rows")).over(Window.partitionBy("source", "_shard").orderBy("_key", "doc_id", "size", "_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    laid = laid.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1))).withColumn("_end", F.col("_upto") - F.col("size") * F.col("_nth"))

    def given(upto: str) -> Column:
        at = f"(({upto}) div {block_words})"
        chosen = f"(({at} * _rest + _start) div _blocks)"
        after = f"((({at} + 1) * _rest + _start) div _blocks)"
        return F.expr(f"_passes * ({upto}) + {block_words} * {chosen} + (({upto}) % {block_words}) * ({after} - {chosen})")

    joined = laid.join(planned, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce(given("_end") - given("_end - size"), F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17, **kw) -> DataFrame:
    """The documents of the mix, with the columns of `docs`.

    A document comes as often as its taken words hold it whole; the fraction
    left over is one more copy with that seeded chance. Rows without a doc_id
    are told apart by a hash of their text and source; rows of the
    same id and size share evenly what they give. Extra columns may have any
    names. Documents without words give nothing and go.
    """
    rows, (own, text, source) = numbered(docs, "doc_id", "text", "source")
    known = F.coalesce(F.col(own).cast("long"), -1 - F.abs(F.xxhash64(text, source) % (1 << 62)))
    rows = rows.withColumn("_id", known)
    given = mix(rows.select(F.col("_id").alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")), seed=seed, **kw)
    copies = given.where("size > 0").groupBy("doc_id", "size").agg(F.expr("sum(taken) div count(1)").alias("taken"))
    rest = (F.col("taken") % F.col("size")) / F.col("size")
    chance = (key60(F.lit(seed), F.lit("copy"), F.col("doc_id")) % 1000003) / F.lit(1000003)
    copies = copies.select(F.col("doc_id").alias("_of"), F.col("size").alias("_size"), (F.expr("taken div size") + (chance < rest).cast("long")).alias("_copies")).where("_copies > 0")
    sized = rows.withColumn("_words", words_in(F.col(text)))
    kept = sized.join(copies, (F.col("_id") == F.col("_of")) & (F.col("_words") == F.col("_size")))
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*[f"_p{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)

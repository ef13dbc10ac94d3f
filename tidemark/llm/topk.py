"""Exact top-k by integer inner product over a pivot-distance index.

With one more component, sqrt(M^2 - |x|^2), all vectors have the largest norm
M, and the inner product with a query falls as the distance to it grows. Every
vector is keyed by its nearest pivot and its distance to that pivot, of which
there are as many as the square root of the vectors; rings of equal width
around a pivot are annuli. Neighbouring annuli of a pivot form blocks of about
`block_rows` rows, and an annulus of more (equal vectors, say) is salted into
several.

A query first opens the annuli with the smallest lower bounds until they hold
`first_rows` rows; the k-th score found there closes every annulus that the
triangle inequality keeps below it, and the query then visits the ones left.
Queries meet blocks in one shuffle a round: a block takes a batch of queries at
a time, looks only at the stretch of its sorted distances that they leave open,
and a query brings k rows at most out of a block. The directory of annuli has at
most pivots x rings rows, so it can go to every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, key60, matrix, pick, runs

BLOCK = ["block", "salt"]


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the floor of 1024 times each component; vectors null or with null or non-finite components are out."""
    rows = pick(vectors, vec_id="bigint", embedding="array<double>")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(F.col("embedding").isNotNull() & ~bad).select("vec_id", F.transform("embedding", lambda v: F.floor(v * 1024.0).cast("bigint")).alias("x"))


class Directory:
    """The annuli and what bounds them; goes to every task."""

    def __init__(self, known: list, P: np.ndarray, norm2: float, block_rows: int, first_rows: int):
        blocks, held, before = [], 0, None
        for r in known:
            if r.pivot != before or held + r.n > block_rows:
                blocks.append(1 + (blocks[-1] if blocks else -1))
                held, before = 0, r.pivot
            else:
                blocks.append(blocks[-1])
            held += r.n
        self.P, self.norm2, self.first_rows = P, norm2, first_rows
        self.A = {c: np.array([r[c] for r in known], np.float64) for c in ("n", "least", "most")} | {"pivot": np.array([r.pivot for r in known], np.int64), "block": np.array(blocks, np.int64)}
        self.A["salts"] = np.maximum(1, np.ceil(self.A["n"] / block_rows)).astype(np.int64)

    def open(self, Q: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """(queries, annuli) that may hold a score of `bar` or more; without a bar the nearest annuli."""
        A, q2 = self.A, (Q**2).sum(1)[:, None]
        d = np.sqrt(np.maximum(0, q2 + self.norm2 - 2 * Q @ self.P.T))[:, A["pivot"]]
        low = np.maximum(0, np.maximum(d - A["most"], A["least"] - d) - 1e-7 * np.sqrt(self.norm2))
        high = (q2 + self.norm2 - low**2) / 2 + 1 + 1e-9 * self.norm2
        if bar is not None:
            return high >= bar[:, None]
        order = np.argsort(-high, axis=1, kind="stable")
        first = np.zeros_like(high, bool)
        np.put_along_axis(first, order, np.cumsum(A["n"][order], axis=1) - A["n"][order] < self.first_rows, axis=1)
        return first

    def route(self, second: bool):
        """Sends every query to the blocks that hold annuli open to it, with the distances that are open."""
        A = self.A

        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, 64):
                    part = batch.slice(a, 64)
                    bar = part.column("bar").to_numpy(zero_copy_only=False)
                    q, at = np.nonzero(self.open(matrix(part.column("x")), bar if second else None))
                    if not len(q):
                        continue
                    block = A["block"][at]
                    start = np.flatnonzero((np.diff(q, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
                    low, high, salts = A["least"][at[start]], A["most"][at[np.append(start[1:], len(q)) - 1]], A["salts"][at[start]]
                    salt = np.arange(salts.sum()) - np.repeat(np.cumsum(salts) - salts, salts)
                    q, block, low, high = (np.repeat(x, salts) for x in (q[start], block[start], low, high))
                    for b in range(0, len(q), 4096):
                        s = slice(b, b + 4096)
                        take = pa.array(q[s])
                        yield pa.RecordBatch.from_arrays([part.column("vec_id").take(take), part.column("x").take(take), pa.array(block[s]), pa.array(salt[s]), part.column("bar").take(take), pa.array(low[s]), pa.array(high[s])], ["vec_id", "x", *BLOCK, "bar", "low", "high"])

        return run

class Index:
    """The keyed rows and the directory of their annuli."""

    def __init__(self, vectors: DataFrame, k: int, pivots: int | None, rings: int, block_rows: int, first_rows: int):
        rows = integers(vectors).where("vec_id is not null")
        n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        if not dim:
            rows, dim = rows.where("false"), 1
        padded = rows.select("vec_id", F.when(F.size("x") < dim, F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dim) - F.size("x")))).otherwise(F.col("x")).alias("x"))
        most, top = padded.agg(F.max(F.array_max(F.transform("x", F.abs))), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))).first()
        self.k, norm2 = k, float(top or 0) + 1.0
        self.exact = float(most or 0) ** 2 * dim < 2**52  # then float64 products and sums are whole numbers without loss
        chosen = padded.orderBy(key60(F.lit("pivot"), F.col("vec_id")), "vec_id", "x").limit(pivots or max(1, round(n**0.5))).collect()
        P = np.array([r.x for r in chosen], np.float64).reshape(len(chosen), dim)
        lift, width = np.sqrt(np.maximum(0, norm2 - (P**2).sum(1))), 2 * np.sqrt(norm2) / rings

        def key(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    X = matrix(part.column("x"))
                    up = np.sqrt(np.maximum(0, norm2 - (X**2).sum(1)))
                    d = np.sqrt(np.maximum(0, 2 * norm2 - 2 * (X @ P.T + up[:, None] * lift)))
                    near = d.argmin(1)
                    r = d[np.arange(len(d)), near]
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("x"), pa.array(near, pa.int64()), pa.array((r / width).astype(np.int64)), pa.array(r)], ["vec_id", "x", "pivot", "ring", "r"])

        keyed = cut(padded.mapInArrow(key, "vec_id long, x array<long>, pivot long, ring long, r double"))
        known = sorted(keyed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).collect())  # at most pivots x rings rows
        self.directory = Directory(known, P, norm2, block_rows, max(first_rows, k + 1))
        listed = [(r.pivot, r.ring, int(b), int(s)) for r, b, s in zip(known, self.directory.A["block"], self.directory.A["salts"], strict=True)]
        directory = keyed.sparkSession.createDataFrame(listed, "pivot long, ring long, block long, salts long")
        self.rows = keyed.join(F.broadcast(directory), ["pivot", "ring"]).select("vec_id", "x", "block", F.pmod(F.xxhash64("vec_id"), "salts").alias("salt"), "r")

    def visit(self, queries: DataFrame, second: bool) -> DataFrame:
        """query_id, vec_id, score: up to k rows for every query out of each block that is open to it."""
        routed = cut(queries.mapInArrow(self.directory.route(second), "vec_id long, x array<long>, block long, salt long, bar double, low double, high double"))
        nothing = F.lit(None).cast("double")
        rows = self.rows.join(routed.select(*BLOCK).distinct(), BLOCK, "left_semi").select("vec_id", "x", *BLOCK, nothing.alias("bar"), F.col("r").alias("low"), nothing.alias("high"), F.lit(0).alias("role"))
        both = rows.unionByName(routed.withColumn("role", F.lit(1)))
        k, kind = self.k, np.float64 if self.exact else np.int64
        whole = lambda part: np.asarray(part.column("x").flatten(), np.int64).reshape(part.num_rows, -1).astype(kind)

        def meet(batches):
            at, held, X = None, [], None
            for block, part in runs(batches, [*BLOCK, "role"]):
                if at != block[:2]:
                    at, held, X = block[:2], [], None
                if not block[2]:
                    held.append(part)
                    continue
                if X is None:
                    if not held:
                        continue
                    # Rows of a block come sorted by their distance to the pivot.
                    ids, r = (np.concatenate([np.asarray(p.column(c)) for p in held]) for c in ("vec_id", "low"))
                    X = np.concatenate([whole(p) for p in held])
                for a in range(0, part.num_rows, 256):
                    p = part.slice(a, 256)
                    low, high = np.asarray(p.column("low")).min(), np.asarray(p.column("high")).max()
                    i, j = np.searchsorted(r, low, "left"), np.searchsorted(r, high, "right")
                    if i == j:
                        continue
                    own, bar = np.asarray(p.column("vec_id")), np.asarray(p.column("bar"))
                    score = whole(p) @ X[i:j].T
                    good = (score >= bar[:, None]) & (ids[None, i:j] != own[:, None])
                    masked = np.where(good, score, np.iinfo(np.int64).min)
                    if j - i > k:
                        good &= masked >= np.partition(masked, j - i - k, axis=1)[:, j - i - k, None]
                    q, m = np.nonzero(good)
                    order = np.lexsort((ids[i + m], -score[q, m], q))
                    q, m = q[order], m[order]
                    place = np.arange(len(q)) - np.searchsorted(q, q, "left")
                    q, m = q[place < k], m[place < k]
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[i + m]), pa.array(score[q, m].astype(np.int64))], ["query_id", "vec_id", "score"])

        return both.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "role", "low").mapInArrow(meet, "query_id long, vec_id long, score long")

    def ranked(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k)

    def queries(self, every: int) -> DataFrame:
        """vec_id, x, bar: the k-th score of the rows that a query opens first; minus infinity where they are fewer."""
        plain = cut(self.rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x")))
        first = self.ranked(self.visit(plain.withColumn("bar", F.lit(float("-inf"))), False))
        bars = first.where(F.col("rank") == self.k).select("query_id", F.col("score").cast("double").alias("_bar"))
        return cut(plain.join(bars, plain.vec_id == bars.query_id, "left").select("vec_id", "x", F.coalesce("_bar", F.lit(float("-inf"))).alias("bar")))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int | None = None, rings: int = 64, block_rows: int = 4096, first_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every query row.

    Queries are the rows whose vec_id is divisible by `every`; candidates all
    rows with another vec_id. Ties go to the smaller vec_id. Vectors that are
    null or hold null or non-finite components take no part; shorter vectors
    count as padded with zeros; rows without a vec_id are no queries and no
    candidates; a repeated row is a candidate each time and a query once. An
    empty table gives an empty result; columns beside vec_id and embedding are
    not looked at. `pivots` is the square root of the rows if not given.
    """
    index = Index(vectors, k, pivots, rings, block_rows, first_rows)
    found = index.ranked(index.visit(index.queries(every), True))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def opened(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int | None = None, rings: int = 64, block_rows: int = 4096, first_rows: int = 1024) -> DataFrame:
    """query_id, open_annuli, annuli, open_rows, all_rows: what the bounds leave open to each query of top_k."""
    index = Index(vectors, k, pivots, rings, block_rows, first_rows)
    directory = index.directory

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                seen = directory.open(matrix(part.column("x")), part.column("bar").to_numpy(zero_copy_only=False))
                n = len(seen)
                counts = (seen.sum(1), np.full(n, seen.shape[1]), (seen * directory.A["n"]).sum(1), np.full(n, directory.A["n"].sum()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), *(pa.array(c.astype(np.int64)) for c in counts)], ["query_id", "open_annuli", "annuli", "open_rows", "all_rows"])

    return index.queries(every).mapInArrow(run, "query_id long, open_annuli long, annuli long, open_rows long, all_rows long")

"""Embedding near-duplicates by an exact metric range join.

Unit vectors of cosine c are sqrt(2 - 2 c) apart, so a cosine threshold is a
radius. Pivots, drawn from the vectors themselves, cut the space of each label
and length into cells, every vector being at home with its nearest pivot; there
are about a quarter of the square root as many pivots as vectors, so cells grow
as slowly, and a crowded region gets more pivots. A vector can only be within
the radius of one at home elsewhere if it lies no further than the radius from
the plane between the two pivots, a bound that sharpens d(v, other) <=
d(v, home) + 2 radius from the triangle inequality; both are applied, and the
vector is copied to those cells alone. Each cell then joins what is at home
with all it holds, cells being independent, and each link of a vector is
counted exactly once, in its home.

Equal vectors of a label are one row with a count. A cell with many vectors is
cut into chunks of about `chunk_rows` that are joined by different tasks; a
task holds one chunk and streams the rest. What leaves a task is a count for
each vector and a spanning forest, not the pairs. Nodes of the forest are
ordered by their smallest vec_id, so a component's least node names it and no
join gathers a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import cut, matrix, pick, runs

SPACE = ["label", "dim"]
CELL = [*SPACE, "pivot", "chunk"]


def _unit(X: np.ndarray) -> np.ndarray:
    X = X / np.abs(X).max(1, keepdims=True)
    return X / np.sqrt((X**2).sum(1, keepdims=True))


def _linked(A: np.ndarray, B: np.ndarray, least: float) -> np.ndarray:
    """Which rows of A and B have that cosine; what is too close to call is summed exactly."""
    from math import fsum, sqrt

    c = A @ B.T
    out = c >= least
    for i, j in zip(*np.nonzero(np.abs(c - least) < 1e-13), strict=True):
        a, b = A[i], B[j]
        out[i, j] = fsum(a * b) / sqrt(fsum(a * a) * fsum(b * b)) >= least
    return out


def _forest(near: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the ids of a two-sided relation as its links do."""
    r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(r):
        return []
    near, rows, cols = near[np.ix_(r, c)], rows[r], cols[c]
    top = np.iinfo(np.int64).max
    a, b = rows.copy(), cols.copy()
    while True:
        b2 = np.minimum(b, np.where(near, a[:, None], top).min(0))
        a2 = np.minimum(a, np.where(near, b2[None, :], top).min(1))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    return [(int(x), int(y)) for x, y in zip([*rows, *cols], [*a, *b], strict=True) if x != y]


def _pivots(distinct: DataFrame, share: float) -> DataFrame:
    """Rows that serve as pivots: about share * sqrt(n) + 1 of each label and length, and one at least, by their hashes."""
    spread = F.col("_hash") / F.lit(float(1 << 62))
    sizes = distinct.groupBy(*SPACE).agg(F.count(F.lit(1)).alias("_n"), F.min("_hash").alias("_least"))
    return distinct.join(sizes, SPACE).where((spread * F.col("_n") < share * F.sqrt("_n") + 1) | (F.col("_hash") == F.col("_least"))).select(*SPACE, "tie", "embedding")


def near_duplicates(vectors: DataFrame, least: float = 0.98, share: float = 0.25, chunk_rows: int = 1024, salt_rows: int = 1 << 16) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Vectors are compared when labels are equal and not null and lengths are
    equal. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing: n_links 0, component_id their own vec_id.
    Repeated rows link to each other, and rows that share a vec_id are rows of
    their own. Rows without a vec_id keep a null component unless they link
    with one that has it. A cosine of exactly `least` links; there are no other
    ties. An empty table gives an empty result; other columns aren't looked at.
    """
    kind = dict(vectors.dtypes).get("embedding", "")
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = pick(vectors, vec_id="bigint", embedding=kind, label="string")
    fair = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    fair &= ~F.coalesce(F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    rows = rows.withColumn("_fair", F.coalesce(fair, F.lit(False)))
    # `tie` tells the distinct vectors apart; written once, it stays as it is.
    distinct = rows.where("_fair").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("times"))
    distinct = cut(distinct.withColumn("tie", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding").cast("long")).withColumn("_hash", F.shiftrightunsigned(F.xxhash64("embedding", "label"), 2)))
    radius = float(np.sqrt(2 - 2 * least)) + 1e-6

    salts = distinct.groupBy(*SPACE).agg(F.ceil(F.count(F.lit(1)) / salt_rows).alias("salts"))
    pivots = _pivots(distinct, share).join(salts, SPACE).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    nothing = F.lit(None).cast("long")
    members = distinct.join(salts, SPACE).select(*SPACE, F.pmod("tie", "salts").alias("salt"), F.lit(1).alias("role"), "first", "tie", "times", "embedding")
    dealt = members.union(pivots.select(*SPACE, "salt", F.lit(0), nothing, "tie", nothing, "embedding"))

    def place(batches):
        at, held, P, between = None, [], None, None
        for (label, dim, salt, role), block in runs(batches, [*SPACE, "salt", "role"]):
            if at != (label, dim, salt):
                at, held, P = (label, dim, salt), [], None
            if not role:
                held.append(block)
                continue
            if P is None:
                order = np.argsort(np.concatenate([np.asarray(b.column("tie")) for b in held]))
                P = _unit(np.concatenate([matrix(b.column("embedding")) for b in held])[order])
                between = np.sqrt(np.maximum(0, 2 - 2 * (P @ P.T)))
            step = max(64, min(4096, (1 << 22) // len(P)))
            for k in range(0, block.num_rows, step):
                part = block.slice(k, step)
                d2 = np.maximum(0, 2 - 2 * (_unit(matrix(part.column("embedding"))) @ P.T))
                home = d2.argmin(1)
                own = d2[np.arange(len(home)), home]
                near = (d2 - own[:, None]) <= 2 * radius * between[home] + 1e-9
                near &= np.sqrt(d2) <= np.sqrt(own)[:, None] + 2 * radius
                near[np.arange(len(home)), home] = True
                row, cell = np.nonzero(near)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in (*SPACE, "first", "tie", "times", "embedding")), pa.array(cell, pa.int64()), pa.array(cell == home[row])], [*SPACE, "first", "tie", "times", "embedding", "pivot", "home"])

    near_pivots = dealt.repartition(*SPACE, "salt").sortWithinPartitions(*SPACE, "salt", "role")
    placed = cut(near_pivots.mapInArrow(place, f"label string, dim long, first long, tie long, times long, embedding {kind}, pivot long, home boolean"))
    sizes = placed.where("home").groupBy(*SPACE, "pivot").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("chunks"))
    own = F.when(F.col("home"), F.pmod(F.xxhash64("tie"), "chunks"))
    spread = placed.join(sizes, [*SPACE, "pivot"]).withColumn("_own", own).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    spread = spread.select(*CELL, "first", "tie", "times", "embedding", F.when(F.col("chunk") == F.col("_own"), 0).otherwise(1).alias("role"))

    def join(batches):
        names = ["u_first", "u_tie", "v_first", "v_tie", "links"]

        def out(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        def close(state):
            if state and state["U"] is not None:
                none = [None] * len(state["links"])
                yield out(none, state["ties"], none, none, state["links"])

        def edges(near, firsts, ties):
            """A spanning forest of what is near, by positions: those of the chunk, then those that meet it."""
            n = len(near)
            found = _forest(near, np.arange(n), np.arange(n, n + near.shape[1]) if len(ties) > n else np.arange(n))
            if found:
                u, v = (pa.array([e[side] for e in found]) for side in (0, 1))
                yield pa.RecordBatch.from_arrays([firsts.take(u), ties.take(u), firsts.take(v), ties.take(v), pa.nulls(len(u), pa.int64())], names)

        def settle(state):
            """The chunk is whole: join it with itself."""
            held = state["held"]
            state["held"] = []
            if not held:
                return
            whole = pa.Table.from_batches(held).combine_chunks()
            state["firsts"], state["ties"] = (whole.column(c).combine_chunks() for c in ("first", "tie"))
            state["U"] = _unit(np.concatenate([matrix(p.column("embedding")) for p in held]))
            near = _linked(state["U"], state["U"], least)
            np.fill_diagonal(near, True)
            state["links"] = near @ np.asarray(whole.column("times"))
            yield from edges(near, state["firsts"], state["ties"])

        state = None
        for block, part in runs(batches, [*CELL, "role"]):
            if state is None or state["key"] != block[:4]:
                if state:
                    yield from settle(state)
                    yield from close(state)
                state = {"key": block[:4], "held": [], "U": None}
            if not block[4]:
                state["held"].append(part)
                continue
            yield from settle(state)
            if state["U"] is None:
                continue
            for a in range(0, part.num_rows, 4096):
                p = part.slice(a, 4096)
                near = _linked(state["U"], _unit(matrix(p.column("embedding"))), least)
                if near.any():
                    state["links"] = state["links"] + near @ np.asarray(p.column("times"))
                    yield from edges(near, pa.concat_arrays([state["firsts"], p.column("first")]), pa.concat_arrays([state["ties"], p.column("tie")]))
        if state:
            yield from settle(state)
            yield from close(state)

    found = cut(spread.repartition(*CELL).sortWithinPartitions(*CELL, "role").mapInArrow(join, "u_first long, u_tie long, v_first long, v_tie long, links long"))
    # Rows without a vec_id come last, so they name a component only among themselves.
    node = lambda s: F.struct(F.col(f"{s}_first").isNull().alias("nameless"), F.coalesce(f"{s}_first", F.lit(0)).alias("first"), F.col(f"{s}_tie").alias("tie"))
    roots = connected_components(found.where("v_tie is not null").select(node("u").alias("u"), node("v").alias("v")))
    roots = roots.select(F.col("node.tie").alias("tie"), F.lit(True).alias("_joined"), F.when(~F.col("root.nameless"), F.col("root.first")).alias("least"))
    counts = found.where("links is not null").select(F.col("u_tie").alias("tie"), (F.col("links") - 1).alias("n_links"))
    known = distinct.join(counts, "tie", "left").join(roots, "tie", "left").select("label", "embedding", "n_links", F.when(F.col("_joined"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    fair_rows = rows.where("_fair").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not _fair").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fair_rows.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

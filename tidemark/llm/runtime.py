"""Column picking, the shared folder and lineage cuts that every operator here uses."""

from __future__ import annotations

import ctypes
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Gives this subpackage to the Python workers, once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_llm", False):
        return
    here = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr(f"{here.parent.name}/__init__.py", "from pkgutil import extend_path\n\n__path__ = extend_path(__path__, __name__)\n")
        for p in sorted(here.glob("*.py")):
            z.write(p, f"{here.parent.name}/{here.name}/{p.name}")
    out = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "tidemark_llm.zip"
    out.write_bytes(held.getvalue())
    sc.addPyFile(str(out))
    sc._tidemark_llm = True


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to the given types.

    Columns are found by exact name and position, so extra columns whose names
    differ in case only, hold dots or occur twice do no harm.
    """
    ship(df.sparkSession)
    names = df.columns
    plain = df.toDF(*[f"_p{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_p{names.index(name)}").cast(kind).alias(name) for name, kind in columns.items()])


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The table with columns _p0, _p1, ... and, for each name given, which of them it is.

    Operators that hand whole rows on work on these and put the names back with
    toDF, so no name of an extra column can clash with one of their own.
    """
    return df.toDF(*[f"_p{i}" for i in range(len(df.columns))]), [f"_p{df.columns.index(name)}" for name in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a temporary folder is set for this session,
    on one machine only: elsewhere it wouldn't be shared, and that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder name inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def key60(*parts):
    """A 60-bit number from the md5 of the parts joined by colons (null: empty)."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def matrix(column):
    """An Arrow list column of equal lengths without nulls as a two-dimensional float64 array."""
    import numpy as np

    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def release() -> None:
    """Gives freed memory back to the system; Python workers live on from task to task, and would else keep the most that any of them took."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def runs(batches, keys: list[str]):
    """(key, part of a batch) for every stretch of equal keys in sorted Arrow batches."""
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = [*np.flatnonzero(new).tolist(), n]
        for a, b in zip(starts, starts[1:]):
            yield tuple(c[a] for c in cols), batch.slice(a, b - a)

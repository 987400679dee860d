"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .. import session

ROWS_SETTING, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "512"


def ship(spark: SparkSession) -> None:
    """What the operators need of a session: this package on the workers, and Arrow batches for rows of whole documents.

    Spark's default of 10,000 rows a batch is meant for narrow rows; a setting of the user's own stays."""
    session.ship(spark)
    if spark.conf.get(ROWS_SETTING) == "10000":
        spark.conf.set(ROWS_SETTING, ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: int, rows: int = 256, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of at most `rows` rows and about `most` bytes in the column numbered `text` (a longer text has a part of its own)."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi


@functools.cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def tidy(run: Callable) -> Callable:
    """run (batches to batches), handing the memory it freed back to the system when it ends: a worker lives on for other tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return tidied


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df bears them (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared one that the cluster names in spark.checkpoint.dir.

    Only on a single machine (master local) a temporary folder of its own stands in for that setting."""
    ship(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault("dir", None) or _local.update(dir="file://" + tempfile.mkdtemp(prefix="impactlake-")) or _local["dir"]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_local: dict = {}


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    Readers of the result survive the loss of any executor, and what is above is computed once."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `written` made and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def extra_columns(df: DataFrame, taken: set[str]) -> list[str]:
    """Columns of df that do not clash (case-insensitively) with the names an operator adds."""
    ship(df.sparkSession)
    low = {x.lower() for x in taken}
    return [c for c in df.columns if c.lower() not in low]

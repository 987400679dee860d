"""What a Spark session needs for this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application.

    The driver serves the archive, so workers need not share its folders or search path, and executors
    that start anew get it too."""
    context = spark.sparkContext
    here = os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _shipped or not os.path.isdir(here):
        return
    name = os.path.basename(here)
    folder = tempfile.mkdtemp(prefix=f"{name}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def workspace(spark: SparkSession) -> str:
    """A fresh folder below the shared one that the cluster names in spark.checkpoint.dir; a local master without that setting gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/impactlake-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str) -> DataFrame:
    """df after it was written to a folder below a workspace: what is above is worked out once, and its rows are counted by footers."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

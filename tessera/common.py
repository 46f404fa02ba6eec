"""Small helpers that all operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, for where their Python does not find it by itself."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tessera-package-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for name in names:
                if not name.endswith(".pyc"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(root)))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, where that is unset in local mode (tests), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        atexit.register(shutil.rmtree, folder[7:], True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The table written to the shared folder and read back.

    This cuts the lineage, survives the loss of executors, and gives Catalyst the table's true size, so that
    it may choose a broadcast by its own threshold.
    """
    path = f"{shared_dir(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only where the input has too few splits to keep the cores busy (a small file read whole)."""
    spark = df.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if df.rdd.getNumPartitions() * 2 >= cores:
        return df
    return df.repartition(cores, *keys)


def plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """A pandas frame that Arrow can send back: an empty one's columns, which pandas takes for numbers, as objects."""
    return pdf if len(pdf) else pdf.astype(object)


def local_path(path: str) -> str:
    """A file URI as a plain path."""
    return path[7:] if path.startswith("file://") else path


def exists(path: str) -> bool:
    return os.path.exists(local_path(path))

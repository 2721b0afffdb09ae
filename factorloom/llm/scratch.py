"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _LOCAL
    if _LOCAL is None or not os.path.isdir(_LOCAL):
        _LOCAL = tempfile.mkdtemp(prefix="spark-factorloom-")
    return f"file://{_LOCAL}"


_LOCAL: str | None = None
#: Folders that written() has made and that are still there.
_MADE: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors. It stays until ``cleared`` removes it."""
    base = f"{scratch_dir(df.sparkSession)}/factorloom-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{name}")
    _MADE.append(base)
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/{name}")


@contextmanager
def cleared(spark: SparkSession) -> Iterator[set[str]]:
    """Removes the tables that are written inside but for those of which the folder is put into the set: for steps whose result has been written."""
    kept: set[str] = set()
    first = len(_MADE)
    try:
        yield kept
    finally:
        for base in _MADE[first:]:
            if base not in kept:
                _delete(spark, base)
        _MADE[first:] = [base for base in _MADE[first:] if base in kept]


def _delete(spark: SparkSession, base: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(spark: SparkSession, base: str) -> None:
    """Removes one folder that written() has made, once nothing reads it any more."""
    _MADE.remove(base)
    _delete(spark, base)


def last_written() -> str:
    """The folder of the table that was written last."""
    return _MADE[-1]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered_rows(docs: DataFrame, rid: str) -> DataFrame:
    """docs, read from files, with a number that tells rows apart and is the same whenever they are read: the place of a row in its file, and of the file among all."""
    path = docs.select(F.col("_metadata.file_path").alias("_file"))
    files = written(path.distinct().select("_file", F.row_number().over(Window.orderBy("_file")).cast("long").alias("_no")), "files")  # a row for each file
    placed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return placed.join(files, "_file").select(*[F.col(f"`{c}`") for c in docs.columns], (F.shiftleft("_no", 40) + F.col("_row")).alias(rid))


def spare_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

"""Stage results that several branches read: written once to the shared folder, which also cuts their plans."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder in spark.checkpoint.dir; a local session without it gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _remove(spark, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may be gone already
        pass


def stored(lines: DataFrame, name: str) -> str:
    """Write a column of text to the shared folder, one line a row; the path of its files, removed at the end."""
    path = f"{shared_folder(lines.sparkSession)}/strandloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, lines.sparkSession, path)
    lines.write.text(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a stage's rows and read them back: later branches neither plan nor run it again.

    The files are removed when the driver's Python ends.
    """
    path = f"{shared_folder(df.sparkSession)}/strandloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""What the jobs share: configs, sessions of the command line, counted writes."""

from __future__ import annotations

import json
import logging
import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("strandloom.jobs")


def load_config(name: str, path: str | None = None) -> dict:
    """The job's config beside its module, with the entries of the file at path in place of its own."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), encoding="utf-8") as file:
        config = json.load(file)
    if path:
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        if unknown := sorted(set(given) - set(config)):
            raise ValueError(f"unknown config entries: {', '.join(unknown)}")
        config |= given
    return config


def session(name: str) -> SparkSession:
    """The command line's session; functions take the caller's."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()


def write_partitioned(rows: DataFrame, path: str, by: list[str], mode: str = "static") -> int:
    """Overwrite a Parquet folder partitioned by columns; the number of rows written.

    mode: static replaces the whole folder, dynamic only the partitions that rows have.
    """
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*by).parquet(path)
    return seen.get["n"]

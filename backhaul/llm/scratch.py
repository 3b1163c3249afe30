"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_place(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; unset, a temporary folder, in local mode only."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        place = tempfile.mkdtemp(prefix="backhaul-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


class Scratch:
    """Tables written to end a lineage. A lost executor loses none of them."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.folder = f"{shared_place(spark)}/backhaul-{purpose}-{uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def keep(self, rows: DataFrame) -> DataFrame:
        """``rows``, written now and read back."""
        path = f"{self.folder}/{self.n}"
        self.n += 1
        rows.write.parquet(path)
        stored = self.spark.read.parquet(path)
        self.paths[id(stored)] = path
        return stored

    def drop(self, *stored: DataFrame) -> None:
        """Deletes tables given by ``keep`` that no later step reads."""
        jvm = self.spark._jvm
        for rows in stored:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(rows)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

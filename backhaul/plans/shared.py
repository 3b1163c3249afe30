"""Where tables shared by several queries of one application are kept, and what they leave there."""

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


#: Of stored tables: they are kept together with those derived from them.
CODEC = "zstd"
#: Takes the shuffle files of a statement away when it ends, not when the JVM gets to it.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings, for as long as a statement runs."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def write_table(rows: DataFrame, path: str, *parts: str, mode: str = "overwrite") -> None:
    """``rows`` as Parquet under ``path``, by ``parts``; nothing else stays on disk."""
    with settings(rows.sparkSession, {RELEASE: "true"}):
        (rows.write.mode(mode).option("compression", CODEC).partitionBy(*parts).parquet(path))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is not read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder every executor can reach.

    The place is the session's ``spark.checkpoint.dir``. A temporary folder of this machine
    stands in for it only in local mode, where driver and executors are one process.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        place = tempfile.mkdtemp(prefix="backhaul-")
    return f"{place.rstrip('/')}/backhaul-{purpose}-{uuid4().hex}"


def store_table(rows: DataFrame, path: str, keys: list[str], buckets: int) -> DataFrame:
    """``rows`` under ``path`` in sorted buckets of ``keys``, read back.

    Rows are dealt by the same hash before they are written, so a bucket is one file. The columns
    that follow the keys do not matter to it; a key with many rows makes one large file.
    """
    name = f"backhaul_{uuid4().hex}"
    with settings(rows.sparkSession, {RELEASE: "true"}):
        (rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
         .format("parquet").option("path", path).option("compression", CODEC)
         .mode("overwrite").saveAsTable(name))
    return rows.sparkSession.table(name)


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """``rows``, written now and read back, for results that are read more than once."""
    folder = shared_folder(rows.sparkSession, purpose)
    write_table(rows, folder)
    return rows.sparkSession.read.parquet(folder)

"""A warehouse refreshed in versions: readers keep theirs, a stopped load changes nothing.

A refresh derives all tables aside, compares them part by part with the version before and stores
only the parts that differ, under a folder of their own number:

    <path>/order_facts/part=2023-01/version=3/...
    <path>/_manifests/3/...

A part is an order month (of returns a request month) or, of a small table, the whole. The manifest
names the version that holds each part; it is written last, and a version without its finished
manifest does not exist. Stored parts are never changed, so a frame that was opened before a refresh
goes on reading what it read. ``vacuum`` deletes what no kept version names.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backhaul.functions import metrics as m
from backhaul.plans.shared import CODEC, RELEASE, remove, settings
from backhaul.schemas import ORDERS, RETURNS
from backhaul.warehouse import Warehouse

WHOLE = "all"
NO_DATE = "undated"
#: What Spark calls the folder of a partition without value.
UNDATED_FOLDER = "__HIVE_DEFAULT_PARTITION__"
#: The column whose month is a row's part; the other tables are one part each.
MONTH_OF = {"order_facts": "order_date", "returns": "request_date"}
TABLES = ("staging", "customers", "products", "returns", "order_facts")
ENTRY = T.StructType([
    T.StructField("table_name", T.StringType()), T.StructField("part", T.StringType()),
    T.StructField("version", T.LongType()), T.StructField("row_count", T.LongType()),
    T.StructField("digest", T.StringType()), T.StructField("columns", T.StringType())])


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions, oldest first."""
    files, folder = _file_system(spark, f"{path}/_manifests/*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName()) for f in files.globStatus(folder) or [])


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One row per table and part: the version that stored it, its rows, their digest."""
    known = versions(spark, path)
    if version is None and known:
        version = known[-1]
    if version not in known:
        raise ValueError(f"no version {version} under {path}; there are {known}")
    return spark.read.schema(ENTRY).json(f"{path}/_manifests/{version}")


def _part(table: str) -> Column:
    if table not in MONTH_OF:
        return F.lit(WHOLE)
    return F.coalesce(m.month_key(MONTH_OF[table]), F.lit(NO_DATE))


def _digests(table: str, rows: DataFrame) -> DataFrame:
    """Rows per part and a digest of them that does not depend on their order."""
    # a null leaves a hash as it was, so say where the nulls are
    signed = F.xxhash64(*[x for c in rows.columns for x in (F.col(c), F.col(c).isNull())])
    return (rows.select(_part(table).alias("part"), signed.alias("row"))
            .groupBy("part")
            .agg(F.count(F.lit(1)).alias("row_count"),
                 F.concat_ws(":", F.bit_xor("row"), F.sum(F.col("row").cast("decimal(38,0)")))
                 .alias("digest"))
            .select(F.lit(table).alias("table_name"), "part", "row_count", "digest"))


def refresh(staging: DataFrame, path: str, groups: int | None = None) -> int:
    """Loads ``staging`` as a new version of the warehouse under ``path``; returns its number.

    All tables are derived and stored aside once, as ``Warehouse.load`` does; only parts that are
    new or differ are then taken into the version. Their folders are moved; only returns, which are
    not stored by month aside, are written again. A load that was stopped can be run again: it has
    the same number and replaces what the stopped one left.
    """
    spark = staging.sparkSession
    known = versions(spark, path)
    before = {}
    if known:
        # a row per table and month
        before = {(e["table_name"], e["part"]): e for e in manifest(spark, path).collect()}
    number = known[-1] + 1 if known else 1
    work = f"{path}/_work/{number}"
    loaded = Warehouse.load(staging, work, groups=groups)
    tables = {"staging": loaded.staging, "customers": loaded.customers,
              "products": loaded.products, "returns": loaded.returns,
              "order_facts": loaded.order_facts}
    entries, new = [], {}
    for name, rows in tables.items():
        columns = rows.schema.json()
        changed = []
        for found in _digests(name, rows).collect():
            old = before.get((name, found["part"]))
            same = old and (old["row_count"], old["digest"], old["columns"]) == (
                found["row_count"], found["digest"], columns)
            if not same:
                changed.append(found["part"])
            entries.append((name, found["part"], old["version"] if same else number,
                            found["row_count"], found["digest"], columns))
        if changed:
            new[name] = changed
    for name, parts in new.items():
        if name == "returns":
            _store(name, tables[name], parts, number, path)
        else:
            _adopt(spark, name, work, parts, number, path)
    _commit(spark, entries, number, path)
    remove(spark, work)
    return number


def _adopt(spark: SparkSession, name: str, work: str, parts: list[str], version: int, path: str
           ) -> None:
    """Moves what was stored aside of the parts under their version, replacing those folders."""
    for part in parts:
        source = f"{work}/{name}"
        if name in MONTH_OF:
            source += f"/order_month={UNDATED_FOLDER if part == NO_DATE else part}"
        files, target = _file_system(spark, f"{path}/{name}/part={part}/version={version}")
        files.delete(target, True)
        files.mkdirs(target.getParent())
        if not files.rename(_file_system(spark, source)[1], target):
            raise OSError(f"{source} could not be moved to {target}")


def _store(name: str, rows: DataFrame, parts: list[str], version: int, path: str) -> None:
    """Writes the parts under their version, replacing only those folders."""
    with settings(rows.sparkSession, {RELEASE: "true"}):
        (rows.withColumn("part", _part(name)).filter(F.col("part").isin(parts))
         .withColumn("version", F.lit(version))
         .hint("rebalance", "part")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", CODEC)
         .partitionBy("part", "version").parquet(f"{path}/{name}"))


def _commit(spark: SparkSession, entries: list[tuple], version: int, path: str) -> None:
    """The version exists from here on. Of two loads at a time the second fails."""
    (spark.createDataFrame(entries, ENTRY).coalesce(1)
     .write.mode("errorifexists").json(f"{path}/_manifests/{version}"))


def read_table(spark: SparkSession, path: str, name: str, version: int | None = None
               ) -> DataFrame:
    """A table as of a version, with its month as ``part``, which prunes."""
    entries = [e for e in manifest(spark, path, version).collect() if e["table_name"] == name]
    if not entries:
        schema = ORDERS if name == "order_facts" else RETURNS
        return spark.createDataFrame([], T.StructType(
            [*schema.fields, T.StructField("part", T.StringType())]))
    schema = T.StructType.fromJson(json.loads(entries[0]["columns"]))
    # declared as text: the names of months must not be taken for numbers or dates
    schema = T.StructType([*schema.fields, T.StructField("part", T.StringType()),
                           T.StructField("version", T.LongType())])
    folders = [f"{path}/{name}/part={e['part']}/version={e['version']}" for e in entries]
    return (spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*folders)
            .drop("version"))


def read(spark: SparkSession, path: str, version: int | None = None) -> Warehouse:
    """The tables of one version, the newest unless named; later refreshes do not change them."""
    if version is None:
        found = versions(spark, path)
        version = found[-1] if found else None
    tables = {name: read_table(spark, path, name, version).drop("part") for name in TABLES}
    facts = tables["order_facts"]
    return Warehouse(tables["staging"], tables["customers"], tables["products"],
                     facts.select(*ORDERS.names), tables["returns"].select(*RETURNS.names),
                     facts.drop("category"), facts, path)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes versions but the newest ``keep`` and the parts only they name; returns how many
    folders of parts went."""
    known = versions(spark, path)
    kept, gone = known[-keep:], known[:-keep]
    if not gone:
        return 0

    def folders(numbers: list[int]) -> set[str]:
        entries = reduce(DataFrame.unionByName, [manifest(spark, path, v) for v in numbers])
        return {f"{path}/{e['table_name']}/part={e['part']}/version={e['version']}"
                for e in entries.collect()}

    unused = folders(gone) - folders(kept)
    for number in gone:
        remove(spark, f"{path}/_manifests/{number}")
    for folder in unused:
        remove(spark, folder)
    return len(unused)

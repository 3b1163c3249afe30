"""Reads staging files as they are; cleaning happens in ``operators.load``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backhaul.schemas import INGEST_SEQ, STAGING
from backhaul.sources.records import read_records

MALFORMED = "_malformed"
FILE = "_file"


def read_csv(spark: SparkSession, path: str, schema: T.StructType = STAGING,
             sequence: str | None = None, multi_line: bool = False) -> DataFrame:
    """Wide CSV with a header that matches ``schema``; a field that does not parse is NULL.

    ``sequence`` names the column that holds the load order. Without one the order is taken
    from the files: path, start of the split, then row order within the split. Spark may
    schedule splits in any order, so a running id alone would not follow the file.

    Quoted fields with line breaks need ``multi_line``, which reads the files twice.
    """
    return _read(spark, path, schema, sequence, multi_line)


def split_csv(spark: SparkSession, path: str, schema: T.StructType = STAGING,
              sequence: str | None = None, multi_line: bool = False
              ) -> tuple[DataFrame, DataFrame]:
    """``read_csv`` without the malformed records, and those: the file and the record as text.

    A record is malformed if it has too few or too many fields, or a field that is not of its
    column's type. All columns are parsed to see that, whichever are used. Each of the two frames
    parses the files; ``divide`` of stored ``marked_csv`` parses them once.
    """
    marked = marked_csv(spark, path, schema, sequence, multi_line)
    # always true, but it needs every column: Spark only parses what is used
    return divide(marked.filter(F.length(F.concat_ws(
        "", *[F.col(f.name).cast("string") for f in schema])) >= 0), schema)


def marked_csv(spark: SparkSession, path: str, schema: T.StructType = STAGING,
               sequence: str | None = None, multi_line: bool = False) -> DataFrame:
    """``read_csv`` with the file, and the text of malformed records; to be stored whole, as a
    record is only known to be malformed if all its columns are used."""
    wider = T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])
    rows = _read(spark, path, wider, sequence, multi_line, columnNameOfCorruptRecord=MALFORMED)
    return rows.withColumn(FILE, F.col(f"{INGEST_SEQ}.file") if not sequence
                           else F.input_file_name())


def divide(marked: DataFrame, schema: T.StructType = STAGING) -> tuple[DataFrame, DataFrame]:
    """The rows of ``marked_csv`` and its malformed records."""
    broken = F.col(MALFORMED).isNotNull()
    return (marked.filter(~broken).drop(MALFORMED, FILE),
            marked.filter(broken).select(F.col(FILE).alias("file"),
                                         F.col(MALFORMED).alias("record"), schema.names[0]))


def _read(spark: SparkSession, path: str, schema: T.StructType, sequence: str | None,
          multi_line: bool, **options) -> DataFrame:
    if multi_line:
        rows = _parsed(read_records(spark, path), schema, options)
    else:
        rows = (spark.read.schema(schema).options(mode="PERMISSIVE", **options)
                .csv(path, header=True, enforceSchema=False)
                .select("*", F.struct(
                    F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("split"),
                    F.monotonically_increasing_id().alias("row")).alias(INGEST_SEQ)))
    if sequence:
        return rows.drop(INGEST_SEQ).withColumnRenamed(sequence, INGEST_SEQ)
    return rows


def _parsed(records: DataFrame, schema: T.StructType, options: dict) -> DataFrame:
    """Records as rows; the first of each file has to name the columns."""
    names = [f.name for f in schema if f.name != options.get("columnNameOfCorruptRecord")]
    header = F.lit(",".join(names))
    checked = (records
               .filter(~F.col("first")
                       | F.assert_true(F.regexp_replace("record", '["\\r]', "") == header,
                                       F.lit(f"the header is not {','.join(names)}")).isNotNull())
               .filter("record <> ''"))
    parsed = F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "),
                        {"mode": "PERMISSIVE", "escape": '"', **options})
    return checked.select(parsed.alias("parsed"), F.struct("file", "split", "row").alias(INGEST_SEQ)
                          ).select("parsed.*", INGEST_SEQ)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Staging that already carries its ``ingest_seq``."""
    return spark.read.parquet(path)

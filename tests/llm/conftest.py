import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns a user's table may have besides; operators must not trip over their names.
CLASHES = ["id", "key", "row", "score", "root", "node", "token_ids", "component_id", "kept",
           "license", "digest", "label", "_id", "_digest"]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with internal ones."""
    def make(pairs, clash=True, lang="en"):
        schema = DOCUMENTS + ("".join(f", {c} string" for c in CLASHES) if clash else "")
        rows = [(i, t, lang if not isinstance(lang, dict) else lang.get(i), "src0",
                 None if t is None else len(t), *(["x"] * len(CLASHES) if clash else []))
                for i, t in pairs]
        return spark.createDataFrame(rows, T._parse_datatype_string(schema))
    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return make


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))

import os
import subprocess
import sys

import duckdb

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_one_query_per_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    numbers = [int(n[2:].split("_")[0]) for n in names if n[2].isdigit()]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_license_query_against_duckdb(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    expected = db.execute(entry.oracle_sql()["op5_license_scan"]).fetchall()
    columns = [c[0] for c in db.description]
    got = entry.queries()["op5_license_scan"](spark, DATA).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_contract_columns(spark):
    wanted = {
        "op1_": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op4_": "vec_id n_links component_id kept",
        "op6_": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op8_": "doc_id held_out score predicted",
        "op9_": "doc_id held_out lang_pred score",
    }
    for start, columns in wanted.items():
        name = next(n for n in entry.queries() if n.startswith(start))
        assert entry.queries()[name](spark, DATA).columns == columns.split()


def test_imports_without_this_folder():
    code = ("import sys; sys.modules['backhaul.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; n = e.queries(); e.oracle_sql()\n"
            "assert not [q for q in n if q.startswith('op1') or q == 'pipeline'] and len(n) > 70")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)

"""Every query with SQL gives the SQL's rows on the smallest tables; the others give rows."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from conftest import SF
from lorespark.plans.catalogue import ORACLE_SQL, QUERIES


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return "~" if v is None else str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    rows = QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    found = tables.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())
    assert got == want


def test_entry_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/lorespark", tmp_path / "lorespark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'doc_subject_freq' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from rillflow.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    return con


def shown(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = shown([tuple(r) for r in df.collect()], df.columns)
    if name in catalog.ORACLES:
        found = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert got == shown(found.fetchall(), names)


def test_entry_without_the_text_operators(tmp_path):
    for name in ("rillflow", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    (tmp_path / "rillflow" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave behind
    code = "import __spark_entry__ as e; q = e.queries(); assert 'user_window_10s' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})

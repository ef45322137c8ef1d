"""Registered queries on the smallest tables: against their SQL where there is one, else against what contracts say."""

import ast
import os
import pathlib
import subprocess
import sys

import duckdb
import pytest

from maskline.llm import queries

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parents[2]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.sql(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{SF}/{file}')")
    want = db.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall())


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.rglob("*.py"):
        inside = path.relative_to(ROOT)
        if "llm" in inside.parts or inside.name in ("corpus_pipeline.py", "__spark_entry__.py"):
            continue
        for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("maskline.llm", "corpus_pipeline")) for n in names), inside


def test_the_rest_works_without_it():
    code = "import sys; sys.modules['maskline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)

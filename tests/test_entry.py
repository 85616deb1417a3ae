"""The driver contract: names agree, the core stands without the optional subpackage, results equal their SQL."""

import glob
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_subpackage():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import tessera.registry as r; r.queries(); assert not [m for m in sys.modules if m.startswith('tessera.llm')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=TOP).returncode == 0


COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q)); assert set(e.oracle_sql()) <= set(q)"


def counted(top, before=""):
    out = subprocess.run([sys.executable, "-c", before + COUNT], cwd=top, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(top)})
    assert out.returncode == 0, out.stderr
    return tuple(map(int, out.stdout.split()))


def test_a_copy_without_the_subpackage_stands(tmp_path):
    shutil.copytree(TOP, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    core, llm = counted(tmp_path / "repo")
    assert core > 50 and llm == 0
    assert subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path / "repo", capture_output=True).returncode == 0


@pytest.mark.parametrize("missing", ["xxhash", "regex", "corpus_pipeline", "tessera.llm"])
def test_a_missing_dependency_leaves_the_core(missing):
    core, llm = counted(TOP, f"import sys; sys.modules['{missing}'] = None; ")
    assert core > 50 and llm == 0


@pytest.mark.skipif(not glob.glob(SF), reason="no small tables")
def test_workers_get_the_package(tmp_path):
    """As on a cluster: no Python worker has the repository on its path."""
    code = f"""import sys; sys.path.insert(0, {TOP!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name in ("retrieve_top5", "hybrid_top5", "lsh_search", "index_add_equals_flat"):
    assert e.queries()[name](spark, {SF!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("PYSPARK_", "SPARK_"))}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env | {"PYSPARK_PYTHON": sys.executable})
    assert out.returncode == 0, out.stderr[-2000:]


@pytest.mark.skipif(not glob.glob(SF), reason="no small tables")
@pytest.mark.parametrize("name", ["retrieve_top5", "filter_reasons", "chunk_stats", "claims_regex", "claims_tail", "hybrid_top5", "pipeline_records", "entailment_rollup", "ablation"])
def test_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = c.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = [tuple(r[x] for x in columns) for r in entry.queries()[name](spark, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))

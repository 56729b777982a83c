"""The driver contract, and that the library stands without its training-data operators."""

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_queries_and_sql_have_the_same_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())
    assert {"gs_aabb", "gs_voxel_pairs", "gs_edge_pairs", "gs_edge_best", "pgs_voxel_pairs", "pgs_edge_best", "knn"} <= set(sql)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["vid", "gid", "cx", "cy", "cz", "density"] and df.count() > 0


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    for p in ("__spark_entry__.py", "splatframe", "tests"):
        subprocess.run(["cp", "-r", ROOT / p, tmp_path], check=True)
    for p in ("splatframe/llm", "tests/llm"):
        subprocess.run(["rm", "-rf", tmp_path / p], check=True)
    env = {"PATH": os.environ["PATH"], "HOME": str(tmp_path)}
    code = "import __spark_entry__ as e; assert 'knn' in e.queries() and not [q for q in e.queries() if q.startswith('op')]; assert set(e.oracle_sql()) == set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    # The tests that are left run there too: one of them here, in a session of its own.
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_geometry.py", "-k", "bounds or histogram or touching"], cwd=tmp_path, check=True, env=env)


def test_a_missing_package_leaves_the_other_queries(tmp_path):
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert 'knn' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)

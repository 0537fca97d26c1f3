"""Driver contract and query registry."""

import importlib.util
import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import SF001

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    df = _entry().entry(spark)
    assert df.count() > 0
    assert "gross_profit_ratio" in df.columns


def test_oracles_have_queries():
    mod = _entry()
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def _keys():
    from quarry.catalog import REGISTRY
    return sorted(REGISTRY)


@pytest.mark.parametrize("name", _keys())
def test_every_query_runs(spark, name):
    """Each registered key once, to its last row."""
    df = _entry().queries()[name](spark, SF001)
    assert len(df.columns) == len(set(df.columns))
    df.write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", ["dau", "gross_profit_report", "describe", "duplicate_rows",
                                  "mann_whitney_u", "knn_classify"])
def test_query_schema_stable(spark, name):
    q = _entry().queries()[name]
    a, b = q(spark, SF001), q(spark, SF001)
    assert a.schema == b.schema and a.count() == b.count()


def test_shuffle_partition_invariance(spark):
    q = _entry().queries()["new_user_revenue_share"]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = sorted(map(tuple, q(spark, SF001).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    many = sorted(map(tuple, q(spark, SF001).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == many


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_without_the_optional_parts(tmp_path, pipeline_too):
    """A copy without the optional folders, with and without the pipeline module, still lists its queries."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: [
        n for n in names if n in (".git", "__pycache__", "llm") or pipeline_too and n == "corpus_pipeline.py"])
    code = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
            "assert len(q) >= 80 and set(o) <= set(q) and 'pipeline' not in q; "
            "assert not any(k.startswith('op') and k[2].isdigit() for k in q)")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, check=True)

"""Every registered query of the engine against its SQL, and the plans of a few."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_module
from ruzi.queries import ORACLE_SQL, QUERIES, TABLES, opened

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return found


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 10
    assert set(ORACLE_SQL) == set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("kept", [(), ("corpus_pipeline.py",)])
def test_the_tree_works_without_the_training_data_operators(tmp_path, kept):
    """A copy without the optional subpackage, with and without the pipeline's file."""
    root = entry_module.ROOT
    shutil.copytree(f"{root}/ruzi", tmp_path / "ruzi", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(name for name in kept if os.path.exists(f"{root}/{name}"))):
        shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e; assert 'filter_topk' in e.queries() and set(e.oracle_sql()) == set(e.queries()), e.queries().keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def plan_of(frame):
    return frame._jdf.queryExecution().explainString(frame._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans_push_down_and_prune(spark):
    db = opened(spark, DATA, "lineitem", "orders", "nation")
    plan = plan_of(db.query("hitamo l_orderkey muri lineitem aho l_quantity >= 45 kandi l_discount < 0.05"))
    assert "GreaterThanOrEqual(l_quantity,45.0)" in plan and "l_extendedprice" not in plan
    assert "Exchange" not in plan
    for where in ("l_orderkey = 7", "l_orderkey ni 7", 'l_orderkey = "7"', "l_orderkey = $x"):
        assert "EqualTo(l_orderkey,7)" in plan_of(db.query(f"hitamo l_tax muri lineitem aho {where}", {"x": 7} if "$" in where else None)), where
    assert "LessThan(l_orderkey,7)" in plan_of(db.query("hitamo l_tax muri lineitem aho l_orderkey < 7"))
    assert "GreaterThan(n_nationkey" in plan_of(db.query("hitamo n_name muri nation aho n_nationkey > 3.5"))
    top = plan_of(db.query("hitamo l_orderkey muri lineitem tondeka l_quantity manuka imipaka 3"))
    assert "TakeOrderedAndProject" in top and "Exchange" not in top
    first = plan_of(db.query("hitamo l_orderkey muri lineitem imipaka 3"))
    assert "TakeOrderedAndProject" in first
    join = plan_of(db.query("hitamo o_orderkey muri lineitem huza orders aho l_orderkey = o_orderkey kandi l_quantity > 10"))
    assert "Join" in join and "Cartesian" not in join and "NestedLoop" not in join and "Sort [" not in join.split("SortMergeJoin")[0]
    group = plan_of(db.query("hitamo l_returnflag, bara(*) muri lineitem koranya l_returnflag"))
    assert "partial_count" in group and "_metadata" not in group
    top = plan_of(db.query("hitamo l_suppkey, bara(*) muri lineitem koranya l_suppkey tondeka bara(*) manuka, l_suppkey imipaka 5"))
    assert "HashAggregate" in top and "SortAggregate" not in top and "_metadata" not in top and "TakeOrderedAndProject" in top
    empty = plan_of(db.query("hitamo l_orderkey muri lineitem aho l_quantity > 5 kandi l_quantity < 3"))
    assert "Scan parquet" not in empty

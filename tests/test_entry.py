"""Driver contract: entry, queries, oracle keys and column names."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].total_customers == 1500
    assert rows[0].active_count == 993 and round(rows[0].latest_mrr, 2) == 245297444.96


def test_oracle_keys_subset_of_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 35
    for name in ("train_churn", "importances"):
        assert name in q and name not in o
    assert {"risk_ledger", "what_if", "score_scenarios"} <= set(o)


def test_no_query_caps_rows():
    import inspect
    from churnscope.plans import catalog
    src = inspect.getsource(catalog)
    # Only the feature limits (preview head, last cohorts, top-5 friction) exist.
    assert "LIMIT 5" in src and src.count(".limit(") == 0


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A query whose functions run in Python workers, from another working folder."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.abspath(E.__file__))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate())
E.queries()["kpis"](spark, "/root/testdata/sf0.001").collect()


def run(batches):
    import churnscope.roles
    for batch in batches:
        yield batch


assert spark.range(3).mapInArrow(run, "id long").count() == 3
print("found")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found" in done.stdout, done.stderr[-2000:]

"""The batch command line, run as a separate process (it owns its session)."""

import json
import os
import subprocess
import sys

from churnscope.operators import ml, preprocess
from churnscope.sources.generator import generate_customers

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _records(path):
    rows = []
    for f in sorted(os.listdir(path)):
        if f.endswith(".json"):
            with open(os.path.join(path, f)) as fh:
                rows += [json.loads(line) for line in fh if line.strip()]
    return rows


def test_cli_all_actions(spark, tmp_dir):
    g = generate_customers(spark, 400)
    g.coalesce(1).write.option("header", True).csv(os.path.join(tmp_dir, "upload"))
    sc = ml.as_scenarios(preprocess.preprocess(g), keep=()).limit(20)
    sc.coalesce(1).write.option("header", True).csv(os.path.join(tmp_dir, "scenarios"))
    out = os.path.join(tmp_dir, "out")
    cmd = [sys.executable, "-m", "churnscope", "profile", "kpis", "charts", "cohorts", "train",
           "ledger", "simulate", "--input", os.path.join(tmp_dir, "upload"), "--out", out,
           "--model", os.path.join(tmp_dir, "model"), "--scenarios", os.path.join(tmp_dir, "scenarios"),
           "--top", "10", "--trees", "10", "--depth", "4", "--master", "local[2]"]
    res = subprocess.run(cmd, cwd=REPO, capture_output=True, text=True, timeout=600)
    assert res.returncode == 0, res.stderr[-2000:]
    assert _records(os.path.join(out, "kpis"))[0]["total_customers"] == 400
    assert len(_records(os.path.join(out, "ledger"))) == 10
    assert len(_records(os.path.join(out, "simulation"))) == 20
    assert len(_records(os.path.join(out, "cohorts"))) == 12 * 12
    assert {r["Feature"] for r in _records(os.path.join(out, "importances"))} >= {"TenureMonths"}
    assert _records(os.path.join(out, "profile"))[0]["rows"] == 400

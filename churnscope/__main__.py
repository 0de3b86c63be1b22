"""Batch command line: the app's actions as Spark jobs over a customer table.

    python -m churnscope kpis     --input customers.csv --out out/ [--mapping m.json]
    python -m churnscope charts   --input customers.parquet --format parquet --out out/
    python -m churnscope cohorts  --input ... --out out/ [--wide]
    python -m churnscope train    --input ... --out out/ --model models/churn
    python -m churnscope ledger   --input ... --out out/ --model models/churn [--top 500] [--search CUST-1]
    python -m churnscope simulate --scenarios scenarios.csv --out out/ --model models/churn
    python -m churnscope profile  --input ... --out out/
    python -m churnscope sample   --rows 1000 --out out/
    python -m churnscope kpis charts cohorts train ledger --input ... --out out/   (several in order)

Every result is written by the executors as JSON records under ``--out``;
nothing is collected to the driver except one-row summaries.  ``--mapping``
is a JSON object from role to column name (missing roles map to the
same-named column).
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from churnscope.operators import charts, cohorts, insights, kpis, ml, preprocess, profile
from churnscope.session import build_session
from churnscope.sources import models
from churnscope.sources.export import export
from churnscope.sources.files import read_customers
from churnscope.sources.generator import generate_customers


def _clean(spark, args):
    raw = read_customers(spark, args.input, fmt=args.format)
    mapping = None
    if args.mapping:
        with open(args.mapping) as fh:
            mapping = json.load(fh)
    return raw, preprocess.preprocess(raw, mapping)


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="churnscope")
    p.add_argument("actions", nargs="+", choices=["profile", "kpis", "charts", "cohorts", "train",
                                                  "ledger", "simulate", "sample"])
    p.add_argument("--input")
    p.add_argument("--format", default="csv", choices=["csv", "parquet"])
    p.add_argument("--mapping")
    p.add_argument("--out", required=True)
    p.add_argument("--model")
    p.add_argument("--top", type=int)
    p.add_argument("--search")
    p.add_argument("--wide", action="store_true")
    p.add_argument("--scenarios")
    p.add_argument("--rows", type=int, default=1000)
    p.add_argument("--trees", type=int, default=ml.NUM_TREES)
    p.add_argument("--depth", type=int, default=ml.MAX_DEPTH)
    p.add_argument("--master")
    args = p.parse_args(argv)

    spark = build_session(args.master)
    out = args.out

    def put(name, df, small=False):
        export(df, os.path.join(out, name), "json", single_file=small)

    for action in args.actions:
        if action == "sample":
            put("sample", generate_customers(spark, args.rows))
        elif action == "profile":
            raw = read_customers(spark, args.input, fmt=args.format)
            put("profile", profile.profile(raw), small=True)
            put("preview", profile.preview(raw), small=True)
        elif action == "kpis":
            _, clean = _clean(spark, args)
            put("kpis", kpis.kpis(clean), small=True)
        elif action == "charts":
            _, clean = _clean(spark, args)
            support = charts.support_churn(clean)
            put("plan_distribution", charts.plan_revenue_share(charts.plan_distribution(clean)), small=True)
            put("signup_trend", charts.signup_trend(clean), small=True)
            put("support_correlation", support, small=True)
            put("insights", insights.insights(kpis.kpis(clean), support), small=True)
        elif action == "cohorts":
            _, clean = _clean(spark, args)
            put("cohorts", cohorts.cohort_matrix(clean, wide=args.wide), small=True)
        elif action == "train":
            _, clean = _clean(spark, args)
            model, metrics = ml.train_churn(clean, num_trees=args.trees, max_depth=args.depth)
            models.save_model(model, args.model or models.model_path(spark, "churn"))
            put("metrics", metrics, small=True)
            put("importances", model.importances(spark), small=True)
        elif action == "ledger":
            _, clean = _clean(spark, args)
            model = models.load_model(args.model or models.model_path(spark, "churn"))
            put("ledger", ml.risk_ledger(clean, model, top_n=args.top, search=args.search))
        elif action == "simulate":
            model = models.load_model(args.model or models.model_path(spark, "churn"))
            sc = spark.read.option("header", True).option("inferSchema", True).csv(args.scenarios)
            put("simulation", ml.score_scenarios(sc, model))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())

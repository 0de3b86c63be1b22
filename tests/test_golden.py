"""Golden values of the derived subscriptions table (FIXTURES.md section 4)."""

import os

import pytest
from pyspark.sql import functions as F

from churnscope.plans import catalog as C
from churnscope.sources.export import export

GOLDEN = {
    "/root/testdata/sf0.001": (1500, 993, 485, 245297444.96, 8320529.57, 1467.23),
    "/root/testdata/sf0.01": (15000, 9937, 4851, 2444150705.85, 8308672.25, 1520.95),
    "/root/testdata/sf0.1": (150000, 98876, 49011, 24286124690.71, 8356235.29, 1526.28),
}


@pytest.mark.parametrize("sf_dir", sorted(GOLDEN))
def test_fixture_golden_values(spark, sf_dir):
    rows, active, churned, mrr, ltv, cac = GOLDEN[sf_dir]
    k = C.q_kpis(spark, sf_dir).first()
    assert k.total_customers == rows and k.active_count == active
    # FIXTURES rounds half-up to cents; compare within half a cent.
    for got, want in ((k.latest_mrr, mrr), (k.avg_ltv, ltv), (k.avg_cac, cac)):
        assert abs(got - want) <= 0.005 + 1e-9, (got, want)
    n_churned = C.cleaned(spark, sf_dir).where(F.lower("Status").isin("churned", "inactive")).count()
    assert n_churned == churned


def test_export_roundtrip(spark, tmp_dir):
    k = C.q_kpis(spark, "/root/testdata/sf0.001")
    path = export(k, os.path.join(tmp_dir, "kpis"), "json", single_file=True)
    back = spark.read.json(path).first()
    assert back.total_customers == 1500
    with pytest.raises(ValueError):
        export(k, os.path.join(tmp_dir, "x"), "xlsx")

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from churnscope.session import build_session

    spark = build_session("local[4]", 4, app_name="churnscope-tests", extra={
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    # Tests may set their own checkpoint folder only when the cluster names none.
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="churnscope-test-ckpt-"))
    yield spark


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="churnscope-test-")


ROLE_SCHEMA = ("CustomerID string, SignupDate string, PlanType string, MonthlyRevenue string, "
               "Status string, TenureMonths string, SupportTickets string, UsageFrequency string, "
               "LastLoginDaysAgo string, LTV string, CAC string")


def customers(spark, rows):
    """Role-named raw table from dicts (missing keys -> null)."""
    cols = [c.split()[0] for c in ROLE_SCHEMA.split(", ")]
    data = [tuple(None if r.get(c) is None else str(r.get(c)) for c in cols) for r in rows]
    return spark.createDataFrame(data, ROLE_SCHEMA)

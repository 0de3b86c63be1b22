"""Status class flags.

The reference reads Status by three rules; all use the lower-cased text with
no trimming, and a null status belongs to neither named class:

* ``is_active``: ``active``;
* ``is_churned``: ``churned`` or ``inactive`` (KPIs, support split, ML target);
* cohort retention treats everything that is not active as churned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status texts (lower case) for the two named classes.
ACTIVE_STATUS = "active"
CHURNED_STATUSES = ("churned", "inactive")


def _status(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(c.cast("string"))


def is_active(c: Column | str = "Status") -> Column:
    return F.coalesce(_status(c) == F.lit(ACTIVE_STATUS), F.lit(False))


def is_churned(c: Column | str = "Status") -> Column:
    return F.coalesce(_status(c).isin(*CHURNED_STATUSES), F.lit(False))


STATUS_CLASS = "churnscope_status_class"  # reserved: uploads with such a column are refused


def status_class(c: Column | str = "Status") -> Column:
    """``active``, ``churned`` or ``other``: a storage-layout column.

    Registered datasets can be partitioned by it, so a filter on one class
    reads only that class's files (partition pruning).
    """
    return (F.when(is_active(c), F.lit("active"))
             .when(is_churned(c), F.lit("churned"))
             .otherwise(F.lit("other")))


def churn_target(c: Column | str = "Status") -> Column:
    """ML label: 1.0 for churned/inactive, else 0.0."""
    return F.when(is_churned(c), F.lit(1.0)).otherwise(F.lit(0.0))


def retained_in_month(month_idx: int, status: Column | str = "Status",
                      tenure: Column | str = "TenureMonths") -> Column:
    """Cohort rule: active rows count while ``i <= tenure``, others while ``i < tenure``."""
    ten = F.col(tenure) if isinstance(tenure, str) else tenure
    i = F.lit(month_idx)
    return F.when(is_active(status), i <= ten).otherwise(i < ten)

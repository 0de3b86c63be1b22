"""Pure ``Column`` helpers (no actions, no UDFs)."""

from churnscope.functions.cleaning import (NA_TOKENS, clean_int, clean_money, is_invalid_number,
                                           na_to_null, parse_number)
from churnscope.functions.dates import DATE_FORMATS, MISSING_MONTH, DateFormat, month_bucket, parse_as, parse_date
from churnscope.functions.labels import (ltv_cac_band, percent_text, retention_action, risk_band,
                                         risk_color)
from churnscope.functions.rounding import round_half_even
from churnscope.functions.status import (churn_target, is_active, is_churned, retained_in_month,
                                         status_class)

__all__ = [
    "NA_TOKENS", "clean_int", "clean_money", "is_invalid_number", "na_to_null", "parse_number",
    "DATE_FORMATS", "DateFormat", "MISSING_MONTH", "month_bucket", "parse_as", "parse_date",
    "ltv_cac_band", "percent_text", "retention_action", "risk_band", "risk_color",
    "churn_target", "is_active", "is_churned", "retained_in_month", "status_class",
    "round_half_even",
]

"""Threshold labels: risk bands, retention actions, LTV:CAC bands, percent text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnscope.functions.rounding import round_half_even

# Churn-probability cut-offs and the texts/colours per band.
HIGH_RISK_AT = 0.70
MEDIUM_RISK_AT = 0.40
LEDGER_LABELS = ("🔴 HIGH RISK", "🟡 MEDIUM RISK", "🟢 SAFE")
PLAIN_LABELS = ("HIGH RISK", "MEDIUM RISK", "SAFE")
RISK_COLORS = ("#EF4444", "#F59E0B", "#10B981")
PROTOCOLS = (
    "⚠️ **Retention Call Required:** Customer shows immediate risk signals (low login count / high support volume). Assign a Senior Account Executive or Customer Success Specialist immediately. Offer a proactive contract review or a 20% growth plan discount.",
    "🔔 **Nurturing Campaign Recommended:** Customer retention is slightly volatile. Add to targeted automated tutorial emails showcasing newly released product updates. Check in via customer support to resolve outstanding tickets.",
    "✅ **Healthy Account Status:** Customer is fully engaged. Excellent candidate for up-selling growth tiers or requesting a testimonial/advocacy review.",
)

# LTV:CAC benchmark 3.0x (green), 1.0x (amber), else red.
LTV_CAC_BENCHMARK = 3.0
LTV_CAC_FLOOR = 1.0
BAND_COLORS = ("#10B981", "#F59E0B", "#EF4444")


def _three_way(p: Column, values: tuple[str, str, str]) -> Column:
    return (F.when(p >= F.lit(HIGH_RISK_AT), F.lit(values[0]))
             .when(p >= F.lit(MEDIUM_RISK_AT), F.lit(values[1]))
             .otherwise(F.lit(values[2])))


def risk_band(p: Column | str, emoji: bool = True) -> Column:
    """HIGH RISK from 0.70, MEDIUM RISK from 0.40, else SAFE."""
    p = F.col(p) if isinstance(p, str) else p
    return _three_way(p, LEDGER_LABELS if emoji else PLAIN_LABELS)


def risk_color(p: Column | str) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return _three_way(p, RISK_COLORS)


def retention_action(p: Column | str) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return _three_way(p, PROTOCOLS)


def ltv_cac_band(ratio: Column | str) -> Column:
    r = F.col(ratio) if isinstance(ratio, str) else ratio
    return (F.when(r >= F.lit(LTV_CAC_BENCHMARK), F.lit(BAND_COLORS[0]))
             .when(r >= F.lit(LTV_CAC_FLOOR), F.lit(BAND_COLORS[1]))
             .otherwise(F.lit(BAND_COLORS[2])))


def percent_text(p: Column | str) -> Column:
    """``0.0625 -> "6.2%"``: half-even to one decimal (Python's rule), then formatted."""
    p = F.col(p) if isinstance(p, str) else p
    return F.format_string("%.1f%%", round_half_even(p * F.lit(100.0), 1))

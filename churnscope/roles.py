"""The eleven standard roles a customer table is mapped onto."""

from __future__ import annotations

# The role names and their order as the reference defines them.
ROLES = (
    "CustomerID",
    "SignupDate",
    "PlanType",
    "MonthlyRevenue",
    "Status",
    "TenureMonths",
    "SupportTickets",
    "UsageFrequency",
    "LastLoginDaysAgo",
    "LTV",
    "CAC",
)

MONEY_ROLES = ("MonthlyRevenue", "LTV", "CAC")
INT_ROLES = ("TenureMonths", "SupportTickets", "UsageFrequency", "LastLoginDaysAgo")

# Model features in the fixed order the reference assembles them.
FEATURES = ("TenureMonths", "UsageFrequency", "SupportTickets", "LastLoginDaysAgo",
            "PlanType", "MonthlyRevenue")


def identity_mapping() -> dict[str, str]:
    return {r: r for r in ROLES}

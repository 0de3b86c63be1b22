"""Response curves: how a customer's churn probability moves along each slider.

A forest is constant between its split thresholds, so the thresholds of a
feature cut its slider into the exact intervals; a grid of values would only
sample them.  Every customer gets one row per field and interval.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions import risk_band
from churnscope.operators.filters import active_filter
from churnscope.operators.forest import Forest, with_probability
from churnscope.operators.ml import SCENARIO_FIELDS, ChurnModel, with_plan_code

# The simulator's slider ranges.
SLIDERS = {"revenue": (10.0, 500.0), "tenure": (1.0, 36.0), "usage": (0.0, 30.0), "tickets": (0.0, 15.0), "last_login": (0.0, 90.0)}


def intervals(forest: Forest, field: str, low: float, high: float) -> list[tuple[float, float]]:
    """The stretches ``(low, high]`` of a slider between the forest's
    thresholds; the first one holds its lower end as well."""
    inside = [t for t in forest.thresholds(SCENARIO_FIELDS[field]) if low <= t < high]
    edges = [low, *[t for t in inside if t > low], high]
    out = list(zip(edges[:-1], edges[1:])) if high > low else [(low, high)]
    # A threshold at the very start parts that one value from the rest.
    return [(low, low), *out] if low in inside and high > low else out


def response_curves(df: DataFrame, model: ChurnModel, fields: Iterable[str] = tuple(SLIDERS),
                    ranges: Mapping[str, tuple[float, float]] | None = None, active_only: bool = True) -> DataFrame:
    """Rows ``CustomerID, field, low, high, probability, change, risk_text``.

    ``probability`` holds for every value above ``low`` up to ``high`` of the
    field, the customer's other values as they are; ``change`` is its
    difference from the customer's own probability.  The number of rows is
    customers times intervals, which the model bounds; all of it is row-wise.
    """
    model = model.native()
    forest, bounds = model.forest, {**SLIDERS, **(ranges or {})}
    fields = list(fields)
    unknown = [f for f in fields if f not in SLIDERS]
    if unknown:
        raise ValueError(f"no sliders: {unknown}")
    steps = [F.struct(F.lit(f).alias("field"), F.lit(a).alias("low"), F.lit(b).alias("high"))
             for f in fields for a, b in intervals(forest, f, *map(float, bounds[f]))]
    base = active_filter(df) if active_only else df
    # The feature columns come under their own names, the plan as its code.
    coded = with_plan_code(base, model.plans).select(
        "CustomerID", *[F.col("_plan_code" if f == "PlanType" else f).cast("double").alias(f) for f in forest.features])
    own = with_probability(coded, forest, {f: F.col(f) for f in forest.features}, "own")
    long = own.select("*", F.inline(F.array(*steps)))
    # Any value of an interval does: its upper end, which the tests of splits include.
    moved = {SCENARIO_FIELDS[f]: F.when(F.col("field") == f, F.col("high")).otherwise(F.col(SCENARIO_FIELDS[f])) for f in fields}
    scored = with_probability(long, forest, {f: moved.get(f, F.col(f)) for f in forest.features}, "probability")
    return scored.select("CustomerID", "field", "low", "high", "probability", (F.col("probability") - F.col("own")).alias("change"),
                         risk_band("probability", emoji=False).alias("risk_text"))


def best_move(curves: DataFrame) -> DataFrame:
    """Per customer, the field and interval with the lowest probability (ties:
    first field by name, lowest interval)."""
    best = F.min(F.struct("probability", "field", "low", "high", "change")).alias("b")
    return curves.groupBy("CustomerID").agg(best).select(
        "CustomerID", "b.field", "b.low", "b.high", "b.probability", "b.change")

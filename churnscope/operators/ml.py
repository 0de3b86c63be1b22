"""Churn model: target/plan encoding, hash split, random forest, metrics,
importances, the ranked risk ledger and batch what-if scoring.

Everything here is distributed; only the fitted model's few parameters (tree
ensemble, six importances) ever sit on the driver.

* Split: a row goes to the test side when an md5 bucket of its customer ID
  falls in the top ``test`` share.  It is stable across partitionings and
  re-runs, needs no shuffle, and is stratified in expectation;
  ``balanced=True`` (the default of the training) holds out exactly as many
  rows of each class as the stratified rule asks for (``operators.splits``).
* Plan encoding: ordinal codes in ascending text order, fitted on every row
  (so the ledger never meets an unseen plan from its own table); a null plan
  is the class ``nan``.  The codes are fed to the forest as an ordinal number,
  not as a categorical feature.
* Forest: 100 trees, depth 6, seed 42, gini, ``int(sqrt(6)) = 2`` features per
  split, bootstrap.  Spark bins continuous features and bags per partition, so
  scores are close to, not equal to, another library's.  Training rows are
  dealt by a hash of their values to a set number of partitions and sorted
  there, so the fit doesn't depend on the layout of the input.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.functions import churn_target, risk_band, risk_color, retention_action
from churnscope.operators.filters import active_filter, id_search
from churnscope.operators.forest import Forest, from_model, with_probability
from churnscope.operators.ranks import ranked, write_again
from churnscope.operators.splits import stratified_split
from churnscope.roles import FEATURES
from churnscope.session import checkpoint_dir

# Text of a missing plan, split seed/share, forest settings.
MISSING_PLAN = "nan"
SPLIT_SEED = 42
TEST_SHARE = 0.25
NUM_TREES = 100
MAX_DEPTH = 6
FOREST_SEED = 42

_PLAN_TEXT, _PLAN_CODE, _PLAN_ORD = "_plan_text", "_plan_code", "_plan_ordinal"
# monotonically_increasing_id holds the partition above, the row's place in it below this bit.
_PLACE_BITS = 33
METRIC_NAMES = ("Accuracy", "Precision", "Recall", "F1-Score")


# ---------------------------------------------------------------------------
# Encoding and features
# ---------------------------------------------------------------------------

def with_target(df: DataFrame) -> DataFrame:
    return df.withColumn("target", churn_target("Status"))


def plan_text(c: str = "PlanType") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING_PLAN))


def fit_plan_encoder(df: DataFrame) -> DataFrame:
    """Plan dictionary ``_plan_text, _plan_code``: codes in ascending text order.

    The distinct plan texts are sorted globally and written to the shared
    folder with their place in their sorted partition; the partitions' row
    counts, summed up, are the offsets that make the places codes.  However
    many plans there are, none is brought to the driver: only the offsets (one
    row per sorted partition) meet in one task.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "plans", uuid.uuid4().hex)
    (df.select(plan_text().alias(_PLAN_TEXT)).distinct().orderBy(_PLAN_TEXT)
       .select(_PLAN_TEXT, F.monotonically_increasing_id().alias("id")).write.parquet(path))
    placed = spark.read.schema(f"{_PLAN_TEXT} string, id bigint").parquet(path).withColumn(
        "part", F.shiftright("id", _PLACE_BITS))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("part").count()
               .select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")))
    place = F.col("id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    coded = placed.join(offsets, "part").select(_PLAN_TEXT, (F.col("offset") + place).alias(_PLAN_CODE))
    coded.write.parquet(path + "-codes")
    return spark.read.schema(f"{_PLAN_TEXT} string, {_PLAN_CODE} bigint").parquet(path + "-codes")


def plan_code_of(plans: DataFrame, plan: str | None) -> int:
    """One plan's code (one value on the driver); 0 where it isn't in the dictionary."""
    row = plans.where(F.col(_PLAN_TEXT) == F.lit(MISSING_PLAN if plan is None else plan)).select(_PLAN_CODE).first()
    return row[0] if row else 0


def with_plan_code(df: DataFrame, plans: DataFrame, unseen: str = "error", code: int | None = None) -> DataFrame:
    """Add the plan's code as ``_plan_code``; ``code`` gives one for all rows.

    The dictionary is joined without a hint: Spark broadcasts it if its size
    allows, else shuffles (and splits a skewed plan).  ``unseen="first"`` maps
    a plan that is not in the dictionary to code 0 (the simulator's rule);
    ``"error"`` fails on it (the ledger's rule).
    """
    if code is not None:
        return df.withColumns({_PLAN_TEXT: plan_text(), _PLAN_CODE: F.lit(code).cast("bigint")})
    coded = df.withColumn(_PLAN_TEXT, plan_text()).join(plans, _PLAN_TEXT, "left")
    if unseen == "first":
        missing = F.lit(0)
    else:
        missing = F.raise_error(F.concat(F.lit("plan not seen in training: "), F.col(_PLAN_TEXT)))
    return coded.withColumn(_PLAN_CODE, F.coalesce(F.col(_PLAN_CODE), missing.cast("bigint")))


def plan_codes(df: DataFrame, plans: DataFrame) -> DataFrame:
    """``CustomerID, PlanType, plan_code`` (0-based, ascending text order)."""
    return with_plan_code(df, plans).select("CustomerID", "PlanType", F.col(_PLAN_CODE).alias("plan_code"))


def with_features(df: DataFrame, plans: DataFrame, unseen: str = "error", code: int | None = None) -> DataFrame:
    """Add the assembled vector ``features``; the plan code is an ordinal number in it."""
    coded = with_plan_code(df, plans, unseen, code).withColumn(_PLAN_ORD, F.col(_PLAN_CODE).cast("double"))
    inputs = [(_PLAN_ORD if f == "PlanType" else f) for f in FEATURES]
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error").transform(coded)


def feature_frame(df: DataFrame, plans: DataFrame) -> DataFrame:
    """The six model inputs as plain columns (plan as its ordinal code) plus the target."""
    return with_plan_code(with_target(df), plans).select(
        "CustomerID", *[F.col(f).cast("double").alias(f) for f in FEATURES if f != "PlanType"],
        F.col(_PLAN_CODE).cast("double").alias("PlanCode"), "target")


# ---------------------------------------------------------------------------
# Split
# ---------------------------------------------------------------------------

def split_bucket(id_col: str = "CustomerID", seed: int = SPLIT_SEED) -> Column:
    """Uniform [0, 1) value from md5(id#seed); a null id hashes as the empty text."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"#{seed}"))
    top32 = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return top32 / F.lit(4294967296.0)


def split(df: DataFrame, test: float = TEST_SHARE, seed: int = SPLIT_SEED,
          balanced: bool = False, label: str = "target") -> DataFrame:
    """Add ``is_test``: hash-bucket split, stratified in expectation.

    ``balanced=True`` is the exact stratified split of :func:`stratified_split`.
    """
    if balanced:
        return stratified_split(df, test, seed, label)
    return df.withColumn("is_test", split_bucket(seed=seed) >= F.lit(1.0 - test))


# ---------------------------------------------------------------------------
# Metrics
# ---------------------------------------------------------------------------

def binary_metrics(pred: DataFrame, label: str = "target", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1, in percent; 0 on a zero denominator.

    One global aggregate of the four confusion counts.
    """
    y = F.col(label) == F.lit(1.0)
    p = F.col(prediction) == F.lit(1.0)
    c = pred.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                 F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def ratio(num, den):
        return F.when(den > 0, num / den * F.lit(100.0)).otherwise(F.lit(0.0))

    return c.select(ratio(tp + tn, n).alias("Accuracy"),
                    ratio(tp, tp + fp).alias("Precision"),
                    ratio(tp, tp + fn).alias("Recall"),
                    ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("F1-Score"),
                    "tp", "fp", "fn", "tn")


# ---------------------------------------------------------------------------
# Training
# ---------------------------------------------------------------------------

@dataclass
class ChurnModel:
    plans: DataFrame  # the plan dictionary
    forest: object  # RandomForestClassificationModel, or a Forest of plain arrays
    metrics_row: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, unseen: str = "error", code: int | None = None) -> DataFrame:
        """Score rows; adds ``churn_probability`` (class-1 probability)."""
        if isinstance(self.forest, Forest):
            coded = with_plan_code(df, self.plans, unseen, code)
            return with_probability(coded, self.forest, {
                f: F.col(_PLAN_CODE if f == "PlanType" else f) for f in self.forest.features})
        scored = self.forest.transform(with_features(df, self.plans, unseen, code))
        return scored.withColumn("churn_probability", churn_probability())

    def native(self) -> ChurnModel:
        """The same model as plain arrays, scored by native expressions."""
        if isinstance(self.forest, Forest):
            return self
        return ChurnModel(self.plans, from_model(self.forest, FEATURES), self.metrics_row)

    def importances(self, spark: SparkSession) -> DataFrame:
        """``(Feature, Importance)`` in descending importance (six driver-side values)."""
        imp = self.forest.featureImportances.toArray().tolist()
        rows = sorted(zip(FEATURES, (float(v) for v in imp)), key=lambda r: -r[1])
        return spark.createDataFrame(rows, "Feature string, Importance double")


def churn_probability(prob_col: str = "probability") -> Column:
    """Class-1 probability; a forest trained on one class yields 1 or 0.

    Spark gives a one-element vector when only class 0 was seen and
    ``[0, 1]`` when only class 1 was; ``try_element_at`` covers both.
    """
    return F.coalesce(F.try_element_at(vector_to_array(F.col(prob_col)), F.lit(2)), F.lit(0.0))


def forest_params(num_trees: int = NUM_TREES, max_depth: int = MAX_DEPTH, seed: int = FOREST_SEED,
                  **extra):
    """Forest settings; ``extra`` passes any other ``RandomForestClassifier``
    parameter through (e.g. ``maxBins=128`` for finer continuous splits)."""
    params = dict(numTrees=num_trees, maxDepth=max_depth, seed=seed, impurity="gini",
                  featureSubsetStrategy=str(max(1, int(math.sqrt(len(FEATURES))))),
                  bootstrap=True, subsamplingRate=1.0, minInstancesPerNode=1,
                  maxMemoryInMB=512, cacheNodeIds=True, checkpointInterval=10)
    params.update(extra)
    return params


def train_churn(df: DataFrame, test: float = TEST_SHARE, seed: int = SPLIT_SEED, balanced: bool = True,
                partitions: int | None = None, **forest_kw) -> tuple[ChurnModel, DataFrame]:
    """Fit the plan dictionary (all rows) and forest (train rows); evaluate on the test rows.

    Returns the model and its one-row metrics frame.  The narrow model input
    (seven columns plus the split flag) is persisted once, memory first and
    spilling to disk, and serves the dictionary, the forest's passes and the
    hold-out scoring; it is released before returning, so the one-row metrics
    are computed eagerly.  A lost executor recomputes its blocks from the
    short parquet lineage.

    The training rows are dealt by a hash of their values to ``partitions``
    partitions (default: the session's shuffle width), each sorted: every core
    grows trees, and the fit is the same for every layout of the input (rows
    equal in all columns stay together).
    """
    spark = df.sparkSession
    checkpoint_dir(spark)  # node-id cache checkpoints go to the shared folder
    width = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    inputs = ["Status", *FEATURES]
    rows = with_target(df.select("CustomerID", *inputs)).select("CustomerID", "target", *FEATURES)
    parts = (split(rows, test, seed, balanced)
             .select("target", "is_test", *FEATURES, F.xxhash64("CustomerID", *FEATURES).alias("_deal"))
             .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        plans = fit_plan_encoder(parts)
        feats = with_features(parts, plans)
        dealt = (feats.where(~F.col("is_test")).repartition(width, "_deal")
                 .sortWithinPartitions("_deal").select("features", "target"))
        rf = RandomForestClassifier(featuresCol="features", labelCol="target", **forest_params(**forest_kw))
        forest = rf.fit(dealt)
        row = binary_metrics(forest.transform(feats.where(F.col("is_test")))).first()
    finally:
        parts.unpersist()
    model = ChurnModel(plans, forest, row.asDict())
    metrics = spark.createDataFrame([row], binary_metrics_schema())
    return model, metrics


def binary_metrics_schema() -> str:
    return ("Accuracy double, Precision double, Recall double, `F1-Score` double, "
            "tp bigint, fp bigint, fn bigint, tn bigint")


# ---------------------------------------------------------------------------
# Ledger and what-if scoring
# ---------------------------------------------------------------------------

LEDGER_COLUMNS = ("CustomerID", "PlanType", "MonthlyRevenue", "TenureMonths", "SupportTickets",
                  "LastLoginDaysAgo", "ChurnRiskProbability", "RiskCategory")


def risk_ledger(df: DataFrame, model: ChurnModel, top_n: int | None = None,
                search: str | None = None, literal: bool = False) -> DataFrame:
    """Active customers scored and ranked by churn probability (descending).

    The ID search is applied before scoring (a row filter commutes with
    row-wise scoring).  Ties are ordered by customer ID and then by a hash of
    the row, which also lets the range-partitioned sort split a value shared
    by many rows.
    """
    act = id_search(active_filter(df), search, literal=literal)
    rows = ledger_rows(model.transform(act))
    # The sort samples its input first: written rows are scored once.
    return ledger_order(rows if top_n is not None else write_again(rows, "ledger"), top_n)


def rank_ledger(scored: DataFrame, top_n: int | None = None) -> DataFrame:
    """The ledger's columns, bands and order for rows that carry ``churn_probability``."""
    return ledger_order(ledger_rows(scored), top_n)


def ledger_order(out: DataFrame, top_n: int | None = None) -> DataFrame:
    """Ledger rows by probability, descending, then by ID."""
    # A deterministic hash of the other columns is the last key, so even a
    # third of the rows sharing one id and one score spread over many range
    # partitions (and a retried task re-computes the same keys).
    spread = F.xxhash64(*[F.col(c) for c in LEDGER_COLUMNS if c != "CustomerID"])
    out = out.orderBy(F.col("ChurnRiskProbability").desc(), F.col("CustomerID").asc_nulls_last(), spread)
    return out if top_n is None else out.limit(top_n)


def ledger_rows(scored: DataFrame) -> DataFrame:
    """The ledger's columns of scored rows, in no order."""
    return scored.select(
        F.col("CustomerID").cast("string").alias("CustomerID"),
        plan_text().alias("PlanType"),
        F.col("MonthlyRevenue").cast("double").alias("MonthlyRevenue"),
        F.col("TenureMonths").cast("bigint").alias("TenureMonths"),
        F.col("SupportTickets").cast("bigint").alias("SupportTickets"),
        F.col("LastLoginDaysAgo").cast("bigint").alias("LastLoginDaysAgo"),
        F.col("churn_probability").alias("ChurnRiskProbability"),
        risk_band("churn_probability", emoji=True).alias("RiskCategory"))


def ledger_ranks(df: DataFrame, model: ChurnModel, tiles: int = 100) -> DataFrame:
    """The ledger's rows with ``row_number``, ``rank``, ``dense_rank``,
    ``percent_rank`` and ``tile`` by probability, descending.

    Customers of one probability share a rank; their IDs order them for
    ``row_number`` and ``tile``.  The scored rows are written once and sorted
    from there, so no row is scored twice.
    """
    return ranked(ledger_rows(model.transform(active_filter(df))), "ChurnRiskProbability",
                  [F.col("CustomerID").asc_nulls_last()], tiles)


# Simulator input fields -> roles (the reference's what-if record).
SCENARIO_FIELDS = {"plan": "PlanType", "revenue": "MonthlyRevenue", "tenure": "TenureMonths",
                   "usage": "UsageFrequency", "tickets": "SupportTickets",
                   "last_login": "LastLoginDaysAgo"}


def score_scenarios(scenarios: DataFrame, model: ChurnModel, keep: tuple[str, ...] = (), code: int | None = None) -> DataFrame:
    """Score simulator records ``plan, revenue, tenure, usage, tickets, last_login``.

    A plan the model has not seen scores as plan code 0 (the simulator's rule).
    Where all records have one plan, ``code`` may give its code.
    Output: the record, ``probability``, ``risk_text``, ``risk_color``, ``protocol``.
    """
    as_roles = scenarios.select(*keep, *[F.col(k).alias(v) for k, v in SCENARIO_FIELDS.items()])
    scored = model.transform(as_roles, unseen="first", code=code)
    return scored.select(*keep, *[F.col(v).alias(k) for k, v in SCENARIO_FIELDS.items()],
                         *_risk_outputs_from("churn_probability"))


def _risk_outputs_from(col: str) -> list[Column]:
    return [F.col(col).alias("probability"),
            risk_band(col, emoji=False).alias("risk_text"),
            risk_color(col).alias("risk_color"),
            retention_action(col).alias("protocol")]


def as_scenarios(df: DataFrame, keep: tuple[str, ...] = ("CustomerID",)) -> DataFrame:
    """Customer rows as simulator records."""
    return df.select(*keep, *[F.col(v).alias(k) for k, v in SCENARIO_FIELDS.items()])


def what_if(df: DataFrame, model: ChurnModel, overrides: Mapping[str, object],
            active_only: bool = True) -> DataFrame:
    """Re-score customers with some simulator fields overridden.

    ``overrides`` uses the simulator's field names (``tickets=0`` ...).
    Output per customer: ``baseline_probability`` (as they are), the
    overridden record, ``probability`` and its band, colour and protocol.
    Both scorings are narrow transforms in one job; no shuffle.
    """
    unknown = set(overrides) - set(SCENARIO_FIELDS)
    if unknown:
        raise ValueError(f"unknown scenario fields: {sorted(unknown)}")
    base = active_filter(df) if active_only else df
    recs = as_scenarios(base)
    first = score_scenarios(recs, model, keep=("CustomerID",))
    first = first.select("CustomerID", *SCENARIO_FIELDS, F.col("probability").alias("baseline_probability"))
    changed = first.withColumns({k: F.lit(v).cast(first.schema[k].dataType) for k, v in overrides.items()})
    # One plan for all needs no join.
    code = plan_code_of(model.plans, overrides["plan"]) if "plan" in overrides else None
    return score_scenarios(changed, model, keep=("CustomerID", "baseline_probability"), code=code)


def scenario_grid(spark: SparkSession, plans=("Starter", "Growth", "Enterprise"),
                  revenue=(99.0,), tenure=range(1, 37), usage=range(0, 31),
                  tickets=range(0, 16), last_login=range(0, 91)) -> DataFrame:
    """Every combination of the given simulator values, generated distributed.

    ``spark.range`` over the product size, each id decoded in mixed radix
    into one value per field: no cross join, no driver-side list of rows.
    Default ranges are the simulator's slider ranges.
    """
    dims = [("plan", list(plans), "string"), ("revenue", [float(v) for v in revenue], "double"),
            ("tenure", list(tenure), "bigint"), ("usage", list(usage), "bigint"),
            ("tickets", list(tickets), "bigint"), ("last_login", list(last_login), "bigint")]
    total = 1
    for _, vals, _ in dims:
        total *= len(vals)
    ids = spark.range(total)
    cols, radix = [], 1
    for name, vals, typ in reversed(dims):
        digit = (F.col("id") / F.lit(radix)).cast("bigint") % F.lit(len(vals))
        arr = F.array(*[F.lit(v) for v in vals]).cast(f"array<{typ}>")
        cols.append(F.element_at(arr, (digit + F.lit(1)).cast("int")).alias(name))
        radix *= len(vals)
    return ids.select(*reversed(cols))


def what_if_many(df: DataFrame, model: ChurnModel, scenarios: list[Mapping[str, object]],
                 active_only: bool = True) -> DataFrame:
    """:func:`what_if` for several override sets, tagged ``scenario`` 0..k-1.

    One narrow re-scoring per set, unioned: work grows linearly with the
    number of sets (no cross join of customers with a scenario table).
    """
    if not scenarios:
        raise ValueError("give at least one override set")
    parts = [what_if(df, model, o, active_only).withColumn("scenario", F.lit(i))
             for i, o in enumerate(scenarios)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Model store: save and load a fitted churn model.

A model is saved under the cluster's shared folder (``spark.checkpoint.dir``)
as one version holding its plan dictionary, its forest (a fitted one, or a
table of nodes) and its metrics, so any driver can load it and a save that
fails leaves the former model in place.
"""

from __future__ import annotations

import json
import os

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import SparkSession

from churnscope.operators.forest import Forest, from_nodes
from churnscope.operators.ml import ChurnModel
from churnscope.session import checkpoint_dir
from churnscope.sources.versions import announce, current, folder_name, new_version


class NoModelError(LookupError):
    """No model has been trained or saved for this key."""


def model_path(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "models", folder_name(name))


def save_model(model: ChurnModel, path: str) -> str:
    spark = model.plans.sparkSession
    version = new_version(spark, path)
    model.plans.write.parquet(os.path.join(version, "plans"))
    native = isinstance(model.forest, Forest)
    if native:
        model.forest.nodes(spark).coalesce(1).write.parquet(os.path.join(version, "nodes"))
    else:
        model.forest.save(os.path.join(version, "forest"))
    features = list(model.forest.features) if native else None
    metrics = spark.createDataFrame([(json.dumps(model.metrics_row), json.dumps(features))], "metrics string, features string")
    metrics.coalesce(1).write.parquet(os.path.join(version, "metrics"))
    announce(spark, path, version)
    return path


def load_model(path: str) -> ChurnModel:
    spark = SparkSession.active()
    version = current(spark, path)
    if version is None:
        raise NoModelError(f"no trained model at {path}: train one first")
    said = spark.read.parquet(os.path.join(version, "metrics")).first()
    features = json.loads(said["features"])
    forest = (from_nodes(spark.read.parquet(os.path.join(version, "nodes")), features) if features
              else RandomForestClassificationModel.load(os.path.join(version, "forest")))
    return ChurnModel(spark.read.parquet(os.path.join(version, "plans")), forest, json.loads(said["metrics"]))

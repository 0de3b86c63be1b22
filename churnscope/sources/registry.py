"""Dataset registry: one current dataset per owner, stored in the shared folder.

Registering writes the table as Parquet under ``spark.checkpoint.dir`` (the
folder every executor and driver of the cluster can reach) and returns a
DataFrame read back from it, which also cuts the lineage: later operators
scan the stored files instead of recomputing the upload's parsing.  A newer
upload by the same owner replaces the older one once it is completely written.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from churnscope.functions.status import STATUS_CLASS, status_class
from churnscope.session import checkpoint_dir
from churnscope.sources.versions import announce, current, folder_name, new_version


class NoDatasetError(LookupError):
    """No dataset has been registered for this owner/name."""


def dataset_path(spark: SparkSession, name: str = "current", owner: str = "default") -> str:
    return os.path.join(checkpoint_dir(spark), "datasets", f"owner-{folder_name(owner)}", folder_name(name))


def register_dataset(spark: SparkSession, df: DataFrame, name: str = "current",
                     owner: str = "default", by_status: bool = False) -> DataFrame:
    """Write ``df`` as the owner's current dataset and return it read back.

    ``by_status=True`` (for a cleaned, role-named table) adds the status
    class and partitions the files by it: the ledger and the churned views
    then read only their class's files.
    """
    path = dataset_path(spark, name, owner)
    version = new_version(spark, path)
    if by_status:
        df.withColumn(STATUS_CLASS, status_class("Status")).write.partitionBy(STATUS_CLASS).parquet(version)
    else:
        df.write.parquet(version)
    announce(spark, path, version)
    return spark.read.parquet(version)


def get_dataset(spark: SparkSession, name: str = "current", owner: str = "default") -> DataFrame:
    version = current(spark, dataset_path(spark, name, owner))
    if version is None:
        raise NoDatasetError(f"no dataset loaded for {owner!r}/{name!r}: upload one first")
    return spark.read.parquet(version)

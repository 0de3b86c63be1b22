"""Customer uploads as a file stream.

Each file dropped into the upload folder is one dataset, the way each upload
replaces the previous table in an interactive session.  The stream picks new
files up incrementally (Structured Streaming file source, exactly-once via its
checkpoint), and for every micro-batch computes the KPI row of each upload with
the batch operators, writing them to a Parquet table partitioned by batch id
(a retried batch overwrites its own partition, so the sink stays exact).  The work per
batch is a ``groupBy(upload)`` aggregate; no state is kept between batches,
because a file is read in exactly one micro-batch.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from churnscope.functions.cleaning import NA_TOKENS
from churnscope.operators.kpis import kpis
from churnscope.operators.preprocess import preprocess
from churnscope.roles import ROLES
from churnscope.session import checkpoint_dir


def upload_schema(columns=ROLES) -> StructType:
    """All-text schema of an upload (roles are coerced by the cleaners)."""
    return StructType([StructField(c, StringType(), True) for c in columns])


def upload_stream(spark: SparkSession, folder: str, schema: StructType | None = None,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """New CSV files of ``folder`` as a stream of raw rows tagged with their file."""
    reader = (spark.readStream.schema(schema or upload_schema())
              .option("header", True))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(folder)
    cols = [F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns]
    return raw.select(*cols, F.col("_metadata.file_path").alias("upload"))


def kpis_per_upload(spark: SparkSession, folder: str, output: str, checkpoint: str | None = None,
                    mapping: Mapping[str, str] | None = None, schema: StructType | None = None,
                    available_now: bool = True, name: str = "kpis_per_upload") -> StreamingQuery:
    """Start the stream; one KPI row per uploaded file is written to ``output``.

    The stream's progress is checkpointed in ``checkpoint`` (default: a
    folder named after the stream under the shared ``spark.checkpoint.dir``).
    """
    if checkpoint is None:
        checkpoint = os.path.join(checkpoint_dir(spark), "streams", name)
    stream = upload_stream(spark, folder, schema)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        clean = preprocess(batch, mapping)
        rows = kpis(clean, by=["upload"]).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        # Idempotent sink: a re-run of a batch (after a failure) replaces its
        # own partition instead of appending a second copy.
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(output))

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()

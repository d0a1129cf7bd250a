"""Slice-at-a-time processing of a growing folder of packed slices.

A slice is one row and its porosity needs nothing else, so the stream keeps no state and every slice is
written once, whatever order the files come in. Statistics over a volume are a batch query on the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelloom.layouts import SLICE_SCHEMA, slices_to_hist
from voxelloom.operators import porosity


def read_arriving_slices(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of packed slices as a stream."""
    return spark.readStream.schema(SLICE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_slice_porosity(slices: DataFrame, path: str, checkpoint: str, encoding: str = "u8", **rule) -> StreamingQuery:
    """Append the porosity of every new slice to Parquet; ends when the folder's present files are done.

    The encoding must be named: ``auto`` judges a volume by its largest value, which would depend on how files arrive.
    """
    if encoding == "auto":
        raise ValueError("name the encoding of arriving slices; auto needs whole volumes")

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        marked = porosity.pore_mask(slices_to_hist(batch), encoding=encoding, **rule)
        result = porosity.slice_porosity(marked).withColumn("batch", F.lit(batch_id))
        # A batch repeated after a failure replaces its own folder only.
        result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return slices.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Structured Streaming over a cohort that grows: the batch operators run unchanged on the stream.

Files that are added to the folder are read once each; profiles are kept as state by their group (sample and gene, or
sample and count), whose number doesn't depend on how many clonotypes have arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.clonotype import SAMPLE, SCHEMA
from ..operators.diversity import spectrum
from ..operators.usage import segment_usage

STREAM_SCHEMA = T.StructType([T.StructField(SAMPLE, T.StringType()), *SCHEMA.fields])


def arrivals(spark: SparkSession, folder: str, *, schema: T.StructType = STREAM_SCHEMA, files: int = 1000) -> DataFrame:
    """The clonotypes of Parquet files as they arrive in ``folder``, at most ``files`` of them a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def running_usage(stream: DataFrame, segment: str = "V", kind: str = "reads") -> DataFrame:
    """Segment usage of all that has arrived; for the output modes ``complete`` and ``update``."""
    return segment_usage(stream, segment, kind)


def running_spectrum(stream: DataFrame) -> DataFrame:
    """The count spectrum of all that has arrived, from which diversity follows."""
    return spectrum(stream)


def keep(profile: DataFrame, name: str, checkpoint: str, *, mode: str = "complete", sink: str = "memory", **options):
    """A started query that keeps ``profile`` in a sink, with its progress in ``checkpoint``."""
    return profile.writeStream.outputMode(mode).format(sink).queryName(name).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()

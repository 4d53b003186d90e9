"""Feature extraction as a stream: extraction keeps no state, so the plan of a table serves a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import features as P


def read_images(spark: SparkSession, folder: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def extract_stream(images: DataFrame, out: str, checkpoint: str, keep: list[str], side: int = 256, branches=P.CANONICAL) -> StreamingQuery:
    """Append the features of arriving images to a Parquet table; stops when what has arrived is done."""
    features = P.extract(images, side, branches, keep)
    return features.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

"""Incremental extraction of works as a stream of files."""

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshot import WORKS, extract_authorships


def extract_new_files(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Extract all files that an earlier run with this checkpoint hasn't seen, then end.
    The checkpoint makes each file count once, also after a failure."""
    works = spark.readStream.schema(WORKS).parquet(root)
    writer = extract_authorships(works).writeStream.format("parquet").partitionBy("updated_date")
    return writer.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Journal lines as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.records import JOURNAL


def journal_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the JSON lines below path as files arrive; unreadable lines have the event malformed."""
    rows = spark.readStream.schema(JOURNAL + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.withColumn("event", F.when(F.col("_bad").isNotNull(), "malformed").otherwise(F.col("event"))).drop("_bad")


def counts_to(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep counts by event and tier, rewritten after each batch."""
    counts = rows.groupBy("event", "tier").agg(F.count(F.lit(1)).alias("rows"))
    return counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Events over time: windows that serve tables and streams alike, and the streaming retrieval log.

Streams need a watermark, and that needs a timestamp with a zone; tables keep what they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, folder: str, late: str = "1 hour", schema: T.StructType = EVENTS, per_trigger: int = 4) -> DataFrame:
    """Event files as a stream with a watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _summed(events: DataFrame, window) -> DataFrame:
    rows = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def tumbling(events: DataFrame, width: str) -> DataFrame:
    return _summed(events, F.window("ts", width))


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return _summed(events, F.window("ts", width, step))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def with_labels(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """A stream joined with a table."""
    return events.join(static, key, "left")


def once(documents: DataFrame, key: str = "content_hash") -> DataFrame:
    """A stream of documents with each content once within the watermark."""
    return documents.dropDuplicatesWithinWatermark([key])


def heat_stream(events: DataFrame) -> DataFrame:
    """Hits and mean value per user and hour, for update mode."""
    rows = events.groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("hits"), F.avg("value").alias("avg_score"))
    return rows.select(F.col("w.start").alias("start"), "user_id", "hits", "avg_score")


def upsert_into(path: str, keys: list[str]):
    """A foreachBatch function that keeps a Parquet table of the latest row per key. Batches are written under
    their number, so that a repeated batch replaces itself; readers take the newest number of each key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def resumable_embedding(spark: SparkSession, chunks: DataFrame, path: str, embed) -> DataFrame:
    """Embeds the chunks that a table at ``path`` lacks, appends them, and gives the whole table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        chunks = chunks.join(spark.read.parquet(path).select("chunk_id"), "chunk_id", "left_anti")
    embed(chunks.dropDuplicates(["chunk_id"])).write.mode("append").parquet(path)
    return spark.read.parquet(path)

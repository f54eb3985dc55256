"""Incremental board: grade reports arrive as files, the question table and board follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

QUESTION = "entry_id string, subset string, run_index int, question_id string, mode string, max_points double, awarded double, graded_at timestamp"
KEY = ["entry_id", "subset", "run_index", "question_id"]


def reports(spark: SparkSession, path: str, schema: str = QUESTION, late: str = "1 day") -> DataFrame:
    """Question rows of JSON files as they arrive, each key once within the watermark."""
    rows = spark.readStream.schema(schema).json(path)
    return rows.withWatermark("graded_at", late).dropDuplicatesWithinWatermark(KEY)


def windowed_progress(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    """Questions and points graded per entry and window of event time."""
    return rows.groupBy(F.window("graded_at", width).alias("w"), "entry_id").agg(F.count("*").alias("questions"), F.sum("awarded").alias("awarded")).select("w.start", "entry_id", "questions", "awarded")


def board(rows: DataFrame) -> DataFrame:
    """Totals per entry; a running aggregate (complete or update mode)."""
    return rows.groupBy("entry_id").agg(F.count("*").alias("questions"), F.sum("awarded").alias("awarded"), F.sum("max_points").alias("max_points"))


def write_batches(path: str):
    """A foreachBatch writer with one folder per batch: a batch that is done again replaces its own rows only."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def current(table: DataFrame) -> DataFrame:
    """The latest row of each key of a table that ``write_batches`` wrote."""
    rest = [c for c in table.columns if c not in (*KEY, "batch")]
    return table.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "batch").alias("_x")).select(*KEY, "_x.*")


def start(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; started again with the same checkpoint it takes what is new."""
    return rows.writeStream.foreachBatch(write_batches(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()

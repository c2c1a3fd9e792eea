"""A folder watched by Structured Streaming: new files are converted as they come.

Every micro-batch is written under its number, together with the names it has given out, so that a batch
that runs twice leaves one result and a name is given once for all runs: a later file whose output would
have the name of an earlier one gets the status ``collision`` instead of replacing it. A run that ends early,
by a fault or by ``cancel``, keeps the batches it has finished, and the next run goes on behind them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptloom.functions.dictionary import Dictionary
from scriptloom.plans.batch import convert_files
from scriptloom.sources import files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: Colliding names of one batch that are broadcast.
BROADCAST_NAMES = 100_000


def watch(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)


def _given(spark: SparkSession, names: str, before: int) -> DataFrame:
    """(output_name, path) of all names that earlier batches have given out."""
    try:
        return spark.read.schema("output_name string, path string, batch long").parquet(names).filter(F.col("batch") < before).drop("batch")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "output_name string, path string")


def _settled(found: DataFrame, names: str, batch: int) -> DataFrame:
    """(path, owner): files of a batch whose name another file has; of one batch the first path keeps it. Names it gives are written."""
    spark = found.sparkSession
    own = found.select("path", files.output_name(F.col("path")).alias("output_name")).groupBy("output_name").agg(F.min("path").alias("path"))
    given = _given(spark, names, batch).withColumnRenamed("path", "owner")
    own.join(given, "output_name", "left_anti").write.mode("overwrite").parquet(f"{names}/batch={batch}")
    mine = spark.read.parquet(f"{names}/batch={batch}").select("output_name", F.col("path").alias("owner"))
    every = found.select("path", files.output_name(F.col("path")).alias("output_name"))
    return every.join(mine.unionByName(given), "output_name").filter(F.col("path") != F.col("owner")).select("path", "owner")


def convert_stream(
    spark: SparkSession, folder: str, chain: Sequence[Dictionary], out: str, checkpoint: str, normalize: bool = True, files_per_batch: int | None = None, tag: str | None = None
) -> StreamingQuery:
    """Converts what lies in the folder and what has come since the last run, then ends; safe to run again.

    ``tag`` marks the run's jobs, for ``cancel``.
    """
    names = f"{checkpoint.rstrip('/')}/names"

    def settle(found: DataFrame, batch: int) -> None:
        lost = _settled(found.select("path"), names, batch)
        lost = F.broadcast(lost) if lost.count() <= BROADCAST_NAMES else lost
        done = convert_files(found, chain, normalize).join(lost, "path", "left")
        late = F.col("owner").isNotNull()
        shown = done.select(
            "path", "output_name",
            F.when(late, "collision").otherwise(F.col("status")).alias("status"),
            F.when(late, F.concat(F.lit("the name belongs to "), F.col("owner"))).otherwise(F.col("error")).alias("error"),
            F.when(~late, F.col("content")).alias("content"),
        )
        shown.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch}")

    writer = watch(spark, folder, files_per_batch).writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    context = spark.sparkContext
    tag = tag or f"feed-{uuid.uuid4().hex}"
    context.addJobTag(tag)  # the query's thread takes the tags over when it starts
    try:
        return writer.start()
    finally:
        context.removeJobTag(tag)


def cancel(spark: SparkSession, query: StreamingQuery, tag: str | None = None) -> None:
    """Ends a run now: its running jobs are cancelled, finished batches stay."""
    if tag:
        spark.sparkContext.cancelJobsWithTag(tag)
    query.stop()

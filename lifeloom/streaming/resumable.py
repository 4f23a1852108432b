"""Counts over a growing folder of files: each file is read once, and a run that stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def count_new_files(
    spark: SparkSession, source: str, state: str, schema: str, counted: Callable[[DataFrame], DataFrame], files_a_step: int = 50
) -> DataFrame:
    """Counts of all Parquet files under source so far: counted() of each step's rows, as rows of its own.

    Files are read by a stream whose checkpoint, under state, says which are done; each step of at most files_a_step
    files writes its counts to a folder of its own, replacing what an interrupted try left there, so no file counts
    twice or not at all. The caller sums the rows.
    """

    def step(rows: DataFrame, number: int) -> None:
        counted(rows).write.mode("overwrite").parquet(f"{state}/counts/step={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_step).parquet(source)
    run = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{state}/counts").drop("step")

"""Running a stream over the data that is there, with idempotent micro-batch output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skylattice.session import path_exists, scratch_path


#: Checkpoint and output folder of a stream that goes on after a restart.
Folders = tuple[str, str] | None


def file_stream(spark: SparkSession, folder: str, like: DataFrame, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Stream of parquet files of a folder with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def each_batch(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None], mode: str = "update", state: str | None = None) -> None:
    """Drive ``stream`` over the available data; ``write`` gets every micro-batch with its number.

    ``state``: checkpoint folder to go on from; a fresh one by default.
    """
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", state or scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def to_table(stream: DataFrame, name: str, mode: str = "update", folders: tuple[str, str] | None = None) -> DataFrame:
    """All emitted rows with their batch number, as a table.

    A batch writes its own folder and overwrites it when repeated, so a retry adds nothing twice.
    ``folders``: checkpoint and output folder, kept together; a stream that starts again with them
    goes on and reads the earlier batches too. Fresh ones by default.
    """
    spark = stream.sparkSession
    state, path = folders or (None, scratch_path(spark, name))

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    each_batch(stream, name, write, mode, state)
    schema = stream.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def batch_parts(stream: DataFrame, part: Callable[[DataFrame], DataFrame], name: str, folders: Folders = None) -> DataFrame:
    """``part`` of every micro-batch, as a table of parts.

    A batch writes its own folder and overwrites it when repeated. ``folders``: checkpoint and output folder, kept
    together, to go on after a restart; fresh ones by default. The parts are for sums at read time; a job between two
    runs may replace the folders of several batches by one with their sum.
    """
    spark = stream.sparkSession
    state, path = folders or (None, scratch_path(spark, name))
    # an empty part says what the table looks like before anything has landed
    schema = part(spark.createDataFrame([], stream.schema)).schema

    def write(df: DataFrame, batch: int) -> None:
        part(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    each_batch(stream, name, write, "append", state)
    return spark.read.schema(schema).parquet(path).select(*schema.names) if path_exists(spark, path) else spark.createDataFrame([], schema)

"""Minibatch passes over streams: each micro-batch is one statistic folded into a state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


class StreamingPass:
    """Runs fold(batch, batch_id) on every micro-batch until the stream is drained. The checkpoint makes a restart go on
    where it stopped; a batch that is seen again after a failure has the id that it had before."""

    def __init__(self, stream: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str):
        self.stream, self.fold, self.checkpoint, self.query = stream, fold, checkpoint, None

    def start(self) -> "StreamingPass":
        self.query = self.stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        return self

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def finish(self) -> None:
        """Waits for the stream's end."""
        if self.query is None:
            self.start()
        self.query.awaitTermination()


class RunningSums:
    """Sums by key over micro-batches, one per batch id: a batch that comes twice counts once. Each batch's partial sums
    are written as a table of their own; the state is their sum."""

    def __init__(self, path: str):
        self.path = path

    def fold(self, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        def f(batch: DataFrame, number: int) -> None:
            make(batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

        return f

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


class StreamingTrainer:
    """A model that learns from each micro-batch: step(model, batch, number) gives the next one. Every version is written
    under its batch's id before the batch counts as done, and a batch starts from the version before it; so a batch that
    comes again after a failure is learned from once. The model is a list of numbers, kept as a small table."""

    def __init__(self, spark: SparkSession, path: str, start: list[float], step: Callable[[list[float], DataFrame, int], list[float]]):
        self.spark, self.path, self.step = spark, path, step
        self._save(-1, start)

    def _save(self, number: int, model: list[float]) -> None:
        rows = self.spark.createDataFrame([(i, float(v)) for i, v in enumerate(model)], "place int, value double")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model-{number}")

    def load(self, number: int) -> list[float]:
        return [r["value"] for r in self.spark.read.parquet(f"{self.path}/model-{number}").orderBy("place").collect()]

    def run(self, stream: DataFrame) -> list[float]:
        """The model after all batches that are there."""
        last = -1

        def fold(batch: DataFrame, number: int) -> None:
            nonlocal last
            self._save(number, self.step(self.load(number - 1), batch, number))
            last = number

        StreamingPass(stream, fold, f"{self.path}/checkpoint").finish()
        return self.load(last)

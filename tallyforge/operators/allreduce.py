"""Model exchange as aggregation: messages (round, chunk, worker, value) reduced by round and chunk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ordering import row_numbers, running_max


def current(messages: DataFrame, lag: int) -> DataFrame:
    """Messages that are not outdated: at most `lag` rounds behind the newest one that arrived before or with them."""
    return running_max(messages, ("arrival",), "round", "__newest").where(F.col("round") >= F.col("__newest") - lag).drop("__newest")


def reduced(messages: DataFrame, workers: int, threshold: float = 1.0, kind: str | Callable[[Column], Column] = "average") -> DataFrame:
    """(round, chunk, value, n) of chunks that reached their threshold of distinct workers. The average is by the number
    of workers that did contribute; a reducer of one's own is any aggregate of the value."""
    one = messages.groupBy("round", "chunk", "worker").agg(F.first("value").alias("value"))
    reduce = kind if callable(kind) else F.sum
    r = one.groupBy("round", "chunk").agg(reduce(F.col("value")).alias("s"), F.count("*").alias("n")).where(F.col("n") >= max(1, int(threshold * workers)))
    return r.select("round", "chunk", (F.col("s") / F.col("n") if kind == "average" else F.col("s")).alias("value"), "n")


def filled(result: DataFrame, backup: DataFrame) -> DataFrame:
    """A value for every (round, chunk) of the local backup: the reduced one, else the backup's own."""
    b = backup.select("round", "chunk", F.col("value").alias("__own"))
    return b.join(result, ["round", "chunk"], "left").select("round", "chunk", F.coalesce("value", "__own").alias("value"), F.col("value").isNotNull().alias("reduced"))


def blended(model: DataFrame, average: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """(1 - alpha) m + alpha average; a model value without an average stays."""
    a = average.select(*keys, F.col("value").alias("__avg"))
    return model.join(a, keys, "left").withColumn("value", F.when(F.col("__avg").isNull(), F.col("value")).otherwise((1 - alpha) * F.col("value") + alpha * F.col("__avg"))).drop("__avg")


def scattered(messages: DataFrame, workers: int, reduce_at: float, kind: str = "average") -> DataFrame:
    """(round, chunk, value, n): the first messages of each chunk, in order of arrival and one a worker, up to the number that
    a chunk waits for; later ones are left out, as the chunk is sent on without them."""
    need = max(1, int(reduce_at * workers))
    first = messages.groupBy("round", "chunk", "worker").agg(F.min_by("value", "arrival").alias("value"), F.min("arrival").alias("arrival"))
    order = Window.partitionBy("round", "chunk").orderBy("arrival")  # at most a row a worker
    in_time = first.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= need)
    r = in_time.groupBy("round", "chunk").agg(F.sum("value").alias("s"), F.count("*").alias("n"), F.max("arrival").alias("done")).where(F.col("n") >= need)
    return r.select("round", "chunk", (F.col("s") / F.col("n") if kind == "average" else F.col("s")).alias("value"), "n", "done")


def completed_rounds(reduced: DataFrame, chunks: int, complete_at: float) -> DataFrame:
    """(round, chunks, done): rounds that reached their threshold of reduced chunks, and the arrival that completed them."""
    need = max(1, int(complete_at * chunks))
    order = Window.partitionBy("round").orderBy("done", "chunk")  # at most a row a chunk
    placed = reduced.withColumn("__k", F.row_number().over(order))
    return placed.groupBy("round").agg(F.count("*").alias("chunks"), F.max(F.when(F.col("__k") == need, F.col("done"))).alias("done")).where(F.col("chunks") >= need)


def line_masters(rounds: DataFrame, lines: int, advance_at: float) -> DataFrame:
    """(round, lines, done): rounds (line, round, done) that enough lines of workers have completed, so that the master lets
    the next one begin."""
    need = max(1, int(advance_at * lines))
    order = Window.partitionBy("round").orderBy("done", "line")  # at most a row a line
    placed = rounds.withColumn("__k", F.row_number().over(order))
    return placed.groupBy("round").agg(F.count("*").alias("lines"), F.max(F.when(F.col("__k") == need, F.col("done"))).alias("done")).where(F.col("lines") >= need)


def grid_places(nodes: DataFrame, node: str = "node") -> DataFrame:
    """Row and column of each node in the smallest square grid that holds all, filled by node order."""
    n = nodes.agg(F.ceil(F.sqrt(F.count("*"))).alias("side"))
    placed = row_numbers(nodes, (node,), "place")
    return placed.crossJoin(F.broadcast(n)).select(node, F.floor(F.col("place") / F.col("side")).alias("grid_row"), F.pmod(F.col("place"), F.col("side")).alias("grid_col"))


def replica_rounds(data: DataFrame, replica: Column, batch: Column, rounds: int, start: float, slope: Callable[[float], Column], rate: float) -> float:
    """A weight after rounds in which every replica steps along the mean slope of its own samples of that round's batch
    and all replicas then take their average. One aggregate a round; the driver holds a row a replica."""
    w, marked = start, data.withColumn("__r", replica).withColumn("__b", batch)
    for n in range(rounds):
        steps = marked.where(F.col("__b") == n).groupBy("__r").agg(F.avg(slope(w)).alias("g"))
        w = steps.agg(F.avg(F.lit(w) + rate * F.col("g"))).first()[0]
    return w

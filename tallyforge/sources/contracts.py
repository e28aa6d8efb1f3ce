"""What a source, a sink and an update rule of one's own have to provide, and plain ones over tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.transform import batches
from tallyforge.scratch import kept


class Source:
    """Minibatches of a table in an order. Subclasses may override `prepared`, which turns the table into what batches are
    cut from. A batch is a DataFrame, never rows on the driver; numbering is done once, when the first batch is asked for."""

    def __init__(self, data: DataFrame, order: tuple[str, ...], size: int):
        self.data, self.order, self.size = data, order, size
        self.place, self._numbered, self._count, self._back = 0, None, 0, []

    def prepared(self, data: DataFrame) -> DataFrame:
        return data

    def start(self) -> Source:
        self._numbered = kept(batches(self.prepared(self.data), self.order, self.size), "source")
        self._count = (self._numbered.agg(F.max("batch_id")).first()[0] or 0) + 1 if self._numbered.limit(1).count() else 0
        self.place, self._back = 0, []
        return self

    def has_next(self) -> bool:
        return bool(self._back) or self.place < self._count

    def next(self) -> DataFrame:
        if self._back:
            return self._back.pop()
        self.place += 1
        return self._numbered.where(F.col("batch_id") == self.place - 1).drop("batch_id")

    def rest(self) -> DataFrame:
        """The rows of all batches that next would still give, with their turn from 0. What is done with each batch alike is
        one job by turn, however many there are."""
        back, left = self._back[::-1], self._numbered.where(F.col("batch_id") >= self.place)
        out = left.withColumn("turn", F.col("batch_id") - self.place + len(back)).drop("batch_id")
        for turn, batch in enumerate(back):
            out = out.unionByName(batch.withColumn("turn", F.lit(turn).cast("long")))
        self.place, self._back = self._count, []
        return out

    def put_back(self, batch: DataFrame) -> None:
        """The batch comes again before any other."""
        self._back.append(batch)

    def progress(self) -> float:
        return self.place / self._count if self._count else 1.0

    def __iter__(self) -> Iterator[DataFrame]:
        self.start()
        while self.has_next():
            yield self.next()


class Sink:
    """Takes result batches and gives them as one table; subclasses may override `stored`."""

    def __init__(self):
        self.parts: list[DataFrame] = []

    def stored(self, batch: DataFrame) -> DataFrame:
        return kept(batch, "sink")

    def put(self, batch: DataFrame) -> None:
        self.parts.append(self.stored(batch))

    def table(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out


class UpdateRule:
    """A fold over gradients: `start` gives a weight's state columns, `step` the new weight and states."""

    states: tuple[str, ...] = ()

    def start(self, model: DataFrame) -> DataFrame:
        return model.withColumns({s: F.lit(0.0) for s in self.states})

    def step(self, w, g, states: dict, number: int):
        raise NotImplementedError

    def apply(self, model: DataFrame, gradients: DataFrame, number: int) -> DataFrame:
        """model (key, w, states) after a step with gradients (key, g)."""
        j = model.join(gradients, "key", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
        w, states = self.step(F.col("w"), F.col("g"), {s: F.col(s) for s in self.states}, number)
        return j.select("key", w.alias("w"), *[states[s].alias(s) for s in self.states])


class MomentumRule(UpdateRule):
    states = ("v",)

    def __init__(self, rate: float, decay: float):
        self.rate, self.decay = rate, decay

    def step(self, w, g, states, number):
        v = self.decay * states["v"] + self.rate * g
        return w + v, {"v": v}

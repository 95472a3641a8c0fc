"""Ordered logs as streams: edge state, answers, and schedules, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import fleet, updates
from ..plans import events as plan


class EdgeState:
    """The edges after all updates so far: ``base`` and, in folders ``path``/v1, v2 ..., the states of changed edges.

    The last two versions are kept. States merge by seq, so an update that comes late counts
    unless a later one has set the same, and a batch that comes again changes nothing.
    """

    def __init__(self, base: DataFrame, path: str):
        self.base, self.spark, self.path = base, base.sparkSession, path.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that are there in full, in order."""
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path())]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self._path(f"{n}/_SUCCESS")))

    def states(self, version: int | None = None) -> DataFrame | None:
        known = self.versions()
        at = version if version in known else max(known, default=None)
        return None if at is None or version == 0 else self.spark.read.parquet(f"{self.path}/v{at}")

    def edges(self, version: int | None = None) -> DataFrame:
        """The edges as a version (the last if not given; 0 before all updates) has them."""
        states = self.states(version)
        if states is None:
            return self.base if "active" in self.base.columns else self.base.withColumn("active", F.lit(True))
        return updates.with_states(self.base, states)

    def fold(self, batch: DataFrame, version: int | None = None) -> None:
        """Take in a batch of updates on top of ``version`` (the last if not given)."""
        old, at = self.states(version), max(self.versions(), default=0) if version is None else version
        new = updates.latest(batch)
        both = new if old is None else updates.merged(old.unionByName(new, allowMissingColumns=True))
        both.write.mode("overwrite").parquet(f"{self.path}/v{at + 1}")
        self._fs().delete(self._path(f"v{at - 1}"), True)


def stream_edge_changes(stream: DataFrame, path: str) -> DataStreamWriter:
    """Fold a stream of updates (seq, id, type, edge_id, patch columns) into one state for each edge, kept by Spark.

    The updates may come in any order: a state merges by seq. Each batch writes the states of the
    edges it changed to ``path``/batch=n, once however often it is run; ``edges_of_changes`` reads them.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.latest(stream).writeStream.outputMode("update").foreachBatch(each)


def edges_of_changes(base: DataFrame, path: str) -> DataFrame:
    """``base`` after the changes that ``stream_edge_changes`` wrote to ``path``."""
    return updates.with_states(base, updates.merged(base.sparkSession.read.parquet(path).drop("batch")))


def stream_edge_state(stream: DataFrame, base: DataFrame, path: str) -> DataStreamWriter:
    """Fold a stream of updates (seq, id, type, edge_id, patch columns) into the edges at ``path``."""

    def each(batch: DataFrame, number: int) -> None:
        EdgeState(base, path).fold(batch, number)

    return stream.writeStream.foreachBatch(each)


def stream_answers(stream: DataFrame, nodes: DataFrame, base: DataFrame, path: str, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Answer a stream of mixed events; ``sink`` gets each batch's answers.

    A batch sees the edges as earlier batches left them, and its own updates by
    their place in the log; an event that comes late is answered with its batch. A batch
    that is run again after a failure finds the edges of before it and
    gets the same answers, so a sink that keeps one answer for each seq has each once.
    """

    def each(batch: DataFrame, number: int) -> None:
        state = EdgeState(base, path)
        batch = batch.persist()
        sink(plan.answer_events(nodes, state.edges(number), batch), number)
        state.fold(plan.patches(plan.classified(batch).filter("error is null")), number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each)


def stream_schedules(stream: DataFrame, nodes: DataFrame, adj: DataFrame, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Schedule requests again whenever rows of them arrive: the newest by seq of all batches counts, kept by Spark for each id."""

    def each(batch: DataFrame, number: int) -> None:
        sink(fleet.schedule_deliveries(nodes, adj, fleet.normalize_fleet(batch.select("r.*"))), number)

    last = stream.groupBy("id").agg(F.max_by(F.struct(*stream.columns), "seq").alias("r"))
    return last.writeStream.outputMode("update").foreachBatch(each)

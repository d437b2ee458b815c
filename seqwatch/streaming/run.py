"""Starting, finishing and watching a query (SNK-1, SNK-2, SNK-6, STR-4, STR-6 to STR-8)."""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, replace
from datetime import timedelta
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from seqwatch import names
from seqwatch.sinks import tables


@dataclass(frozen=True)
class RunReport:
    """Counts over the micro-batches of one run; ``complete`` is false if some were missed."""

    input_rows: int = 0
    dropped_by_watermark: int = 0
    invalid: int = 0
    complete: bool = True


class Counts(StreamingQueryListener):
    """Adds up the micro-batches of every run of a session, as Spark reports them.

    Each batch is told once, so none is lost between two looks at a query. Should Spark's event
    queue overflow and a batch's number be missing, the report says that it is not complete.
    """

    def __init__(self) -> None:
        self._lock = threading.Condition()
        self._reports: dict[str, RunReport] = {}
        self._batch: dict[str, int] = {}
        self._ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._reports.setdefault(str(event.runId), RunReport())

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        run, batch = str(progress.runId), progress.batchId
        decode, late = (progress.observedMetrics.get(name) for name in ("decode", "late"))
        dropped = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        with self._lock:
            before = self._reports.get(run, RunReport())
            last = self._batch.get(run, batch)  # an idle query tells the same number again
            self._batch[run] = batch
            self._reports[run] = RunReport(
                before.input_rows + progress.numInputRows,
                before.dropped_by_watermark + dropped + ((late.missed or 0) if late else 0),
                before.invalid + ((decode.invalid or 0) if decode else 0),
                before.complete and batch <= last + 1,
            )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended.add(str(event.runId))
            self._lock.notify_all()

    def so_far(self, run: str) -> RunReport:
        """What has been told of a run up to now."""
        with self._lock:
            return self._reports.get(run, RunReport())

    def of_ended(self, run: str, seconds: float) -> RunReport:
        """The report of a run that has ended: waits for its last event, and forgets the run."""
        with self._lock:
            told = self._lock.wait_for(lambda: run in self._ended, seconds)
            report = self._reports.pop(run, RunReport())
            self._batch.pop(run, None)
            self._ended.discard(run)
        return report if told else replace(report, complete=False)


#: How long the events of an ended query may take to arrive.
EVENTS_SECONDS = 60.0

_COUNTS: WeakKeyDictionary[SparkSession, Counts] = WeakKeyDictionary()


def counts(spark: SparkSession) -> Counts:
    """The session's listener, added to it with its first query."""
    if spark not in _COUNTS:
        found = Counts()
        spark.streams.addListener(found)
        _COUNTS[spark] = found
    return _COUNTS[spark]


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_settings(spark: SparkSession, partitions: int | None):
    """A new query takes its number of state partitions and its state store from the session, once.

    State with timers is kept by RocksDB only.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def start(
    df: DataFrame,
    checkpoint: str,
    *,
    format: str | None = None,
    write_batch: Callable[[DataFrame, int], None] | None = None,
    options: Mapping[str, str] | None = None,
    path: str | None = None,
    partition_by: list[str] | None = None,
    every: timedelta | None = None,
    finish: bool = False,
    state_partitions: int | None = None,
    query_name: str | None = None,
) -> StreamingQuery:
    """Start an append query with its own ``checkpoint`` folder.

    ``finish`` processes what is there and ends; ``every`` sets a fixed interval;
    otherwise batches follow each other as fast as they can. ``write_batch`` takes the place of
    a ``format``: it gets each batch and its number, which is the same if the batch is repeated.
    """
    writer = df.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(write_batch) if write_batch else writer.format(format)
    writer = writer.options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if query_name:
        writer = writer.queryName(query_name)
    if finish:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=f"{every.total_seconds()} seconds")
    counts(df.sparkSession)
    with _state_settings(df.sparkSession, state_partitions):
        return writer.start(path) if path else writer.start()


def to_kafka(messages: DataFrame, checkpoint: str, options: Mapping[str, str], **kw):
    """Messages (``value``, perhaps ``key``) to a topic; options as in ``kafka.sink_options``."""
    return start(messages, checkpoint, format="kafka", options=options, **kw)


def to_archive(points: DataFrame, path: str, checkpoint: str, **kw) -> StreamingQuery:
    """Points to the partitioned archive, flushed every ten seconds unless told otherwise.

    Each batch has a folder of its own, which a repeated batch replaces, so a point is there
    once. Its small partitions are gathered into one file each.
    """
    if not kw.get("finish"):
        kw.setdefault("every", names.ARCHIVE_FLUSH)
    return start(points, checkpoint, write_batch=lambda batch, n: tables.write_batch(batch, path, n), **kw)


Part = Callable[[DataFrame], DataFrame]
Target = str | Callable[[DataFrame, int], None]


def to_parts(
    df: DataFrame, parts: Mapping[str, tuple[Target, Part]], checkpoint: str, **kw
) -> StreamingQuery:
    """One query with several sinks: of every batch, each part goes to its own target.

    ``parts`` are a target and a function of the batch by name. The batch is computed once. A
    target is a folder, where a repeated batch replaces what it wrote before, or a function of
    the rows and the batch's number.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for target, part in parts.values():
                if callable(target):
                    target(part(batch), number)
                else:
                    part(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        finally:
            batch.unpersist()

    return start(df, checkpoint, write_batch=write, **kw)


def kafka_target(options: Mapping[str, str]) -> Target:
    """For ``to_parts``: messages to a topic. A repeated batch is sent again, as by any Kafka sink."""
    return lambda rows, _number: rows.write.format("kafka").options(**options).save()


def finished(query: StreamingQuery, spark: SparkSession | None = None) -> RunReport:
    """Wait for a query that ends by itself, or has been stopped, and tell its counts."""
    query.awaitTermination()
    spark = spark or SparkSession.getActiveSession()
    return counts(spark).of_ended(str(query.runId), EVENTS_SECONDS)


def so_far(query: StreamingQuery, spark: SparkSession | None = None) -> RunReport:
    """The counts of a running query up to its last reported batch."""
    return counts(spark or SparkSession.getActiveSession()).so_far(str(query.runId))


def run_to_end(df: DataFrame, path: str, checkpoint: str, **kw) -> RunReport:
    """Process the available input into Parquet files at ``path`` and wait."""
    query = start(df, checkpoint, format="parquet", path=path, finish=True, **kw)
    return finished(query, df.sparkSession)


def wait(query: StreamingQuery, timeout: float | None = None) -> bool:
    """Wait for the query and tell whether it has ended; an interrupt stops it cleanly."""
    try:
        query.awaitTermination(timeout)
    except KeyboardInterrupt:
        query.stop()
    return not query.isActive

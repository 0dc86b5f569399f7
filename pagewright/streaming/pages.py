"""Which pages of each document are held, as pages are cached and views move on: state that a stream keeps, and the same over a table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HELD = "doc long, pages array<int>"


class HeldPages(StatefulProcessor):
    """State of one document: its cached pages. A view drops those outside its range; idle documents drop all."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # A batch's rows of a document come in no order.
        for row in sorted(rows, key=lambda r: r.seq):
            if row.page is not None:
                self.pages.updateValue((row.page,), (row.seq,))
            elif row.first is not None:
                for (page,) in list(self.pages.keys()):
                    if not row.first <= page < row.past:
                        self.pages.removeKey((page,))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._told(key)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.pages.clear()
        yield self._told(key)

    def _told(self, key: tuple) -> Row:
        return Row(doc=key[0], pages=sorted(p for (p,) in self.pages.keys()))

    def close(self) -> None:
        pass


def held_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(doc, pages) of each document with events in a batch: the pages held after them, in order.

    ``events`` (doc, seq, page: cached now, or first, past: the view's pages from here on) stream in; seq orders a document's
    events. The state lives in the checkpoint of the query, which needs the RocksDB state store. With ``idle_ms`` a document without events for so long drops all.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    mode = "ProcessingTime" if idle_ms is not None else "None"
    plain = events.select(F.col("doc").cast("long"), F.col("seq").cast("long"), F.col("page").cast("int"), F.col("first").cast("int"), F.col("past").cast("int"))
    return plain.groupBy("doc").transformWithState(HeldPages(idle_ms), HELD, "Update", mode)


def held(events: DataFrame) -> DataFrame:
    """(doc, page) held after all ``events``, as ``held_stream`` has it.

    A page is held if every view since it was cached last has it: the least past and greatest first of a document's views
    from each event on are running values, so no view meets a page.
    """
    later = Window.partitionBy("doc").orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    bounds = events.withColumns({"_from": F.max("first").over(later), "_to": F.min("past").over(later)}).where("page IS NOT NULL")
    last = bounds.groupBy("doc", "page").agg(F.max_by(F.struct("_from", "_to"), "seq").alias("v"))
    inside = (F.col("v._from").isNull() | (F.col("page") >= F.col("v._from"))) & (F.col("v._to").isNull() | (F.col("page") < F.col("v._to")))
    return last.where(inside).select("doc", "page")

"""Structured Streaming forms of alert ingestion and velocity.

Velocity comes in two forms. ``velocity_stream`` keeps history as a table in folders a day, of which a batch reads the days
that its windows reach. ``velocity_state`` keeps each card's recent times in the state store: rows wait there until the
watermark has passed them and leave in event-time order, so that rows which come out of order within the delay count
as in a batch; rows behind the watermark are marked and go to a table of their own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators.card import WINDOWS, velocity_incremental
from tidemark.operators.ledger import reject_reason
from tidemark.settings import DAY_US


def valid_alerts(alerts: DataFrame, delay: str = "1 day", ts: str = "event_time") -> DataFrame:
    """Valid alerts of a stream, one a (organisation, transaction) within the watermark; ``ts`` has a time zone."""
    ok = alerts.where(reject_reason().isNull())
    return ok.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["organization_id", "trans_num"])


def rejected_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("reason", reject_reason()).where("reason is not null")


def _other_batches(batch: DataFrame, path: str, number: int) -> DataFrame:
    """What batches of other numbers have written to ``path``; without a table yet, no rows."""
    try:
        return batch.sparkSession.read.parquet(path).where(F.col("batch") != number)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return batch.limit(0)


def ingest_stream(alerts: DataFrame, cases_path: str, checkpoint: str, delay: str = "1 day", ts: str = "event_time") -> StreamingQuery:
    """Appends the stream's valid alerts to the case table at ``cases_path`` unless their case is there already.

    A batch is written under its own number and replaces what an earlier try of it wrote: running twice is harmless.
    """

    def save(batch: DataFrame, number: int) -> None:
        known = _other_batches(batch, cases_path, number).select("organization_id", "trans_num")
        batch = batch.join(known, ["organization_id", "trans_num"], "left_anti")
        batch.write.mode("overwrite").parquet(f"{cases_path}/batch={number}")

    return valid_alerts(alerts, delay, ts).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def velocity_stream(events: DataFrame, history_path: str, checkpoint: str, key: str = "cc_num", ts: str = "ts") -> StreamingQuery:
    """Velocity of each micro-batch with look-back into what earlier batches appended to ``history_path``.

    History lies in folders ``day``/``batch``; a batch reads the days that its windows reach, and writes its own folders
    again if it is tried again. Rows that come after later rows of their card were counted are not counted there.
    """

    def save(batch: DataFrame, number: int) -> None:
        past = _other_batches(batch.withColumns({"day": F.to_date(ts), "batch": F.lit(number)}), history_path, number).select(*batch.columns, "day")
        out = velocity_incremental(past, batch, key, ts).withColumns({"day": F.to_date(ts), "batch": F.lit(number)})
        out.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(history_path)

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Velocity(StatefulProcessor):
    """Of a card: rows that wait for the watermark, and the times of released rows that a window may still reach."""

    def __init__(self, windows: dict[str, int], ident: str):
        self.windows = {n: d * DAY_US for n, d in windows.items()}
        self.longest = max(self.windows.values())
        self.ident = ident
        self.row = Row("key", "ident", "us", *windows, "late")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us long, ident {self.ident}")
        self.recent = handle.getListState("recent", "us long")

    def _row(self, key: tuple, us: int, ident, counts: dict[str, int] | None) -> Row:
        return self.row(key[0], ident, us, *[(counts or {}).get(n) for n in self.windows], counts is None)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        new = []
        for r in rows:
            if mark > 0 and r.us // 1000 < mark:
                yield self._row(key, r.us, r.ident, None)
            else:
                new.append((r.us, r.ident))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0] // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """Releases what the watermark has passed, sets the next timer, and forgets a card that no window reaches."""
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(((r[0], r[1]) for r in self.waiting.get()), key=lambda r: r[0]) if self.waiting.exists() else []
        due = waiting[: bisect_left(waiting, mark, key=lambda r: r[0])]
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        times = sorted(recent + [us for us, _ in due])
        for us, ident in due:
            at = bisect_left(times, us)
            yield self._row(key, us, ident, {n: at - bisect_left(times, us - w) for n, w in self.windows.items()})
        left, kept = waiting[len(due) :], times[bisect_left(times, mark - self.longest) :]
        for state, values in ((self.waiting, left), (self.recent, [(t,) for t in kept])):
            state.put(values) if values else state.clear()
        if left:
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        elif kept:
            self.handle.registerTimer((kept[-1] + self.longest) // 1000 + 1)

    def close(self) -> None:
        pass


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose state store can hold lists and timers."""
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for c in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        s.conf.set(c, spark.conf.get(c))
    return s


def velocity_state(events: DataFrame, key: str = "cc_num", ts: str = "ts", ident: str = "trans_num", windows: dict[str, int] | None = None, delay: str = "1 hour") -> DataFrame:
    """(key, ident, ts, counts, late) of a stream in a ``state_session``, whose ``ts`` has a time zone.

    Counts are those of a batch over all rows that weren't late; late rows have none. A row stands twice on its way: one
    entry has its time, moves the watermark and ends there; the other has none, so it is never dropped as late, and goes to the card.
    A card's rows of the longest window are its state; a timer clears it when no window reaches them any more.
    """
    windows = windows or WINDOWS
    kind, of = events.schema[ident].dataType.simpleString(), events.schema[key].dataType.simpleString()
    both = F.explode(F.array(F.col(ts), F.lit(None).cast("timestamp"))).alias("mark")
    entries = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ident).alias("ident"), F.unix_micros(ts).alias("us"), both).withWatermark("mark", delay).where("mark is null")
    schema = f"key {of}, ident {kind}, us long, " + ", ".join(f"{n} int" for n in windows) + ", late boolean"
    out = entries.groupBy("key").transformWithState(_Velocity(windows, kind), schema, "append", "eventTime")
    return out.select(F.col("key").alias(key), F.col("ident").alias(ident), F.timestamp_micros("us").alias(ts), *windows, "late")


def velocity_state_stream(events: DataFrame, path: str, late_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends counted rows to ``path`` and late ones to ``late_path``, in a folder a batch that a retry replaces."""

    def save(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        held.where("not late").drop("late").write.mode("overwrite").parquet(f"{path}/batch={number}")
        held.where("late").drop("late").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        held.unpersist()

    return velocity_state(events, **options).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

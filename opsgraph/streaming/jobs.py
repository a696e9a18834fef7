"""Structured Streaming jobs over the same operators.

Time policy: interval joins, windows and dirty sets have a watermark of ten minutes on event time. State per uid or alert
is kept for a number of days of event time, which is its watermark: it is dropped when nothing came for so long, and events
later than that are left out. Keyed writes take events however late they are.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opsgraph.operators.logs import aggressive_mask, folded, preprocess, template_id
from opsgraph.plans.causality import HEURISTICS, MAX_LAG_MS, MS_NS, holds, may
from opsgraph.plans.incremental import GraphTables

LATE = "10 minutes"


def start(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = True, every: str = "60 seconds", mode: str = "append") -> StreamingQuery:
    """A query that hands each batch to `each`: over all there is now, or for ever. Nothing is dropped when batches fall behind."""
    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def keyed_writer(path: str, build: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A batch writer: each table of build(batch) goes to path/table/batch=N, so that a batch done again overwrites itself."""

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            for name, table in build(batch).items():
                table.write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")
        finally:
            batch.unpersist()

    return write


def graph_updater(tables: GraphTables) -> Callable[[DataFrame, int], None]:
    """A batch writer that merges each batch of flat events into the stored graph; a batch done again changes nothing."""
    return lambda batch, n: tables.apply(batch, n)


def log_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Log lines of a batch as JSON lines."""
    return lambda batch, n: batch.write.mode("overwrite").json(f"{path}/batch={n}")


def with_time(events: DataFrame, column: str = "ts_ns", late: str = LATE) -> DataFrame:
    """events with the timestamp ts, and the watermark on it."""
    return events.withColumn("ts", F.timestamp_micros(F.floor(F.col(column) / 1000))).withWatermark("ts", late)


def _seconds(spark: SparkSession, span: str) -> int:
    """The length of an interval like `10 minutes`."""
    return int(spark.range(1).select(F.expr(f"unix_seconds(timestamp'1970-01-01T00:00:00Z' + interval {span})")).first()[0])


def without_late(path: str, late: str = LATE) -> Callable[[DataFrame, int], None]:
    """A batch writer that parts flat events into path/events and path/late_events, where no stateful job would take them any more.

    Late is what came more than `late` behind the newest event of all batches before; path/newest keeps that for each
    batch, so a batch done again is parted in the same way. A job that reads path/events as a stream and has a watermark
    of `late` loses nothing: its watermark follows the same events in the same order.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        newest = "n long, newest_ns long"
        spark.createDataFrame([], newest).write.mode("ignore").parquet(f"{path}/newest")
        before = spark.read.schema(newest).option("recursiveFileLookup", "true").parquet(f"{path}/newest").filter(F.col("n") < n).agg(F.max("newest_ns")).first()[0]
        batch = batch.persist()
        try:
            behind = F.lit(False) if before is None else F.col("ts_ns") < before - _seconds(spark, late) * 1_000_000_000
            batch.filter(behind).write.mode("overwrite").parquet(f"{path}/late_events/batch={n}")
            batch.filter(~behind).write.mode("overwrite").parquet(f"{path}/events/batch={n}")
            batch.agg(F.lit(n).cast("long").alias("n"), F.max("ts_ns").alias("newest_ns")).write.mode("overwrite").parquet(f"{path}/newest/batch={n}")
        finally:
            batch.unpersist()

    return write


def triggered_by(events: DataFrame, heuristics: list[tuple] = HEURISTICS, max_lag_ms: int = MAX_LAG_MS, least: float = 0.5, late: str = LATE) -> DataFrame:
    """(src effect, dst cause, confidence, lag_ms, reason) of a stream of flat events, across its batches: infer_causality as interval joins.

    Pairs of one namespace come from one join, which asks all heuristics in order; pairs of a resource with itself, of nodes
    and of namespaces with what is in them come from one each, if they cross namespaces. So no pair comes twice. Each side
    is kept for the largest lag beyond the watermark.
    """
    width = max_lag_ms * MS_NS
    rows = with_time(events.select("id", "uid", "kind", "type", "namespace", "name", "ts_ns"), late=late)
    lag_ns = F.col("e.ts_ns") - F.col("c.ts_ns")
    lag_ms = F.floor(lag_ns / MS_NS)
    inside = (F.col("e.ts") >= F.col("c.ts")) & (F.col("e.ts") <= F.col("c.ts") + F.expr(f"interval {max_lag_ms + 1} milliseconds"))
    other = F.col("c.namespace") != F.col("e.namespace")

    def joined(c: DataFrame, e: DataFrame, on: Column, rules: list[tuple], also: Column = F.lit(True)) -> DataFrame:  # noqa: B008
        first = F.lit(None).cast("int")
        for rule in reversed(rules):
            first = F.when(holds(rule, lag_ms), F.lit(heuristics.index(rule))).otherwise(first)
        met = c.filter(may(rules, 1)).alias("c").join(e.filter(may(rules, 3)).alias("e"), on & inside).filter((lag_ns > 0) & (lag_ns <= width) & also)
        return met.select(F.col("e.id").alias("src"), F.col("c.id").alias("dst"), lag_ms.alias("lag_ms"), first.alias("rule")).filter("rule is not null")

    node = [r for r in heuristics if r[5] is False]
    cascade = [r for r in heuristics if r[0] == "namespace-cascade-delete"]
    own = [r for r in heuristics if r[0] == "same-resource-transition"]
    parts = [joined(rows, rows, F.col("c.namespace") == F.col("e.namespace"), heuristics)]
    if own:
        parts.append(joined(rows, rows, F.col("c.uid") == F.col("e.uid"), own, other))
    if node:
        # Nodes and evictions have no key in common but the time: an effect meets causes of its own slot and the one before.
        slotted = rows.withColumn("slot", F.floor(F.col("ts_ns") / width))
        parts.append(joined(slotted.withColumn("slot", F.explode(F.array("slot", F.col("slot") + 1))), slotted, F.col("c.slot") == F.col("e.slot"), node, other))
    if cascade:
        parts.append(joined(rows, rows, F.col("c.name") == F.col("e.namespace"), cascade, other))
    found = reduce(DataFrame.union, parts)
    name = F.element_at(F.array(*[F.lit(r[0]) for r in heuristics]), F.col("rule") + 1)
    confidence = F.element_at(F.array(*[F.lit(r[8]) for r in heuristics]), F.col("rule") + 1)
    return found.select("src", "dst", confidence.alias("confidence"), "lag_ms", name.alias("reason")).filter(F.col("confidence") >= least)


DAY_MS = 86_400_000


def _keep(state: GroupState, value: tuple, last_ns: int, keep_days: int) -> None:
    """Updates a state and lets it go when keep_days have passed since its last event."""
    state.update(value)
    state.setTimeoutTimestamp(max(int(last_ns) // 1_000_000, state.getCurrentWatermarkMs()) + keep_days * DAY_MS + 1)


def _changes(keep_days: int) -> Callable[..., Iterator[pd.DataFrame]]:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts_ns", "id"])
        out = []
        for r in rows.itertuples():
            out.append((r.uid, r.id, r.ts_ns, old is not None and r.type == "UPDATE" and r.data != old, old is None))
            if r.type in ("CREATE", "UPDATE"):
                old = r.data
        if old is not None:
            _keep(state, (old,), rows["ts_ns"].max(), keep_days)
        yield pd.DataFrame(out, columns=["uid", "id", "ts_ns", "changed", "first"])

    return run


def detect_changes(events: DataFrame, keep_days: int = 30) -> DataFrame:
    """Does an event's data differ from the resource's snapshot before? The snapshot is the state of its uid, for keep_days."""
    rows = with_time(events.select("uid", "id", "ts_ns", "type", "data"), late=f"{keep_days} days")
    return rows.groupBy("uid").applyInPandasWithState(_changes(keep_days), "uid string, id string, ts_ns long, changed boolean, first boolean", "data string", "append", GroupStateTimeout.EventTimeTimeout)


def _transitions(keep_days: int) -> Callable[..., Iterator[pd.DataFrame]]:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # what the alert was is unknown by now
            state.remove()
            return
        known: tuple[Any, Any] = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts_ns", "seq"]).itertuples():
            before = known[0] if known[0] is not None and r.ts_ns - known[1] <= keep_days * DAY_MS * 1_000_000 else "unknown"
            if before != r.state:
                out.append((r.alert, before, r.state, r.ts_ns, r.seq))
            known = (r.state, r.ts_ns)
        _keep(state, known, known[1], keep_days)
        yield pd.DataFrame(out, columns=["alert", "from_state", "to_state", "ts_ns", "seq"])

    return run


def alert_transitions(states: DataFrame, keep_days: int = 7) -> DataFrame:
    """Changes of alert states (alert, state, ts_ns, seq); a state is known for keep_days."""
    rows = with_time(states.select("alert", "state", "ts_ns", "seq"), late=f"{keep_days} days")
    return rows.groupBy("alert").applyInPandasWithState(_transitions(keep_days), "alert string, from_state string, to_state string, ts_ns long, seq long", "state string, ts_ns long", "append", GroupStateTimeout.EventTimeTimeout)


def template_counts(logs: DataFrame) -> DataFrame:
    """Running counts of masked patterns; write in update mode."""
    pattern = folded(aggressive_mask(preprocess(F.col("message"))))
    rows = logs.withColumn("pattern", pattern).filter("pattern != ''")
    return rows.groupBy("namespace", template_id(F.col("namespace"), F.col("pattern")).alias("id"), "pattern").count()


def dirty_namespaces(events: DataFrame, quiet: str = "5 seconds", late: str = LATE) -> DataFrame:
    """Each namespace with events (first, last, n), given out once when `quiet` has passed without another one in it."""
    rows = with_time(events, late=late).groupBy(F.session_window("ts", quiet).alias("w"), "namespace")
    return rows.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).select("namespace", "first", "last", "n")


def log_histogram(logs: DataFrame, step: str = "1 minute") -> DataFrame:
    """Lines per step of event time."""
    return with_time(logs).groupBy(F.window("ts", step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def statistics(query: StreamingQuery) -> dict[str, float]:
    """Batches, rows and the last batch's seconds of a query."""
    done = query.recentProgress
    return {"batches": len(done), "rows": sum(p["numInputRows"] for p in done), "last_s": (done[-1]["durationMs"].get("triggerExecution", 0) / 1000) if done else 0.0}


class PipelineStatistics(StreamingQueryListener):
    """Counts over all queries of a session, by name: batches, rows, errors, the newest event time seen and how far the clock is ahead of it.

    Add it with spark.streams.addListener. lag_ms is of the last batch that had events with a time; None before.
    """

    def __init__(self) -> None:
        self.of: dict[str, dict[str, Any]] = {}
        self._names: dict[str, str] = {}

    def _row(self, run: Any) -> dict[str, Any]:
        return self.of.setdefault(self._names.get(str(run), str(run)), {"batches": 0, "rows": 0, "errors": 0, "last_event": None, "lag_ms": None})

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        self._names[str(event.runId)] = event.name or str(event.id)
        self._row(event.runId)

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        p, row = event.progress, self._row(event.progress.runId)
        row["batches"] += 1
        row["rows"] += p.numInputRows
        newest = (p.eventTime or {}).get("max")
        if newest:
            row["last_event"] = newest
            at = lambda t: datetime.datetime.fromisoformat(t.replace("Z", "+00:00"))
            row["lag_ms"] = int((at(p.timestamp) - at(newest)).total_seconds() * 1000)

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        if event.exception:
            self._row(event.runId)["errors"] += 1

"""Timelines of resources: segments, transitions, as-of states, pages, health.

Events are flat rows: id, uid, kind, namespace, name, type, ts_ns, status, message, data. Everything is per uid and
ordered by (ts_ns, id), so a window over uid is the only shuffle; times are unix nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000_000


def by_time(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("uid",))).orderBy("ts_ns", "id")


def status_segments(events: DataFrame) -> DataFrame:
    """One segment for each event, up to the resource's next event; the last ends at the latest event of all."""
    last = events.agg(F.max("ts_ns").alias("last_ns"))
    ended = events.withColumn("next_ns", F.lead("ts_ns").over(by_time())).crossJoin(F.broadcast(last))  # one row
    return ended.select("uid", "kind", "namespace", "name", "id", F.col("ts_ns").alias("start_ns"), F.coalesce("next_ns", "last_ns").alias("end_ns"), "status", "message")


def merge_segments(segments: DataFrame, *same: str) -> DataFrame:
    """Consecutive segments of a resource with equal `same` (status and message) as one, with their number and duration."""
    same = same or ("status", "message")
    order = Window.partitionBy("uid").orderBy("start_ns", "id")
    new = F.coalesce(F.lag(F.struct(*same)).over(order) != F.struct(*same), F.lit(True))
    island = F.sum(new.cast("int")).over(order)
    rows = segments.withColumn("island", island).groupBy("uid", "island", *same)
    return rows.agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count("*").alias("n_events")).withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))


def coalesced_status(events: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Runs of one status inside [start, end]; the message is the last that isn't empty in the run."""
    inside = events.filter(F.col("ts_ns").between(start_ns, end_ns))
    order = by_time()
    rows = inside.withColumn("new", F.coalesce(F.lag("status").over(order) != F.col("status"), F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(order)).groupBy("uid", "island", "status")
    said = F.max(F.when(F.col("message") != "", F.struct("ts_ns", "id", "message")))["message"]
    runs = rows.agg(F.min("ts_ns").alias("start_ns"), F.coalesce(said, F.lit("")).alias("message"))
    following = F.lead("start_ns").over(Window.partitionBy("uid").orderBy("island"))
    return runs.select("uid", "status", "message", "start_ns", F.coalesce(following, F.lit(end_ns)).alias("end_ns"))


def leading_segments(events: DataFrame, start_ns: int) -> DataFrame:
    """[start, first event) for resources whose first event of the window comes later, with the state before the window or Unknown."""
    ordered = F.struct("ts_ns", "id", "status")
    rows = events.groupBy("uid").agg(F.min(F.when(F.col("ts_ns") >= start_ns, F.col("ts_ns"))).alias("first_ns"), F.max(F.when(F.col("ts_ns") < start_ns, ordered)).alias("prior"))
    return rows.filter(F.col("first_ns") > start_ns).select("uid", F.lit(start_ns).alias("start_ns"), F.col("first_ns").alias("end_ns"), F.coalesce("prior.status", F.lit("Unknown")).alias("status"))


def pre_existing(events: DataFrame, start_ns: int) -> DataFrame:
    """Per uid: does any event precede the window?"""
    return events.groupBy("uid").agg((F.min("ts_ns") < start_ns).alias("pre_existing"))


def timeline(events: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Events of [start, end] and, per resource, the one event before it; resources without either in effect are left out.

    A resource is kept if it has an event in the window, or an earlier one that isn't a DELETE.
    """
    last = F.row_number().over(Window.partitionBy("uid", F.col("ts_ns") < start_ns).orderBy(F.col("ts_ns").desc(), F.col("id").desc()))
    rows = events.filter(F.col("ts_ns") <= end_ns).withColumn("nth", last).withColumn("prior", F.col("ts_ns") < start_ns)
    rows = rows.filter(~F.col("prior") | (F.col("nth") == 1))
    inside = F.max((~F.col("prior")).cast("int")).over(Window.partitionBy("uid"))
    return rows.withColumn("inside", inside).filter((F.col("inside") == 1) | (F.col("type") != "DELETE")).drop("nth", "inside")


def with_warnings(rows: DataFrame, warnings: DataFrame) -> DataFrame:
    """rows with the list of their resource's warning events (involved_uid, ts_ns, reason, message, type, count), in order of time."""
    item = F.struct("ts_ns", "reason", "message", F.coalesce("type", F.lit("Normal")).alias("type"), F.coalesce("count", F.lit(1)).alias("count"))
    listed = warnings.groupBy(F.col("involved_uid").alias("uid")).agg(F.array_sort(F.collect_list(item)).alias("warnings"))
    return rows.join(listed, "uid", "left")


def page(resources: DataFrame, keys: list[str], after: tuple | None = None, size: int = 100) -> DataFrame:
    """The next `size` (500 at most) resources in the order of `keys` after the cursor, and has_more on every row."""
    size = max(1, min(size, 500))
    if after is not None:
        past = F.lit(False)
        for i, k in enumerate(keys):
            before = F.lit(True)
            for j in range(i):
                before &= F.col(keys[j]) == after[j]
            past |= before & (F.col(k) > after[i])
        resources = resources.filter(past)
    top = resources.orderBy(*keys).limit(size + 1)
    numbered = top.withColumn("nth", F.row_number().over(Window.orderBy(*keys)))  # size + 1 rows at most
    return numbered.withColumn("has_more", F.max("nth").over(Window.partitionBy()) > size).filter(F.col("nth") <= size).drop("nth")


def status_transitions(events: DataFrame) -> DataFrame:
    """Changes of status: uid, from_status, to_status, ts_ns, reason (the event's message)."""
    prev = F.lag("status").over(by_time())
    rows = events.withColumn("from_status", prev).filter(F.col("from_status").isNotNull() & (F.col("from_status") != F.col("status")))
    return rows.select("uid", "from_status", F.col("status").alias("to_status"), "ts_ns", F.col("message").alias("reason"))


def condition_history(conditions: DataFrame) -> DataFrame:
    """Per uid and condition type the runs of a status as `True(5m) -> False`, for rows (uid, condition, status, ts_ns, id)."""
    order = Window.partitionBy("uid", "condition").orderBy("ts_ns", "id")
    rows = conditions.withColumn("new", F.coalesce(F.lag("status").over(order) != F.col("status"), F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order))
    runs = rows.groupBy("uid", "condition", "island", "status").agg(F.min("ts_ns").alias("start_ns"))
    ends = F.lead("start_ns").over(Window.partitionBy("uid", "condition").orderBy("island"))
    text = F.when(ends.isNull(), F.col("status")).otherwise(F.concat("status", F.lit("("), duration_text((ends - F.col("start_ns")) / SECOND), F.lit(")")))
    said = runs.withColumn("text", text).groupBy("uid", "condition").agg(F.array_sort(F.collect_list(F.struct("island", "text"))).alias("runs"))
    return said.select("uid", "condition", F.array_join(F.col("runs.text"), " -> ").alias("history"))


def duration_text(seconds: Column) -> Column:
    """A duration as `< 1m`, `5m`, `2h 5m` or `3d4h`."""
    minutes = F.floor(seconds / 60)
    days, hours = F.floor(minutes / 1440), F.floor(minutes / 60)
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    hm = F.when(minutes % 60 == 0, part(hours, "h")).otherwise(F.concat(part(hours, "h"), F.lit(" "), part(minutes % 60, "m")))
    dh = F.when(hours % 24 == 0, part(days, "d")).otherwise(F.concat(part(days, "d"), part(hours % 24, "h")))
    return F.when(minutes < 1, "< 1m").when(minutes < 60, part(minutes, "m")).when(hours < 24, hm).otherwise(dh)


LAST = ["ts_ns", "id", "kind", "namespace", "name", "status", "message"]


def last_status(events: DataFrame) -> DataFrame:
    """Each resource's last event: uid, kind, namespace, name, status, message, ts_ns, n_events. One aggregation, partial before the shuffle."""
    rows = events.groupBy("uid").agg(F.max(F.struct(*LAST)).alias("last"), F.count("*").alias("n_events"))
    return rows.select("uid", "last.kind", "last.namespace", "last.name", "last.status", "last.message", "last.ts_ns", "n_events")


def current_status(events: DataFrame) -> DataFrame:
    """last_status, and since_ns, the time of the last change of status."""
    changed = events.withColumn("changed_ns", F.when(F.coalesce(F.lag("status").over(by_time()) != F.col("status"), F.lit(True)), F.col("ts_ns")))
    rows = changed.groupBy("uid").agg(F.max(F.struct(*LAST)).alias("last"), F.count("*").alias("n_events"), F.max("changed_ns").alias("since_ns"))
    return rows.select("uid", "last.kind", "last.namespace", "last.name", "last.status", "last.message", "last.ts_ns", "n_events", "since_ns")


STATUSES = ("Ready", "Warning", "Error", "Terminating", "Unknown")


def _overall(error: Column, warning: Column) -> Column:
    return F.when(error > 0, "Critical").when(warning > 0, "Degraded").otherwise("Healthy")


def cluster_health(events: DataFrame, listed: int = 20) -> DataFrame:
    """Per kind: counts of the five statuses, error rate, the first names of resources in error, and the kind's overall state.

    Names are ranked with a limit, which Spark applies before the shuffle too, so no list is longer than `listed`.
    """
    now = last_status(events)
    count = lambda s: F.count_if(F.col("status") == s)
    rows = now.groupBy("kind").agg(F.count("*").alias("total"), *[count(s).alias(s.lower()) for s in STATUSES])
    failed = now.filter("status = 'Error'").select("kind", F.concat_ws("/", "namespace", "name").alias("shown")).distinct()
    several = failed.groupBy("kind").agg(F.count("*").alias("several"))
    first = failed.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("shown"))).filter(F.col("nth") <= listed)
    names = first.groupBy("kind").agg(F.array_sort(F.collect_list("shown")).alias("names"))
    rows = rows.join(several, "kind", "left").join(names, "kind", "left")
    more = F.col("several") - listed
    text = F.concat(F.array_join("names", ", "), F.when(more > 0, F.concat(F.lit(" (+"), more, F.lit(" more)"))).otherwise(""))
    rate = F.round((F.col("error") + F.col("warning")) / F.col("total"), 6)
    return rows.select("kind", "total", *[s.lower() for s in STATUSES], rate.alias("error_rate"), F.coalesce(text, F.lit("")).alias("in_error"), _overall(F.col("error"), F.col("warning")).alias("overall"))


def cluster_overall(events: DataFrame) -> DataFrame:
    """One row for the whole cluster: overall state, resources, errors, warnings, and the kinds in error, most errors first."""
    per = last_status(events).groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "Error").alias("error"), F.count_if(F.col("status") == "Warning").alias("warning"))
    worst = F.array_sort(F.collect_list(F.when(F.col("error") > 0, F.struct((-F.col("error")).alias("n"), "kind"))))  # one entry for each kind
    said = F.array_join(F.transform(worst, lambda w: F.concat(w["kind"], F.lit(": "), -w["n"])), ", ")
    rows = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "error", "warning")], said.alias("issues"))
    return rows.select(_overall(F.col("error"), F.col("warning")).alias("overall"), "total", "error", "warning", "issues")


def top_issues(events: DataFrame, as_of_ns: int, n: int = 10) -> DataFrame:
    """The n resources not Ready for longest, then with most events."""
    rows = current_status(events).filter("status in ('Error', 'Warning')").withColumn("for_ns", F.lit(as_of_ns) - F.col("since_ns"))
    return rows.orderBy(F.desc("for_ns"), F.desc("n_events"), "uid").limit(n).select("uid", "kind", "status", "message", "for_ns", "n_events")


def resource_summary(events: DataFrame, newest: int = 25) -> DataFrame:
    """The newest events of each resource with messages of over 512 characters cut in the middle."""
    nth = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("ts_ns"), F.desc("id")))
    long = F.length("message") > 512
    cut = F.when(long, F.concat(F.substring("message", 1, 256), F.lit("..."), F.expr("right(message, 256)"))).otherwise(F.col("message"))
    return events.withColumn("nth", nth).filter(F.col("nth") <= newest).select("uid", "nth", "id", "ts_ns", "status", cut.alias("message"))


def select_events(events: DataFrame, incidents: DataFrame, lookback_ns: int, others: int = 10) -> DataFrame:
    """Per incident (incident_id, uid, t_ns): all config changes and the newest `others` other events in [t - lookback, t]."""
    rows = events.join(incidents, "uid").filter(F.col("ts_ns").between(F.col("t_ns") - lookback_ns, F.col("t_ns")))
    nth = F.row_number().over(Window.partitionBy("incident_id", "uid", "config_changed").orderBy(F.desc("ts_ns"), F.desc("id")))
    return rows.withColumn("nth", nth).filter(F.col("config_changed") | (F.col("nth") <= others)).drop("nth")


def newest_per_uid(rows: DataFrame, n: int = 20) -> DataFrame:
    """The n newest rows of each uid."""
    nth = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("ts_ns"), F.desc("id")))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= n).drop("nth")


def closest_event(events: DataFrame, incidents: DataFrame, tolerance_ns: int = 300 * SECOND) -> DataFrame:
    """Per incident (incident_id, uid, t_ns) the event nearest in time within the tolerance; hint says what there is otherwise."""
    rows = incidents.join(events.select("uid", "id", "ts_ns", "status"), "uid", "left").withColumn("gap", F.abs(F.col("ts_ns") - F.col("t_ns")))
    near = F.min(F.when(F.col("gap") <= tolerance_ns, F.struct("gap", "ts_ns", "id", "status"))).alias("near")
    out = rows.groupBy("incident_id", "uid", "t_ns").agg(near, F.min("ts_ns").alias("first_ns"))
    hint = F.when(F.col("near").isNotNull(), "").when(F.col("first_ns").isNull(), "no events").when(F.col("first_ns") > F.col("t_ns"), "first event is later").otherwise("first event is earlier")
    return out.select("incident_id", "uid", "near.id", "near.ts_ns", "near.status", hint.alias("hint"))


def latest_event_at(events: DataFrame, t_ns: int) -> DataFrame:
    """Each resource's last event at or before a time."""
    last = F.max(F.struct("ts_ns", "id", "type", "status", "data"))
    return events.filter(F.col("ts_ns") <= t_ns).groupBy("uid").agg(last.alias("e")).select("uid", "e.*")


def primary_event(events: DataFrame, failure_ns: Column) -> DataFrame:
    """Per uid: the earliest config change, else the earliest CREATE, else the status change nearest the failure, else the earliest."""
    e = F.struct("ts_ns", "id")
    near = F.min(F.when(F.col("status_changed"), F.struct(F.abs(F.col("ts_ns") - failure_ns).alias("gap"), "ts_ns", "id")))
    rows = events.groupBy("uid").agg(F.min(F.when(F.col("config_changed"), e)).alias("c"), F.min(F.when(F.col("type") == "CREATE", e)).alias("n"), near.alias("s"), F.min(e).alias("f"))
    chosen = F.coalesce("c", "n", F.when(F.col("s").isNotNull(), F.struct("s.ts_ns", "s.id")), "f")
    return rows.select("uid", chosen["id"].alias("id"), chosen["ts_ns"].alias("ts_ns"))


def distinct_metadata(events: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """One row: the sorted namespaces and kinds, and the first and last time."""
    if start_ns is not None:
        events = events.filter(F.col("ts_ns").between(start_ns, end_ns))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return events.agg(names("namespace").alias("namespaces"), names("kind").alias("kinds"), F.min("ts_ns").alias("min_ns"), F.max("ts_ns").alias("max_ns"))


def search_resources(events: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """The different resources that have an event in the window."""
    return events.filter(F.col("ts_ns").between(start_ns, end_ns)).select("uid", "kind", "namespace", "name").distinct()


def grouped_by_kind(resources: DataFrame) -> DataFrame:
    return resources.orderBy("kind", "namespace", "name")


def compare_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: events and resources of both results, their differences, accuracy (nA - |delta|) / nA and whether they match."""
    n = lambda df, s: df.agg(F.count("*").alias(f"events_{s}"), F.count_distinct("uid").alias(f"resources_{s}"))
    rows = n(a, "a").crossJoin(n(b, "b"))  # a row each
    delta = F.col("events_b") - F.col("events_a")
    accuracy = F.when(F.col("events_a") > 0, (F.col("events_a") - F.abs(delta)) / F.col("events_a")).otherwise(F.when(F.col("events_b") == 0, 1.0).otherwise(0.0))
    same = (delta == 0) & (F.col("resources_a") == F.col("resources_b"))
    return rows.select("*", delta.alias("event_delta"), (F.col("resources_b") - F.col("resources_a")).alias("resource_delta"), F.round(accuracy, 6).alias("accuracy"), same.alias("match"))

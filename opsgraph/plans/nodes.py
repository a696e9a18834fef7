"""Nodes of the resource graph from flat events (id, uid, kind, group, version, namespace, name, type, ts_ns, data, involved_uid)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.functions import status as st
from opsgraph.functions.facts import api_group, api_version, facts, labels, part
from opsgraph.operators.changes import detect_changes


def flatten(events: DataFrame) -> DataFrame:
    """Flat events from rows with a resource struct."""
    r = F.col("resource")
    return events.select("id", F.col("timestamp").alias("ts_ns"), "type", r["uid"].alias("uid"), r["kind"].alias("kind"), r["group"].alias("group"), r["version"].alias("version"), F.coalesce(r["namespace"], F.lit("")).alias("namespace"), r["name"].alias("name"), r["involvedObjectUid"].alias("involved_uid"), "data")


def build_resources(events: DataFrame, label_column: str | None = None) -> DataFrame:
    """One row for each uid: identity from its first event, labels and last_ns while it lived, and deletion, which is final.

    A DELETE ends the resource: what comes later doesn't change it. label_column: labels as a map, else from data.
    """
    own = F.col(label_column) if label_column else labels(F.col("data"))
    rows = events.withColumn("own_labels", own)
    gone = F.min(F.when(F.col("type") == "DELETE", F.col("ts_ns"))).over(Window.partitionBy("uid"))
    rows = rows.withColumn("deleted_ns", gone).filter(F.col("deleted_ns").isNull() | (F.col("ts_ns") <= F.col("deleted_ns")))
    order = F.struct("ts_ns", "id")
    first = [F.min_by(c, order).alias(c) for c in ("kind", "group", "version", "namespace", "name") if c in events.columns]
    out = rows.groupBy("uid").agg(*first, F.max_by("own_labels", order).alias("labels"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.first("deleted_ns").alias("deleted_ns"))
    return out.withColumn("deleted", F.col("deleted_ns").isNotNull())


def placeholders(events: DataFrame) -> DataFrame:
    """Resources that warning events point at (uid, kind, name and apiVersion known) as CREATE-like rows of the event's time."""
    o = lambda f: F.get_json_object("data", f"$.involvedObject.{f}")
    rows = events.filter(F.lower("kind") == "event").select("id", "ts_ns", F.lit("PLACEHOLDER").alias("type"), o("uid").alias("uid"), o("kind").alias("kind"), o("name").alias("name"), F.coalesce(o("namespace"), F.lit("")).alias("namespace"), o("apiVersion").alias("v"))
    rows = rows.filter("uid is not null and kind is not null and name is not null and v is not null")
    return rows.select("id", "ts_ns", "type", "uid", "kind", api_group(F.col("v")).alias("group"), api_version(F.col("v")).alias("version"), "namespace", "name", F.lit(None).cast("string").alias("involved_uid"), F.lit(None).cast("string").alias("data"))


def build_change_events(events: DataFrame) -> DataFrame:
    """Per event that isn't of kind Event: status, first error, issues, change flags and impact; the first of equal ids."""
    rows = detect_changes(events.filter(F.lower("kind") != "event").dropDuplicates(["id"])).withColumn("facts", facts(F.col("data")))
    rows = rows.withColumn("status", st.infer_status(F.col("kind"), F.col("facts"), F.col("type"))).withColumn("found", st.container_issues(F.col("facts")))
    errors = st.error_messages(F.col("kind"), F.col("facts"), F.col("status"))
    issues = F.coalesce(F.array_distinct(F.transform("found", lambda i: i["type"])), F.array().cast("array<string>"))
    rows = rows.withColumn("issues", issues).withColumn("error_message", F.coalesce(F.get(errors, F.lit(0)), F.lit("")))
    return rows.select("id", "uid", "kind", "namespace", "ts_ns", F.col("type").alias("event_type"), "status", "error_message", "issues", "config_changed", "status_changed", "replicas_changed", st.impact_score(F.col("status"), F.size("issues")).alias("impact"), "data")


def build_k8s_events(events: DataFrame) -> DataFrame:
    """Rows of kind Event: reason, message, type, count, source and the resource they are about."""
    d = lambda p: part(F.col("data"), p)
    rows = events.filter(F.lower("kind") == "event").dropDuplicates(["id"])
    return rows.select("id", F.coalesce("involved_uid", d("involvedObject.uid")).alias("uid"), "ts_ns", F.coalesce(d("reason"), F.lit("")).alias("reason"), F.coalesce(d("message"), F.lit("")).alias("message"), F.coalesce(d("type"), F.lit("Normal")).alias("type"), F.coalesce(d("count").cast("int"), F.lit(1)).alias("count"), F.coalesce(d("source.component"), F.lit("")).alias("source"))


def event_edges(change_events: DataFrame, k8s_events: DataFrame) -> DataFrame:
    """CHANGED from a resource to its change events and EMITTED_EVENT to its warning events."""
    a = change_events.select(F.lit("CHANGED").alias("type"), F.col("uid").alias("src"), F.col("id").alias("dst"))
    return a.union(k8s_events.filter("uid is not null").select(F.lit("EMITTED_EVENT"), "uid", "id"))


def preceded_by(events: DataFrame) -> DataFrame:
    """PRECEDED_BY from an event to the one before it on the same resource, with the time between in ms."""
    order = Window.partitionBy("uid").orderBy("ts_ns", "id")
    rows = events.select(F.lit("PRECEDED_BY").alias("type"), F.col("id").alias("src"), F.lag("id").over(order).alias("dst"), F.floor((F.col("ts_ns") - F.lag("ts_ns").over(order)) / 1_000_000).alias("duration_ms"))
    return rows.filter("dst is not null")

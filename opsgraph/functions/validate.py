"""Checks and repairs of incoming events: rows (id, timestamp, type, resource struct, data, dataSize, compressedSize)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ["CREATE", "UPDATE", "DELETE"]


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def import_ok() -> Column:
    """id, a positive time, type, kind and name are there."""
    r = F.col("resource")
    return ~_empty(F.col("id")) & (F.coalesce(F.col("timestamp"), F.lit(0)) > 0) & ~_empty(F.col("type")) & ~_empty(r["kind"]) & ~_empty(r["name"])


def validate_import(events: DataFrame) -> DataFrame:
    return events.filter(import_ok())


def strict_reason() -> Column:
    """Why a row isn't valid under the strict rules; null if it is."""
    r, size, packed = F.col("resource"), F.coalesce(F.col("dataSize"), F.lit(0)), F.coalesce(F.col("compressedSize"), F.lit(0))
    return (
        F.when(_empty(F.col("id")), "id is empty")
        .when(F.coalesce(F.col("timestamp"), F.lit(0)) <= 0, "timestamp is not positive")
        .when(~F.coalesce(F.col("type"), F.lit("")).isin(*TYPES), "type is unknown")
        .when(_empty(r["version"]), "version is empty")
        .when(_empty(r["kind"]), "kind is empty")
        .when(_empty(r["name"]), "name is empty")
        .when(_empty(r["uid"]), "uid is empty")
        .when(_empty(F.col("data")) & (F.col("type") != "DELETE"), "data is empty")
        .when((size < 0) | (packed < 0), "size is negative")
        .when(packed > size, "compressed size exceeds size")
    )


def validate_strict(events: DataFrame) -> DataFrame:
    return events.withColumn("reason", strict_reason())


def validation_summary(events: DataFrame) -> DataFrame:
    return validate_strict(events).agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason").isNotNull()).alias("invalid"))


def prune_managed_fields(data: Column, extra: tuple[str, ...] = ()) -> Column:
    """The snapshot without metadata.managedFields and the other metadata fields named; what isn't an object with metadata stays as it is.

    Values are kept as parsed, so texts stay texts.
    """
    fields = "map<string,variant>"
    top, metadata = F.from_json(data, fields), F.from_json(F.get_json_object(data, "$.metadata"), fields)
    kept = F.parse_json(F.to_json(F.map_filter(metadata, lambda k, _: ~k.isin("managedFields", *extra))))
    return F.when(top.isNull() | metadata.isNull(), data).otherwise(F.to_json(F.transform_values(top, lambda k, v: F.when(k == "metadata", kept).otherwise(v))))


def enrich_involved_uid(events: DataFrame) -> DataFrame:
    """For kind Event without an involved uid, the one in its data."""
    r = F.col("resource")
    found = F.when((F.lower(r["kind"]) == "event") & _empty(r["involvedObjectUid"]), F.coalesce(F.get_json_object("data", "$.involvedObject.uid"), r["involvedObjectUid"])).otherwise(r["involvedObjectUid"])
    return events.withColumn("resource", r.withField("involvedObjectUid", found))


def enrich(events: DataFrame, *steps) -> DataFrame:  # noqa: ANN002
    """events through a chain of functions DataFrame -> DataFrame."""
    for step in steps or (enrich_involved_uid,):
        events = events.transform(step)
    return events


def filter_resources(events: DataFrame, group: str = "", version: str = "", kinds: list[str] | None = None, namespaces: list[str] | None = None, kind: str = "", namespace: str = "") -> DataFrame:
    """Flat events of these groups, versions, kinds and namespaces; a list wins over a single value, empty means any."""
    for column, values in (("group", [group] if group else []), ("version", [version] if version else []), ("kind", kinds or ([kind] if kind else [])), ("namespace", namespaces or ([namespace] if namespace else []))):
        if values:
            events = events.filter(F.col(column).isin(*values))
    return events


def visible_in_window(start_ns: int, end_ns: int) -> Column:
    return ~F.col("deleted") | F.col("deleted_ns").between(start_ns, end_ns)


def visible_at(t_ns: int) -> Column:
    return (F.col("first_ns") <= t_ns) & (~F.col("deleted") | (F.col("deleted_ns") > t_ns)) & (F.col("kind") != "Event")


def find_resources(resources: DataFrame, wanted: DataFrame) -> DataFrame:
    """The resource of each wanted (namespace, kind, name): the live one with the smallest uid."""
    first = F.min(F.struct("deleted", "uid"))
    rows = resources.join(wanted.distinct(), ["namespace", "kind", "name"]).groupBy("namespace", "kind", "name").agg(first.alias("f"))
    return rows.select("namespace", "kind", "name", "f.uid")

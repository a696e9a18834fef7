"""What the operators read from a resource's JSON snapshot, parsed once with a fixed schema.

Missing and wrongly typed fields become null, and count as zero values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONDITION = "struct<type:string,status:string,reason:string,message:string,lastTransitionTime:string>"
STATE = "struct<waiting:struct<reason:string,message:string>,terminated:struct<reason:string,exitCode:int,message:string>,running:struct<startedAt:string>>"
CONTAINER = f"struct<name:string,restartCount:int,ready:boolean,state:{STATE},lastState:{STATE}>"
OWNER = "struct<uid:string,kind:string,name:string,apiVersion:string,controller:boolean,blockOwnerDeletion:boolean>"
COUNTS = ["replicas", "readyReplicas", "availableReplicas", "unavailableReplicas", "currentReplicas", "updatedReplicas", "desiredNumberScheduled", "numberReady", "numberUnavailable", "numberMisscheduled", "active", "succeeded", "failed"]
SNAPSHOT = (
    f"struct<metadata:struct<generation:long,deletionTimestamp:string,labels:map<string,string>,annotations:map<string,string>,ownerReferences:array<{OWNER}>>,"
    "spec:struct<replicas:int,nodeName:string,serviceAccountName:string,volumeName:string>,"
    f"status:struct<phase:string,reason:string,message:string,{','.join(f'{c}:int' for c in COUNTS)},conditions:array<{CONDITION}>,containerStatuses:array<{CONTAINER}>,initContainerStatuses:array<{CONTAINER}>>>"
)


def facts(data: Column) -> Column:
    """The snapshot as a struct; null if it isn't a JSON object."""
    return F.from_json(data, SNAPSHOT, {"mode": "PERMISSIVE"})


def with_facts(events: DataFrame) -> DataFrame:
    return events.withColumn("facts", facts(F.col("data")))


def part(data: Column, path: str) -> Column:
    """A part of the snapshot as JSON text."""
    return F.get_json_object(data, f"$.{path}")


def canonical(data: Column) -> Column:
    """JSON text with the keys of all objects sorted, at any depth, for comparing snapshots; what isn't JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(data)), data)


def labels(data: Column) -> Column:
    """metadata.labels as a map; empty if there are none."""
    return F.coalesce(F.from_json(F.get_json_object(data, "$.metadata.labels"), "map<string,string>"), F.create_map().cast("map<string,string>"))


def label_match(own: Column, selector: Column) -> Column:
    """Does every pair of the selector stand in the labels? An empty selector fits all."""
    return F.forall(F.map_entries(selector), lambda e: F.coalesce(F.element_at(own, e["key"]) == e["value"], F.lit(False)))


def has_label(own: Column, key: str, value: str) -> Column:
    return F.coalesce(F.element_at(own, F.lit(key)) == value, F.lit(False))


def has_ready_condition(fact: Column) -> Column:
    return F.coalesce(F.exists(fact["status"]["conditions"], lambda c: (c["type"] == "Ready") & (c["status"] == "True")), F.lit(False))


def api_group(api_version: Column) -> Column:
    """The part of an apiVersion before the first `/`; empty for the core group."""
    return F.when(F.instr(api_version, "/") > 0, F.substring_index(api_version, "/", 1)).otherwise("")


def api_version(api_version_: Column) -> Column:
    at = F.instr(api_version_, "/")
    return F.when(at > 0, F.substring(api_version_, at + 1, F.length(api_version_))).otherwise(api_version_)


def to_seconds(t: Column) -> Column:
    """Seconds from a number of seconds, or of milliseconds if it is over 10**10."""
    return F.when(t > 10_000_000_000, F.floor(t / 1000)).otherwise(t).cast("long")

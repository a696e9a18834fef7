"""Reading and writing of events, logs, metrics, dashboards and alert rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgraph.functions.validate import enrich, import_ok

RESOURCE = "struct<group:string,version:string,kind:string,namespace:string,name:string,uid:string,involvedObjectUid:string>"
EVENT_FIELDS = f"id string, timestamp long, type string, resource {RESOURCE}, data string, dataSize int, compressedSize int"
EVENT = f"struct<id:string,timestamp:bigint,type:string,resource:{RESOURCE},data:string,dataSize:int,compressedSize:int>"
LOG_FIELDS = "_msg string, _stream string, _time string, namespace string, pod string, container string, node string, level string"
PANEL = "struct<id:string,title:string,type:string,targets:array<struct<refId:string,expr:string,datasource:string>>>"
DASHBOARD_FIELDS = f"uid string, title string, version long, tags array<string>, panels array<{PANEL}>, templating struct<list:array<struct<name:string,type:string>>>"
FRAME = "struct<schema:struct<fields:array<struct<name:string,type:string,labels:map<string,string>,config:struct<unit:string>>>>,data:struct<values:array<array<double>>>>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file below a folder; the folder is listed here, once."""
    reader = spark.read.schema(f"events array<{EVENT}>, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True)
    return reader.json(path).withColumn("file", F.input_file_name())


def _documents(files: DataFrame, bad: bool = False) -> DataFrame:
    if bad:
        return files.filter("events is null").select("file").distinct()
    return files.filter("events is not null").select("file", F.explode("events").alias("e")).select("file", "e.*")


def read_documents(spark: SparkSession, path: str, bad: bool = False) -> DataFrame:
    """Files of one JSON document {"events": [...]} each, below a folder or a single one, plain or compressed; `bad`: the names of files that aren't."""
    return _documents(_files(spark, path), bad)


def read_event_batch(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(valid events, number of invalid ones) of one document; an empty or unreadable one is an error."""
    rows = read_documents(spark, path).drop("file")
    total = rows.agg(F.count("*").alias("n"), F.count_if(import_ok()).alias("ok")).first()
    if not total["n"]:
        raise ValueError(f"no events in {path}")
    return enrich(rows.filter(import_ok())), total["n"] - total["ok"]


def read_event_dir(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid events of all *.json files below a folder, names of files that can't be read); all bad is an error."""
    files = _files(spark, path)
    rows = _documents(files).filter(F.lower("file").rlike(r"\.json(\.gz|\.deflate)?$"))
    if not rows.limit(1).count():
        raise ValueError(f"no readable events below {path}")
    return enrich(rows.filter(import_ok()).drop("file")), _documents(files, bad=True)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Valid events of a file or of a folder."""
    return read_event_dir(spark, path)[0]


def write_audit_log(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines."""
    events.write.mode("append").json(path)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_FIELDS).json(path)


def stream_audit_log(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """The audit log as a stream, so many files a batch."""
    return spark.readStream.schema(EVENT_FIELDS).option("maxFilesPerTrigger", files).json(path)


def export_events(events: DataFrame, start_ns: int, end_ns: int, path: str) -> None:
    """The events of a window as gzipped JSON lines that read_audit_log reads, ordered by time in ranges."""
    inside = events.filter(F.col("timestamp").between(start_ns, end_ns))
    inside.sort("timestamp", "id").write.option("compression", "gzip").json(path)


def export_documents(events: DataFrame, start_ns: int, end_ns: int, path: str, most: int = 10_000) -> None:
    """The events of a window as documents {"events": [...]} that read_events reads: for each hour as many files as it has `most` events, gzipped.

    An hour's folder has its files side by side, one for each row, and tasks put their own files in place, so the driver
    neither makes a folder nor moves a file for each document.
    """
    hour = F.floor(F.col("timestamp") / 3_600_000_000_000)
    inside = events.filter(F.col("timestamp").between(start_ns, end_ns)).withColumn("hour", hour)
    files = inside.groupBy("hour").agg(F.ceil(F.count("*") / most).alias("files"))
    dealt = inside.join(files, "hour").withColumn("part", F.pmod(F.xxhash64("id", "timestamp"), F.col("files")))
    fields = ["timestamp", "id", "type", "resource", "data", "dataSize", "compressedSize"]
    documents = dealt.groupBy("hour", "part").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("events"))
    writer = documents.drop("part").write.partitionBy("hour").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.option("compression", "gzip").json(path)


def import_report(events: DataFrame) -> DataFrame:
    """One row: events, distinct hours, first and last time."""
    hour = F.floor(F.col("timestamp") / 3_600_000_000_000)
    return events.agg(F.count("*").alias("events"), F.count_distinct(hour).alias("hours"), F.min("timestamp").alias("first_ns"), F.max("timestamp").alias("last_ns"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as namespace, pod, container, level, ts_ns, message."""
    rows = spark.read.schema(LOG_FIELDS).json(path)
    return rows.select("namespace", "pod", "container", "level", (F.unix_micros(F.to_timestamp("_time")) * 1000).alias("ts_ns"), F.coalesce("_msg", F.lit("")).alias("message"))


def metric_frames(frames: DataFrame) -> DataFrame:
    """(labels, unit, ts, value) of frames (frame struct, or JSON text): the first column is time in ms, the second values.

    Frames with under two fields, or without values, give none.
    """
    f = F.from_json("frame", FRAME) if dict(frames.dtypes)["frame"] == "string" else F.col("frame")
    rows = frames.withColumn("f", f).filter((F.size("f.schema.fields") >= 2) & (F.size("f.data.values") >= 2))
    field = F.element_at("f.schema.fields", 2)
    points = F.arrays_zip(F.element_at("f.data.values", 1).alias("t"), F.element_at("f.data.values", 2).alias("v"))
    rows = rows.select(field["labels"].alias("labels"), field["config"]["unit"].alias("unit"), F.explode(points).alias("p"))
    return rows.select("labels", "unit", F.timestamp_millis(F.col("p.t").cast("long")).alias("ts"), F.col("p.v").alias("value"))


def read_dashboards(spark: SparkSession, path: str) -> DataFrame:
    """Dashboards with panels and template variables; one JSON document a line."""
    rows = spark.read.schema(DASHBOARD_FIELDS).json(path)
    return rows.withColumn("templating", F.col("templating.list"))


def read_alert_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("uid string, title string, updated string, labels map<string,string>, annotations map<string,string>, data array<struct<refId:string,queryType:string,model:string>>").json(path)


def read_alert_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("alert string, instance string, state string, ts_ns long").json(path)



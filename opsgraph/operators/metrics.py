"""Metric points (series, metric, ts, value) against baselines of the same time of week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
ERROR_NAMES = ["5xx", "error", "failed", "failure"]
LEAST_SAMPLES = 3


def metric_name(labels: Column) -> Column:
    """__name__, else the first label by key as k=v; null without labels."""
    first = F.array_min(F.map_keys(labels))
    return F.coalesce(F.element_at(labels, F.lit("__name__")), F.concat(first, F.lit("="), F.element_at(labels, first)))


def hour(ts: Column) -> Column:
    return F.hour(ts)


def day_type(ts: Column) -> Column:
    return F.when(F.weekday(ts) >= 5, "weekend").otherwise("weekday")


def baselines(points: DataFrame, as_of: Column | None = None, days: int = 7, expires_h: int = 1) -> DataFrame:
    """(series, metric, hour, day_type, mean, stddev, n) over the days before as_of; under three samples there is none."""
    if as_of is not None:
        points = points.filter((F.col("ts") < as_of) & (F.col("ts") >= as_of - F.expr(f"interval {days} days")))
    rows = points.groupBy("series", "metric", hour(F.col("ts")).alias("hour"), day_type(F.col("ts")).alias("day_type"))
    rows = rows.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_SAMPLES)
    return rows if as_of is None else rows.withColumn("expires_at", as_of + F.expr(f"interval {expires_h} hours"))


def unexpired(table: DataFrame, as_of: Column) -> DataFrame:
    return table.filter(F.col("expires_at") > as_of)


def upsert_baselines(table: DataFrame, fresh: DataFrame, as_of: Column) -> DataFrame:
    """The table with fresh baselines instead of those of the same key, without expired ones."""
    key = ["series", "metric", "hour", "day_type"]
    return unexpired(table, as_of).join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def z_score(value: Column, mean: Column, stddev: Column) -> Column:
    return F.when(F.coalesce(stddev, F.lit(0.0)) == 0, 0.0).otherwise((value - mean) / stddev)


def z_severity(metric: Column, z: Column) -> Column:
    """critical, warning, info or null; metrics named for errors count from lower scores."""
    error = F.lower(metric).rlike("|".join(ERROR_NAMES))
    grade = lambda a, b, c: F.when(F.abs(z) >= a, "critical").when(F.abs(z) >= b, "warning").when(F.abs(z) >= c, "info")
    return F.when(error, grade(2.0, 1.5, 1.0)).otherwise(grade(3.0, 2.0, 1.5))


def last_values(points: DataFrame) -> DataFrame:
    last = F.max(F.struct("ts", "seq", "value")).alias("p")
    return points.groupBy("series", "metric").agg(last).select("series", "metric", "p.ts", "p.value", "p.seq")


def detect_metric_anomalies(points: DataFrame, as_of: Column, n: int = 20) -> DataFrame:
    """The last value of each series against its baseline: the n anomalies of highest severity, then score."""
    now = last_values(points.filter(F.col("ts") <= as_of)).withColumn("hour", hour(F.col("ts"))).withColumn("day_type", day_type(F.col("ts")))
    old = points.filter(F.col("ts") <= as_of).join(now.select("series", "metric", F.col("ts").alias("at"), F.col("seq").alias("last_seq"), "hour", "day_type"), ["series", "metric"])
    old = old.filter((F.col("ts") <= F.col("at")) & (F.col("seq") != F.col("last_seq")) & (hour(F.col("ts")) == F.col("hour")) & (day_type(F.col("ts")) == F.col("day_type")) & (F.col("ts") >= F.col("at") - F.expr("interval 7 days")))
    base = old.groupBy("series", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_SAMPLES)
    rows = now.join(base, ["series", "metric"]).withColumn("z", z_score(F.col("value"), F.col("mean"), F.col("stddev"))).withColumn("severity", z_severity(F.col("metric"), F.col("z"))).filter("severity is not null")
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return rows.orderBy(rank, F.desc(F.round(F.abs("z"), 6)), "series", "metric").limit(n).select("series", "metric", "severity", F.round("z", 6).alias("z"), F.round("value", 6).alias("value"), F.round("mean", 6).alias("mean"), "n")


def skipped(points: DataFrame, as_of: Column) -> DataFrame:
    """One row: series without enough samples for a baseline."""
    now = points.filter(F.col("ts") <= as_of).groupBy("series", "metric").agg(F.count("*").alias("n"))
    return now.agg(F.count_if(F.col("n") <= LEAST_SAMPLES).alias("skipped"), F.count("*").alias("series"))


def overview(panels: DataFrame, anomalies: DataFrame, per_dashboard: int = 5) -> DataFrame:
    """The first panels of each overview dashboard (dashboard, level, panel, position, metric), with the worst anomaly of their metric."""
    nth = F.row_number().over(Window.partitionBy("dashboard").orderBy("position", "panel"))
    first = panels.filter("level = 'overview'").withColumn("nth", nth).filter(F.col("nth") <= per_dashboard)
    worst = anomalies.groupBy("metric").agg(F.max_by("severity", F.abs("z")).alias("severity"), F.count("*").alias("n_anomalies"))
    return first.join(worst, "metric", "left")


def labelled(points: DataFrame, **equal: str) -> DataFrame:
    """Points whose labels have the given values (cluster, region, service, namespace)."""
    for key, value in equal.items():
        points = points.filter(F.element_at("labels", F.lit(key)) == value)
    return points


def aggregated(points: DataFrame, step_s: int, **equal: str) -> DataFrame:
    """Mean, least, most and number per metric and step."""
    rows = labelled(points, **equal).groupBy("metric", F.window("ts", f"{step_s} seconds")["start"].alias("start"))
    return rows.agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))

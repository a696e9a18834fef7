"""Lineage of dashboards: which panels and alert rules use which metrics, and which services those are about.

Dashboards are rows (uid, title, version, tags, panels array, templating array) as sources.events.read_dashboards gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SCOPING = "cluster|region|env|environment|datacenter|zone"
ENTITY = "service|namespace|app|job|deployment|pod|container|node"
DETAIL = "instance|handler|method|status|path|endpoint"
AGGREGATIONS = "sum|avg|min|max|count|stddev|stdvar|topk|bottomk|quantile|count_values|group"
KEYWORDS = "by|without|on|ignoring|group_left|group_right|and|or|unless|bool|offset|inf|nan"
SERVICE_LABELS = ["app", "service", "job"]
#: What a template variable looks like, in strings too: $var, ${var}, ${var:format}, [[var]]; not `[[:alpha:]]` or `${` alone.
VARIABLE = r"\$\w|\$\{\w+(:\w+)?\}|\[\[\w+\]\]"


def hierarchy_level(tags: Column, folder_level: Column | None = None) -> Column:
    """From tags such as `overview` or `level:detail`, else a given level, else detail."""
    tagged = lambda level: F.exists(tags, lambda t: F.lower(t).isin(level, f"level:{level}", f"hierarchy:{level}"))
    named = [F.when(tagged(level), level) for level in ("overview", "drilldown", "detail")]
    return F.coalesce(*named, *([folder_level] if folder_level is not None else []), F.lit("detail"))


def variable_class(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike(SCOPING), "scoping").when(low.rlike(ENTITY), "entity").when(low.rlike(DETAIL), "detail").otherwise("unknown")


def datasource_uid(text: Column) -> Column:
    """A datasource given as an object with uid, or as a plain string."""
    return F.coalesce(F.get_json_object(text, "$.uid"), F.regexp_replace(text, '^"|"$', ""))


def panels(dashboards: DataFrame) -> DataFrame:
    return dashboards.select(F.col("uid").alias("dashboard"), F.posexplode("panels").alias("position", "p")).select("dashboard", "position", F.concat_ws("-", "dashboard", "p.id").alias("panel"), "p.title", "p.type", "p.targets")


def queries(dashboards: DataFrame) -> DataFrame:
    """(dashboard, panel, query, expr, datasource) of every target."""
    rows = panels(dashboards).select("dashboard", "panel", F.explode("targets").alias("t"))
    return rows.select("dashboard", "panel", F.concat_ws("-", "panel", "t.refId").alias("query"), F.col("t.expr").alias("expr"), datasource_uid(F.col("t.datasource")).alias("datasource"))


def variables(dashboards: DataFrame) -> DataFrame:
    rows = dashboards.select(F.col("uid").alias("dashboard"), F.explode("templating").alias("v"))
    return rows.select("dashboard", F.col("v.name").alias("variable"), "v.type", variable_class(F.col("v.name")).alias("class"))


def structure_edges(dashboards: DataFrame) -> DataFrame:
    """CONTAINS, HAS and HAS_VARIABLE edges."""
    a = panels(dashboards).select(F.lit("CONTAINS").alias("type"), F.col("dashboard").alias("src"), F.col("panel").alias("dst"))
    b = queries(dashboards).select(F.lit("HAS"), "panel", "query")
    return a.union(b).union(variables(dashboards).select(F.lit("HAS_VARIABLE"), "dashboard", "variable"))


def replaced(old: DataFrame, fresh: DataFrame, key: str = "dashboard") -> DataFrame:
    """old without the rows of dashboards that come afresh, and those."""
    return old.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def well_formed(bare: Column) -> Column:
    """Do the brackets of an expression without strings and comments close in order, does no operator stand at its end, and is there no `$` or `[[` left?

    A fold over the brackets with the open ones as a stack; one that doesn't fit stays there for ever.
    """
    brackets = F.split(F.regexp_replace(bare, r"[^()\[\]{}]", ""), "")

    def step(open_: Column, b: Column) -> Column:
        closes = F.when(b == ")", "(").when(b == "]", "[").when(b == "}", "{")
        popped = F.when(open_.endswith(closes), F.substring(open_, F.lit(1), F.length(open_) - 1)).otherwise(F.concat(open_, F.lit("!")))
        return F.when(closes.isNotNull(), popped).otherwise(F.concat(open_, b))

    left = F.aggregate(brackets, F.lit(""), step)
    return (left == "") & ~bare.rlike(r"^\s*$|\$|\[\s*\[|[-+*/%^=<>!,]\s*$|\b(and|or|unless|by|without|on|ignoring|offset)\s*$")


def promql(expr: Column) -> Column:
    """(metrics, labels, aggregations, functions, has_variables, well_formed) of a PromQL expression.

    Comments, strings, label matchers, ranges, grouping lists and `@` modifiers go first; what names are left are metrics,
    or functions if `(` follows. No names come of an expression that isn't well formed, and no metrics where a variable
    stands in it.
    """
    # Strings first, so that a # or a bracket in one is none.
    bare = F.regexp_replace(F.regexp_replace(expr, r"\"(\\.|[^\"\\])*\"|'(\\.|[^'\\])*'|`[^`]*`", "''"), r"#[^\n]*", " ")
    bare = F.regexp_replace(bare, r"@\s*(?:start|end)\s*\(\s*\)|@\s*[-+]?[0-9.eE]+", " ")
    has_variables = expr.rlike(VARIABLE)
    fits = well_formed(bare) | has_variables
    selectors = F.regexp_extract_all(expr, F.lit(r"([a-zA-Z_][a-zA-Z0-9_]*)\s*(=~|!~|!=|=)\s*(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')"), F.lit(0))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\{[^}]*\}", " "), r"\[[^\]]*\]", " "), r"\b(by|without|on|ignoring|group_left|group_right)\s*\([^)]*\)", " ")
    called = F.regexp_extract_all(plain, F.lit(r"\b([a-zA-Z_:][a-zA-Z0-9_:]*)\s*\("), F.lit(1))
    names = F.regexp_extract_all(plain, F.lit(r"(?<![\w:.$])([a-zA-Z_:][a-zA-Z0-9_:]*)\b(?!\s*\()"), F.lit(1))
    metrics = F.array_distinct(F.filter(names, lambda n: ~F.lower(n).rlike(f"^({KEYWORDS}|{AGGREGATIONS})$")))
    is_aggregation = lambda c: F.lower(c).rlike(f"^({AGGREGATIONS})$")
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(fits & ~has_variables, metrics).otherwise(none).alias("metrics"),
        F.when(fits, selectors).otherwise(none).alias("labels"),
        F.when(fits, F.array_distinct(F.filter(called, is_aggregation))).otherwise(none).alias("aggregations"),
        F.when(fits, F.array_distinct(F.filter(called, lambda c: ~is_aggregation(c)))).otherwise(none).alias("functions"),
        has_variables.alias("has_variables"),
        fits.alias("well_formed"),
    )


def uses_edges(query_rows: DataFrame) -> DataFrame:
    """USES from a query to each metric of its expression."""
    return query_rows.select(F.lit("USES").alias("type"), F.col("query").alias("src"), F.explode(promql(F.col("expr"))["metrics"]).alias("dst")).distinct()


def label_value(labels: Column, name: str) -> Column:
    """The value that a label is compared with by =; null if it isn't."""
    hit = F.get(F.filter(labels, lambda s: s.rlike(f"^{name}\\s*=\\s*[\"']")), F.lit(0))
    return F.regexp_extract(hit, r"[\"'](.*)[\"']$", 1)


def services(query_rows: DataFrame) -> DataFrame:
    """(query, service, cluster, namespace) from the labels app, service and job; Unknown without any. Queries with variables have none: their labels may be templates too."""
    rows = query_rows.withColumn("p", promql(F.col("expr"))).filter(~F.col("p.has_variables")).withColumn("l", F.col("p.labels"))
    named = F.array_distinct(F.array_compact(F.array(*[label_value(F.col("l"), k) for k in SERVICE_LABELS])))
    names = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("Unknown")))
    return rows.select("query", F.explode(names).alias("service"), F.coalesce(label_value(F.col("l"), "cluster"), F.lit("")).alias("cluster"), F.coalesce(label_value(F.col("l"), "namespace"), F.lit("")).alias("namespace"))


def tracks_edges(query_rows: DataFrame) -> DataFrame:
    """TRACKS from a metric to the services of the queries that use it."""
    return uses_edges(query_rows).join(services(query_rows).withColumnRenamed("query", "src"), "src").select(F.lit("TRACKS").alias("type"), F.col("dst").alias("src"), F.col("service").alias("dst")).distinct()


def monitors_edges(alert_rules: DataFrame) -> DataFrame:
    """MONITORS from an alert rule (uid, data array<struct<refId, model>>) to the metrics of its queries."""
    rows = alert_rules.select("uid", F.explode("data").alias("d")).select("uid", F.get_json_object("d.model", "$.expr").alias("expr")).filter("expr is not null")
    return rows.select(F.lit("MONITORS").alias("type"), F.col("uid").alias("src"), F.explode(promql(F.col("expr"))["metrics"]).alias("dst")).distinct()


def by_level(dashboards: DataFrame, level: str) -> DataFrame:
    return dashboards.filter(hierarchy_level(F.col("tags")) == level)

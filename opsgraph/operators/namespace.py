"""The graph of a namespace at a time: its resources, what they reach, their last events and changes, and the edges among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.functions.validate import visible_at
from opsgraph.operators.changes import net_spec_change
from opsgraph.operators.timeline import latest_event_at
from opsgraph.operators.traverse import induced_subgraph, reachable

CANDIDATE_KINDS = ["Pod", "Deployment", "ReplicaSet", "StatefulSet", "DaemonSet", "Service", "Ingress", "HelmRelease", "Kustomization", "PersistentVolumeClaim"]


def namespace_graph(resources: DataFrame, events: DataFrame, edges: DataFrame, namespace: str, t_ns: int, depth: int = 2, lookback_ns: int = 3_600_000_000_000, cluster_scoped: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): resources visible at t, at most `cluster_scoped` of those without namespace that they reach, and the induced edges."""
    own = resources.filter((F.col("namespace") == namespace) & visible_at(t_ns))
    wide = resources.filter((F.col("namespace") == "") & visible_at(t_ns))
    near = reachable(edges, own.select("uid"), depth).filter("distance > 0").groupBy(F.col("other").alias("uid")).agg(F.min("distance").alias("distance"))
    wide = wide.join(near, "uid").orderBy("distance", "kind", "name", "uid").limit(cluster_scoped)
    nodes = own.select("uid", "kind", "namespace", "name", "labels").unionByName(wide.select("uid", "kind", "namespace", "name", "labels"))
    last = latest_event_at(events, t_ns).select("uid", F.col("id").alias("last_event"), F.col("type").alias("last_type"), "status")
    change = net_spec_change(events, t_ns - lookback_ns, t_ns).select("uid", "diff")
    nodes = nodes.join(last, "uid", "left").join(change, "uid", "left").filter("last_type is null or last_type != 'DELETE'").drop("last_type")
    return nodes, induced_subgraph(edges, nodes.select("uid"))


def namespace_symptoms(nodes: DataFrame, anomalies: DataFrame, t_ns: int) -> DataFrame:
    """Incidents (incident_id, uid, t_ns) for the nodes of the usual kinds that have anomalies; for causal_paths."""
    rows = nodes.filter(F.col("kind").isin(*CANDIDATE_KINDS)).join(anomalies.select("uid").distinct(), "uid")
    return rows.select(F.col("uid").alias("incident_id"), "uid", F.lit(t_ns).alias("t_ns"))

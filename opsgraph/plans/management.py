"""MANAGES and CREATES_OBSERVED edges, scored by evidence, and the upkeep of scored edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND_NS = 1_000_000_000
EVIDENCE = "array<struct<type:string,value:string,weight:double>>"


def management_score(manager: str, managed: str, label_match: Column, weights: dict[str, float], window_s: int, reconciled: Column | None = None) -> Column:
    """(confidence, evidence) of candidate pairs with struct columns `manager` (name, namespace, target_ns, ts_ns) and `managed` (name, namespace, first_ns).

    All expected labels there: 1. Else the earned share of the weights of name prefix, namespace, nearness in time and,
    if weighted, a reconcile of the manager.
    """
    m, r = F.col(manager), F.col(managed)
    lag = r["first_ns"] - m["ts_ns"]
    near = F.when(lag.between(0, window_s * SECOND_NS), 1 - lag / (window_s * SECOND_NS)).otherwise(0.0)
    earned = {
        "name": F.when(F.lower(r["name"]).startswith(F.lower(m["name"])), weights["name"]).otherwise(0.0),
        "namespace": F.when((m["target_ns"] == "") | (r["namespace"] == m["target_ns"]), weights["namespace"]).otherwise(0.0),
        "temporal": near * weights["temporal"],
    }
    if "reconcile" in weights and reconciled is not None:
        earned["reconcile"] = F.when(reconciled, weights["reconcile"]).otherwise(0.0)
    score = sum(earned.values(), F.lit(0.0)) / sum(weights[k] for k in earned)
    item = lambda kind, w: F.when(w > 0, F.struct(F.lit(kind).alias("type"), r["name"].alias("value"), w.cast("double").alias("weight")))
    evidence = F.array_compact(F.array(*[item(k, w) for k, w in earned.items()]))
    label = F.array(F.struct(F.lit("label").alias("type"), m["name"].alias("value"), F.lit(1.0).alias("weight")))
    return F.struct(F.when(label_match, 1.0).otherwise(score).alias("confidence"), F.when(label_match, label).otherwise(evidence).cast(EVIDENCE).alias("evidence"))


# Label keys by which a manager marks what it manages, weights and windows.
MANAGERS = {
    "HelmRelease": (("helm.toolkit.fluxcd.io/name", "helm.toolkit.fluxcd.io/namespace"), {"name": 0.4, "namespace": 0.1, "temporal": 0.3, "reconcile": 0.2}, 30),
    "Kustomization": (("kustomize.toolkit.fluxcd.io/name", "kustomize.toolkit.fluxcd.io/namespace"), {"name": 0.4, "namespace": 0.3, "temporal": 0.3}, 30),
    "Application": (("argocd.argoproj.io/instance", None), {"name": 0.4, "namespace": 0.3, "temporal": 0.3}, 120),
}


def manages(managers: DataFrame, resources: DataFrame, owns: DataFrame, least: float = 0.5) -> DataFrame:
    """MANAGES edges with confidence and evidence.

    managers: uid, kind, namespace, name, target_ns, ts_ns, reconciled; resources: live ones, with uid, kind, namespace, name, labels,
    first_ns. Candidates have no owner. They meet their manager by label, or by namespace and time bucket; those of a
    manager that aims at no namespace by time bucket.
    """
    free = resources.join(owns.select(F.col("dst").alias("uid")).distinct(), "uid", "left_anti")
    out = None
    for kind, ((name_key, ns_key), weights, window) in MANAGERS.items():
        m = managers.filter(F.col("kind") == kind).select(F.struct("uid", "namespace", "name", "target_ns", "ts_ns", "reconciled").alias("m"))
        r = free.select(F.struct("uid", "namespace", "name", "labels", "first_ns").alias("r"))
        label = F.element_at("r.labels", F.lit(name_key))
        in_ns = F.lit(True) if ns_key is None else F.element_at("r.labels", F.lit(ns_key)) == F.col("m.namespace")
        by_label = m.join(r, (F.col("m.name") == label) & in_ns)
        span = window * SECOND_NS
        bucket = lambda t: F.floor(t / span)
        slots = m.withColumn("slot", F.explode(F.array(bucket(F.col("m.ts_ns")), bucket(F.col("m.ts_ns")) + 1)))
        timed = r.withColumn("slot", bucket(F.col("r.first_ns")))
        aimed = slots.filter("m.target_ns != ''").withColumn("ns", F.col("m.target_ns")).join(timed.withColumn("ns", F.col("r.namespace")), ["slot", "ns"])
        anywhere = slots.filter("m.target_ns = ''").join(timed, "slot")
        near = aimed.select("m", "r").union(anywhere.select("m", "r")).filter((F.col("r.first_ns") - F.col("m.ts_ns")).between(0, span))
        if kind == "Application":  # candidates carry the instance label
            near = near.filter(label.isNotNull())
        pairs = by_label.union(near).filter("m.uid != r.uid")
        matched = F.coalesce((F.col("m.name") == label) & in_ns, F.lit(False))
        scored = pairs.withColumn("s", management_score("m", "r", matched, weights, window, F.col("m.reconciled")))
        scored = scored.select(F.lit("MANAGES").alias("type"), F.col("m.uid").alias("src"), F.col("r.uid").alias("dst"), "s.confidence", "s.evidence").filter(F.col("confidence") >= least)
        out = scored if out is None else out.union(scored)
    return out.dropDuplicates(["src", "dst"])


def creates_observed(certificates: DataFrame, secrets: DataFrame, least: float = 0.5, window_s: int = 300) -> DataFrame:
    """CREATES_OBSERVED from a certificate (uid, namespace, name, secret_name, ts_ns) to the secret (uid, namespace, name, first_ns) it issues."""
    width = window_s * SECOND_NS
    lag = F.col("s.first_ns") - F.col("c.ts_ns")
    same = F.coalesce(F.col("s.name") == F.col("c.secret_name"), F.lit(False))
    score = F.when(same, 0.5).otherwise(0.2) + 0.2 + F.when(lag.between(0, width), 0.3 * (1 - lag / width)).otherwise(0.0)
    shown = F.lit("CREATES_OBSERVED").alias("type"), F.col("c.uid").alias("src"), F.col("s.uid").alias("dst"), score.alias("confidence")
    space = F.col("c.namespace") == F.col("s.namespace")
    # By the name that the certificate gives, and by names that begin with its own, of which each beginning is a key.
    named = secrets.alias("s").join(certificates.alias("c"), space & (F.col("s.name") == F.col("c.secret_name"))).select(*shown)
    begun = secrets.withColumn("beginning", F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n))))
    on = space & (F.col("c.name") == F.col("s.beginning"))
    lengths = certificates.select(F.length("name").alias("n")).distinct()
    begun = begun.join(F.broadcast(lengths), F.length("beginning") == F.col("n"), "left_semi")
    if least > 0.2 + 0.2:  # then only a secret of the window can count: time is cut into slots of its length
        begun, certificates = begun.withColumn("slot", F.floor(F.col("first_ns") / width)), certificates.withColumn("slot", F.explode(F.array(*[F.floor(F.col("ts_ns") / width) + i for i in (0, 1)])))
        on &= (F.col("c.slot") == F.col("s.slot")) & lag.between(0, width)
    rows = named.union(begun.alias("s").join(certificates.alias("c"), on & ~same).select(*shown))
    return rows.filter(F.col("confidence") >= least)


def revalidated(edges: DataFrame, resources: DataFrame, as_of_ns: int) -> DataFrame:
    """Scored edges (src, dst, confidence, evidence, validated_ns) between live resources with decayed confidence and a state.

    Over 6 hours old: x 0.9, over 24 hours: x 0.7, at least 0.1, but a confidence of 1 stays; stale after 7 days. After an hour
    the evidence is looked at again: valid, or invalid if some of it no longer holds; else pending. Evidence of the
    namespace holds if both ends share it; of a label or annotation, if the target still has a value like it; of
    ownership, if the source is among the target's owners. resources: uid, namespace, deleted, and as far as they are
    known labels, annotations (maps) and owners (array of uids).
    """
    live = resources.filter("not deleted")
    known = [c for c in ("labels", "annotations", "owners") if c in resources.columns]
    source = live.select(F.col("uid").alias("src"), F.col("namespace").alias("src_ns"))
    target = live.select(F.col("uid").alias("dst"), F.col("namespace").alias("dst_ns"), *[F.col(c).alias(f"dst_{c}") for c in known])
    ends = edges.join(source, "src").join(target, "dst")
    hours = (F.lit(as_of_ns) - F.col("validated_ns")) / (3600 * SECOND_NS)
    decayed = F.when(F.col("confidence") >= 1.0, F.col("confidence")).when(hours > 24, F.greatest(F.lit(0.1), F.col("confidence") * 0.7)).when(hours > 6, F.greatest(F.lit(0.1), F.col("confidence") * 0.9)).otherwise(F.col("confidence"))
    has = lambda c, v: F.coalesce(F.array_contains(F.map_values(c), v), F.lit(False))
    checks = {"namespace": lambda e: F.col("src_ns") == F.col("dst_ns"), "label": lambda e: has("dst_labels", e["value"]), "annotation": lambda e: has("dst_annotations", e["value"]), "ownership": lambda e: F.coalesce(F.array_contains("dst_owners", F.col("src")), F.lit(False))}
    needs = {"label": "labels", "annotation": "annotations", "ownership": "owners"}
    usable = {kind: holds for kind, holds in checks.items() if needs.get(kind, kind) in (*known, "namespace")}
    broken = F.exists("evidence", lambda e: reduce(Column.__or__, [(e["type"] == kind) & ~holds(e) for kind, holds in usable.items()]))
    state = F.when(hours > 24 * 7, "stale").when(hours <= 1, "pending").when(broken, "invalid").otherwise("valid")
    return ends.select("src", "dst", decayed.alias("confidence"), state.alias("state"))


def stale_edges(edges: DataFrame, cutoff_ns: int) -> DataFrame:
    return edges.filter(F.col("validated_ns") < cutoff_ns)


def managed_resources(edges: DataFrame, uid: str, least: float = 0.5) -> DataFrame:
    return edges.filter((F.col("type") == "MANAGES") & (F.col("src") == uid) & (F.col("confidence") >= least)).orderBy(F.desc("confidence"), "dst")

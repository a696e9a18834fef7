"""Causal paths against a walk over all simple paths, on random graphs."""

from __future__ import annotations

import itertools
import random

import pytest
from opsgraph.operators import causal, rules
from pyspark.sql import functions as F

S = 1_000_000_000
T = 10_000
KINDS = ["Pod", "Deployment", "ReplicaSet", "HelmRelease", "ConfigMap", "Node", "Service"]
EDGES = ["OWNS", "MANAGES", "REFERENCES_SPEC", "SCHEDULED_ON", "GRANTS_TO", "USES_SERVICE_ACCOUNT", "SELECTS"]
TYPES = [("Change", "ImageChanged"), ("Change", "ResourceCreated"), ("State", "CrashLoopBackOff"), ("State", "Evicted"), ("State", "ImagePullBackOff"), ("State", "DiskPressure"), ("Change", "ResourceDeleted"), ("State", "ErrorStatus"), ("Change", "ConfigChange"), ("State", "HelmReleaseFailed"), ("Event", "BackOff")]
SAID = ["", "manifest unknown", "x509: bad", "i/o timeout", "slow"]
LEVELS = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}


def graph(seed, nodes=8, dense=False):
    """(edges, resources, anomalies, incidents) of one random graph; all uids begin with the seed."""
    rnd = random.Random(seed)
    uid = [f"{seed}/{i}" for i in range(nodes)]
    kind = {u: rnd.choice(KINDS) for u in uid}
    edges = {(rnd.choice(["OWNS", "REFERENCES_SPEC"]) if dense else rnd.choice(EDGES), a, b) for a in uid for b in uid if a != b and rnd.random() < (0.9 if dense else 0.3)}
    anomalies = []
    for u in uid:
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            category, type_ = rnd.choice(TYPES)
            anomalies.append((u, category, type_, rnd.choice(list(LEVELS)), (T - rnd.choice([-20, 0, 2, 10, 40, 200, 400, 500, 900, 1200])) * S, rnd.choice(SAID)))
    return sorted(edges), [(u, kind[u]) for u in uid], anomalies, [(f"i{u}", u, T * S) for u in uid[:2]]


def brute(edges, resources, anomalies, incident, depth):
    """Root -> (confidence, steps, first ns) by walking every simple path."""
    kind, (_, symptom, t_ns) = dict(resources), incident
    up = {}
    for type_, src, dst in edges:
        cause = type_ in rules.CAUSE_EDGES
        at, to = (dst, src) if not cause or type_ in ("MANAGES", "GRANTS_TO") else (src, dst)
        up.setdefault(at, set()).add((to, type_, cause))
    own = {u: [a for a in anomalies if a[0] == u] for u in kind}
    failure = min((a[4] for a in own[symptom]), default=t_ns)

    def reach(limit):
        seen, front = {symptom}, {symptom}
        for _ in range(limit):
            front = {to for u in front for to, _, _ in up.get(u, ())} - seen
            seen |= front
        return seen

    around = [a for u in reach(depth) for a in own[u]]
    pressed, changed = any(a[2] in causal.PRESSURE for a in around), any(a[2] == "ImageChanged" for a in around)

    def plain(a):
        return a[1] == "Change" or a[2] in rules.CAUSE_INTRODUCING

    def in_context(a):
        if a[2] in causal.PULL:
            return not changed and any(w in a[5] for w in ("manifest unknown", "x509", "i/o timeout"))
        if a[2] == "Evicted":
            return not pressed
        return plain(a) and a[2] not in rules.DERIVED

    found = {}

    def end(path, edge_kinds):
        root = path[-1]
        seen = [a for u in path for a in own[u]]
        first, severity = min((a[4] for a in seen), default=None), max((LEVELS[a[3]] for a in seen), default=0.25)
        hops = sum(edge_kinds[:-1])
        definitive = any(a[2] in rules.DEFINITIVE for a in own[root])
        s = (failure - first) / S
        time = 0.0 if s < 0 else 0.3 + 0.2 * s / 5 if s < 5 else 0.5 + 0.5 * (s - 5) / 25 if s < 30 else 1.0 if s <= 300 else max(0.6, 1.0 - 0.3 * (s - 300) / 300)
        distance = 1.0 if definitive else max(0.0, 1 - hops / 5)
        boost = 0.05 * (kind[root] in rules.INTENT_KINDS) + 0.05 * (kind[root] in rules.GITOPS_KINDS) + 0.15 * definitive
        score = round(min(1.0, 0.4 * time + 0.35 * distance + 0.25 * severity + boost), 9)
        key = (-len(path), -score, first, hops, -severity)
        if root not in found or key < found[root][0]:
            found[root] = key, (score, len(path) - 1, first, definitive)

    def walk(path, edge_kinds):
        for to, _, cause in up.get(path[-1], ()):
            if to in path:
                continue
            before = [a for a in own[to] if a[4] <= failure]
            has, hard = any(map(in_context, before)), any(in_context(a) and a[2] not in rules.INTERMEDIATE for a in before)
            managed, refers = any(e == "MANAGES" for _, e, _ in up.get(to, ())), any(e == "REFERENCES_SPEC" for _, e, _ in up.get(to, ()))
            counts = cause or len(path) > 1
            stop = hard and counts and not managed
            longer = [*path, to], [*edge_kinds, cause]
            if stop or (has and not hard and counts):
                end(*longer)
            causes = [a for a in own[to] if plain(a)]
            soft = bool(causes) and all(a[2] in rules.INTERMEDIATE for a in causes)
            if refers if stop else (not cause or not causes or soft):
                if to not in up and len(path) < depth and any(map(plain, before)):
                    end(*longer)
                if len(path) < depth:
                    walk(*longer)

    walk([symptom], [])
    ranked = sorted(found.items(), key=lambda x: (-x[1][1][0], not x[1][1][3], x[1][1][2], -x[1][1][1], x[0]))[:5]
    return [(root, *value[:3]) for root, (_, value) in ranked]


def frames(spark, graphs):
    e, r, a, i = (list(itertools.chain.from_iterable(g[k] for g in graphs)) for k in range(4))
    return (
        spark.createDataFrame(e, "type string, src string, dst string"),
        spark.createDataFrame(r, "uid string, kind string"),
        spark.createDataFrame(a, "uid string, category string, type string, severity string, ts_ns long, summary string"),
        spark.createDataFrame(i, "incident_id string, uid string, t_ns long"),
    )


def got(paths):
    out = {}
    for r in causal.rank_paths(paths).orderBy("rank").collect():
        out.setdefault(r["incident_id"], []).append((r["root"], r["confidence"], len(r["path"]) - 1, r["first_ns"]))
    return out


@pytest.mark.parametrize("depth", [5, 3])
def test_top_paths_of_random_graphs(spark, depth):
    graphs = [graph(s) for s in range(40)]
    found = got(causal.causal_paths(*frames(spark, graphs), depth=depth))
    some = 0
    for edges, resources, anomalies, incidents in graphs:
        for incident in incidents:
            want = brute(edges, resources, anomalies, incident, depth)
            some += len(want)
            assert found.get(incident[0], []) == want, incident
    assert some > 80


def test_dense_graphs_keep_few_labels(spark, monkeypatch):
    graphs = [graph(s, nodes=10, dense=True) for s in range(3)]
    whole, most = causal._pruned, []

    def watched(labels, left, shuffled):
        out = whole(labels, left, shuffled)
        if shuffled:
            out = out.cache()
            steps = out.agg(F.max(F.size("path"))).first()[0]
            n = out.groupBy("incident_id", "at").count().agg(F.max("count")).first()[0]
            most.append((n, causal.most_labels(5, (steps or 2) - 1)))
        return out

    monkeypatch.setattr(causal, "_pruned", watched)
    found = got(causal.causal_paths(*frames(spark, graphs)))
    for edges, resources, anomalies, incidents in graphs:
        for incident in incidents:
            assert found.get(incident[0], []) == brute(edges, resources, anomalies, incident, 5)
    assert len(most) == 4 and all(n is None or n <= bound for n, bound in most)


@pytest.mark.parametrize("seed", range(40))
def test_for_every_continuation_the_best_way_is_kept(seed):
    rnd = random.Random(seed)
    p, left = rnd.randrange(0, 4), rnd.randrange(0, 4)
    ways = [frozenset(rnd.sample(range(9), p)) for _ in range(60)]
    kept = []
    for w in ways:
        if causal.worth_keeping(kept, w, left):
            kept.append(w)
    bound = 1
    for i in range(left):
        bound = bound * (p + i + 1) // (i + 1)
    assert len(kept) <= bound
    for n in range(left + 1):
        for then in itertools.combinations(range(9), n):
            first = next((w for w in ways if not w & set(then)), None)
            assert first == next((w for w in kept if not w & set(then)), None)


def test_services(spark):
    """Without pods, with healthy pods, with a pod whose config map is to blame, and with a failing pod of which nothing is known."""
    edges = [("SELECTS", "s2", "p2"), ("SELECTS", "s3", "p3"), ("REFERENCES_SPEC", "p3", "cm"), ("SELECTS", "s4", "p4"), ("SELECTS", "s5", "p3")]
    resources = [(f"s{i}", "Service") for i in range(1, 6)] + [(f"p{i}", "Pod") for i in (2, 3, 4)] + [("cm", "ConfigMap")]
    bare = lambda s: (s, "State", "NoReadyEndpoints", "high", T * S, "")
    anomalies = [bare("s1"), bare("s2"), bare("s3"), bare("s4"), ("p3", "State", "CrashLoopBackOff", "critical", (T - 5) * S, ""), ("cm", "Change", "ConfigChange", "high", (T - 60) * S, ""), ("p4", "Event", "BackOff", "high", (T - 9) * S, ""), ("s5", "State", "ErrorStatus", "high", T * S, "")]
    incidents = [(f"i{i}", f"s{i}", T * S) for i in range(1, 6)]
    rows = causal.explained(causal.rank_paths(causal.causal_paths(*frames(spark, [(edges, resources, anomalies, incidents)])))).collect()
    assert {(r["incident_id"], r["root"], "<".join(s["uid"] for s in r["path"])) for r in rows} == {("i1", "s1", "s1"), ("i2", "s2", "s2"), ("i3", "cm", "s3<p3<cm"), ("i4", "p4", "s4<p4")}
    best = next(r for r in rows if r["incident_id"] == "i3")
    assert best["explanation"] == "caused by ConfigMap cm -> Pod p3 -> Service s3" and best["n_affected"] == 1 and best["confidence"] == pytest.approx(0.4 + 0.35 + 0.25 + 0, abs=0.06)


def test_anomalies_of_an_incident_each(spark):
    edges, resources, anomalies, incidents = graph(4)
    frame = frames(spark, [(edges, resources, anomalies, incidents)])
    each = frame[2].crossJoin(frame[3].select("incident_id"))
    # What happens around an incident is then said by its own anomalies, not by what a walk can reach.
    assert set(got(causal.causal_paths(frame[0], frame[1], each, frame[3]))) == set(got(causal.causal_paths(*frame)))


def test_nothing_to_find(spark):
    frame = frames(spark, [graph(1)])
    assert causal.causal_paths(*frame[:3], frame[3].limit(0)).count() == 0
    assert causal.causal_paths(*frame[:2], frame[2].limit(0), frame[3]).count() == 0
    assert causal.causal_paths(frame[0].limit(0), *frame[1:]).count() == 0


def test_harmless_neighbours_of_a_hub_are_not_walked(spark, monkeypatch):
    """200 config maps of a hub without anything upstream: only the one that changed is stored by a step."""
    edges = [("OWNS", "hub", "pod")] + [("REFERENCES_SPEC", "hub", f"cm{i}") for i in range(200)]
    resources = [("pod", "Pod"), ("hub", "HelmRelease")] + [(f"cm{i}", "ConfigMap") for i in range(200)]
    anomalies = [("pod", "State", "CrashLoopBackOff", "critical", T * S, ""), ("cm7", "Change", "ImageChanged", "high", (T - 60) * S, "")]
    stored, cut = [], causal.cut

    def counted(df):
        if "emit" in df.columns:
            stored.append(df.count())
        return cut(df)

    monkeypatch.setattr(causal, "cut", counted)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = causal.causal_paths(frame(edges, "type string, src string, dst string"), frame(resources, "uid string, kind string"), frame(anomalies, "uid string, category string, type string, severity string, ts_ns long, summary string"), frame([("i", "pod", T * S)], "incident_id string, uid string, t_ns long"))
    assert [(r["root"], len(r["path"])) for r in got.collect()] == [("cm7", 3)]
    assert max(stored) == 1


def listed(rows):
    return {(r["incident_id"], r["rank"], r["root"], r["root_kind"], r["symptom"], r["confidence"], r["first_ns"], r["first_failure_ns"], r["hops"], r["severity"], r["definitive"], r["n_affected"], r["path_id"], tuple(tuple(s) for s in r["path"])) for r in rows.collect()}


def test_top_paths_are_those_of_the_whole_list(spark):
    """Random graphs, each with a hub whose nodes have many causes with nothing upstream, symptoms of several incidents, and services."""
    graphs = [graph(s) for s in range(30)]
    for s, (edges, resources, anomalies, incidents) in enumerate(graphs):
        rnd = random.Random(s)
        for k in range(12):
            leaf, at = f"{s}/leaf{k}", f"{s}/{rnd.randrange(8)}"
            edges += [("REFERENCES_SPEC", at, leaf)] + [("MOUNTS", leaf, at)] * (k % 4 == 0) + [("REFERENCES_SPEC", f"{s}/{rnd.randrange(8)}", leaf)] * (k % 5 == 0)
            resources.append((leaf, rnd.choice(["ConfigMap", "Secret", "Service"])))
            anomalies.append((leaf, *rnd.choice(TYPES), rnd.choice(list(LEVELS)), (T - rnd.choice([-20, 0, 10, 40, 400, 900])) * S, ""))
        incidents += [(f"{i}-later", u, (t + 300 * S)) for i, u, t in incidents] + [(f"i{s}/{k}", f"{s}/{k}", T * S) for k in range(2, 8)]
        anomalies += [(u, "State", "NoReadyEndpoints", "high", T * S, "") for u, kind in resources[:8] if kind == "Service"]
    frame = frames(spark, graphs)
    for depth, n in ((5, 5), (3, 2)):
        want = listed(causal.rank_paths(causal.causal_paths(*frame, depth=depth), n))
        assert listed(causal.top_paths(*frame, depth=depth, n=n)) == want and len(want) > 300


def test_causes_of_a_hub_are_worked_out_once_for_alike_incidents(spark, monkeypatch):
    """300 pods of a hub with 100 changed config maps: 1,500 of the 30,000 pairs are shown, and few are stored."""
    edges = [("OWNS", "hub", f"pod{i}") for i in range(300)] + [("REFERENCES_SPEC", "hub", f"cm{i}") for i in range(100)]
    resources = [(f"pod{i}", "Pod") for i in range(300)] + [("hub", "HelmRelease")] + [(f"cm{i}", "ConfigMap") for i in range(100)]
    anomalies = [(f"cm{i}", "Change", "ImageChanged", "high", (T - i) * S, "") for i in range(100)]
    stored, cut = [], causal.cut

    def counted(df):
        out = cut(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(causal, "cut", counted)
    rows = causal.top_paths(*frames(spark, [(edges, resources, anomalies, [(f"i{k}", f"pod{k}", T * S) for k in range(300)])])).collect()
    assert len(rows) == 1500 and {r["n_affected"] for r in rows} == {300} and max(stored) < 1000

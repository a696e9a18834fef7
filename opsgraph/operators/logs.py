"""Log lines (namespace, pod, container, ts_ns, message): masking, templates, levels, overviews."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.functions.stored import cut, smallest_reached

# Masks in order, from the specific to the general.
MASKS = [
    (r"\b[0-9a-fA-F:]+:[0-9a-fA-F:]+\b", "<IP>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?\b", "<TIMESTAMP>"),
    (r"\b\d{10,13}\b", "<TIMESTAMP>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"\b[0-9a-fA-F]{16,}\b", "<HEX>"),
    (r"\bhttps?://[a-zA-Z0-9.-]+[a-zA-Z0-9/._?=&-]*\b", "<URL>"),
    (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "<EMAIL>"),
    (r"(/[a-zA-Z0-9_.-]+)+", "<PATH>"),
    (r"[A-Z]:\\[a-zA-Z0-9_.\-\\]+", "<PATH>"),
    (r"\b[a-z0-9-]+-[a-z0-9]{8,10}-[a-z0-9]{5}\b", "<K8S_NAME>"),
    (r"\b[a-z0-9-]+-[a-z0-9]{8,10}\b", "<K8S_NAME>"),
]
STATUS_WORDS = "status|code|http|returned|response"
PLACEHOLDERS = ["<*>", "<IP>", "<UUID>", "<TIMESTAMP>", "<HEX>", "<PATH>", "<URL>", "<EMAIL>", "<NUM>", "<K8S_NAME>"]
ERROR = r"(?i)(level=error|ERROR:|Exception|panic:|CrashLoopBackOff|OOMKilled)"
WARNING = r"(?i)(level=warn|WARN:|WARNING:|deprecated|unhealthy)"
MESSAGE_FIELDS = ["message", "msg", "log", "text", "_raw", "event"]


def extract_message(line: Column) -> Column:
    """The first non-empty message field of a JSON line, else the line."""
    fields = [F.nullif(F.get_json_object(line, f"$.{f}"), F.lit("")) for f in MESSAGE_FIELDS]
    return F.when(F.ltrim(line).startswith("{"), F.coalesce(*fields, line)).otherwise(line)


def preprocess(line: Column) -> Column:
    return F.lower(F.trim(extract_message(line)))


def mask_numbers(text: Column) -> Column:
    """Numbers as <NUM>, but for those with a word of status within three tokens. White space becomes single spaces."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    status = lambda t: F.lower(t).rlike(STATUS_WORDS)

    def masked(t: Column, i: Column) -> Column:
        start = F.greatest(i - 3, F.lit(0))
        near = F.slice(tokens, start + 1, i + 4 - start)
        return F.when(t.rlike(r"^[0-9]+$") & ~F.exists(near, status), "<NUM>").otherwise(t)

    return F.array_join(F.transform(tokens, masked), " ")


def aggressive_mask(text: Column) -> Column:
    for pattern, name in MASKS:
        text = F.regexp_replace(text, pattern, name)
    return mask_numbers(text)


def folded(pattern: Column) -> Column:
    """The pattern with every placeholder as <VAR>."""
    return F.regexp_replace(pattern, "|".join(p.replace("*", r"\*") for p in PLACEHOLDERS), "<VAR>")


def template_id(namespace: Column, pattern: Column) -> Column:
    return F.sha2(F.concat(namespace, F.lit("|"), pattern), 256)


def masked_patterns(logs: DataFrame) -> DataFrame:
    """Distinct masked patterns with counts: namespace, pattern, count, first_ns, last_ns."""
    rows = logs.withColumn("pattern", folded(aggressive_mask(preprocess(F.col("message"))))).filter("pattern != ''")
    return rows.groupBy("namespace", "pattern").agg(F.count("*").alias("count"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


WILD = "<*>"
#: Delimiters of tokens besides white space.
DELIMITERS = r"[ _=]+"
#: Patterns of a group that one task clusters at a time; a larger group is dealt out in slots of about as many.
SLOT = 10_000


def _clusters(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Greedy clustering of patterns of one length and start, most frequent first: a pattern joins the most similar template, or opens one.

    A wildcard is like nothing, so templates only grow less similar as they take patterns in. A template has the slot of
    its first pattern.
    """
    rows = rows.sort_values(["count", "pattern"], ascending=[False, True])
    lists = rows["pattern"].str.split(" ")
    width = len(lists.iloc[0])
    codes = pd.factorize(np.array(lists.tolist(), object).ravel())
    wild = np.flatnonzero(codes[1] == WILD)
    own = codes[0].reshape(-1, width)
    own = np.where(own == (wild[0] if len(wild) else -1), -1, own)
    templates = np.zeros_like(own)
    n, joined, first = 0, [], []
    for i, tokens in enumerate(own):
        same = ((templates[:n] == tokens) & (tokens >= 0)).sum(axis=1)
        at = int(same.argmax()) if n else -1
        if n and same[at] / width >= similarity:
            templates[at] = np.where(templates[at] == tokens, tokens, -1)
        else:
            templates[n] = tokens
            at, n = n, n + 1
            first.append(i)
        joined.append(at)
    names = np.append(codes[1].astype(object), WILD)  # -1 is the last
    made = [" ".join(names[t]) for t in templates[:n]]
    out = rows.assign(at=joined).groupby("at", sort=True).agg(count=("count", "sum"), first_ns=("first_ns", "min"), last_ns=("last_ns", "max"))
    heads = rows.iloc[first]
    return out.assign(pattern=made, **{c: heads[c].to_numpy() for c in ("namespace", "n_tokens", "start", "slot")})


def mine_templates(logs: DataFrame, similarity: float = 0.4, leading: int = 1, slot: int = SLOT) -> DataFrame:
    """Templates (namespace, id, pattern, count, first_ns, last_ns).

    Lines are masked and counted first, so what is clustered are the distinct patterns of one namespace, token count and
    leading tokens; there may be any number of templates. A group of more than `slot` patterns is dealt out in slots, which
    are clustered on their own, then their templates are dealt out anew, as long as that shrinks such groups by a tenth.
    At last every two slots of a group that is still too large meet once. As templates grow less similar only, after that
    no two templates of a group are as similar as `similarity`.
    """
    group = ["namespace", "n_tokens", "start"]
    columns = [*group, "slot", "pattern", "count", "first_ns", "last_ns"]
    schema = "namespace string, n_tokens int, start string, slot long, pattern string, count long, first_ns long, last_ns long"
    tokens = F.filter(F.split("pattern", DELIMITERS), lambda t: t != "")
    rows = masked_patterns(logs).withColumn("tokens", F.when(F.size(tokens) > 0, tokens).otherwise(F.array("pattern")))
    rows = rows.select("namespace", F.size("tokens").alias("n_tokens"), F.array_join(F.slice("tokens", 1, leading), " ").alias("start"), F.array_join("tokens", " ").alias("pattern"), "count", "first_ns", "last_ns")
    rows = cut(rows.groupBy(*group, "pattern").agg(F.sum("count").alias("count"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns")))

    def clustered(frame: DataFrame, by: Column) -> DataFrame:
        made = frame.withColumn("meeting", by).groupBy(*group, "meeting").applyInPandas(lambda f: _clusters(f, similarity)[columns], schema)
        return cut(made)

    def slotted(frame: DataFrame, turn: int) -> DataFrame:
        sizes = frame.groupBy(*group).agg(F.ceil(F.count("*") / slot).cast("long").alias("slots"), (F.count("*") == 1).alias("single"))
        joined = frame.alias("f").join(sizes.alias("s"), F.expr(" and ".join(f"f.{c} <=> s.{c}" for c in group)))
        own = F.pmod(F.xxhash64("f.pattern", F.lit(turn)), F.col("s.slots"))
        return cut(joined.select(*[f"f.{c}" for c in group], own.alias("slot"), "f.pattern", "f.count", "f.first_ns", "f.last_ns", "s.slots", "s.single"))

    done, turn, before = [], 0, None
    rows = slotted(rows, turn)
    while True:
        # Groups in one slot are clustered whole; a pattern without others in its group is a template.
        done += [rows.filter("single").select(*columns), clustered(rows.filter("slots = 1 and not single").select(*columns), F.lit(0))]
        rows = rows.filter("slots > 1")
        left = rows.count()
        if not left or (before is not None and left > 0.9 * before):
            break
        before, turn = left, turn + 1
        rows = slotted(clustered(rows.select(*columns), F.col("slot")), turn)
    if left:
        slots = rows.groupBy(*group).agg((F.floor((F.max("slots") + 1) / 2) * 2).alias("even"))
        rows = clustered(rows.select(*columns), F.col("slot"))
        rounds = slots.agg(F.max("even")).first()[0] - 1
        slots = cut(slots)
        for k in range(rounds):
            # A tournament: in round k, slots i and j meet if i + j is k modulo even - 1; the one with i = j meets the last.
            odd, last = F.col("s.even") - 1, F.col("f.slot") == F.col("s.even") - 1
            other = F.pmod(F.lit(k) - F.col("f.slot"), odd)
            half = F.when(F.lit(k) % 2 == 0, F.lit(k) / 2).otherwise((F.lit(k) + odd) / 2).cast("long")
            partner = F.when(last, F.pmod(half, odd)).when(other == F.col("f.slot"), odd).otherwise(other)
            meeting = F.when(F.lit(k) < odd, F.least("f.slot", partner)).otherwise(F.col("f.slot"))
            joined = rows.alias("f").join(slots.alias("s"), F.expr(" and ".join(f"f.{c} <=> s.{c}" for c in group)))
            rows = clustered(joined.select("f.*", meeting.alias("m")), F.col("m"))
        done.append(rows)
    found = reduce(DataFrame.union, done)
    return template_table(found.select("namespace", folded(F.col("pattern")).alias("pattern"), "count", "first_ns", "last_ns"))


def template_table(patterns: DataFrame) -> DataFrame:
    rows = patterns.groupBy("namespace", "pattern").agg(F.sum("count").alias("count"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))
    return rows.select("namespace", template_id(F.col("namespace"), F.col("pattern")).alias("id"), "pattern", "count", "first_ns", "last_ns")


def top_templates(templates: DataFrame, least: int = 0, by: str = "count", n: int | None = None) -> DataFrame:
    rows = templates.filter(F.col("count") >= least).orderBy(F.desc(by), "id")
    return rows if n is None else rows.limit(n)


def rebalance(templates: DataFrame, least: int = 10, similar: float = 0.7) -> DataFrame:
    """Templates of at least `least` lines, similar ones merged: 1 - edit distance / shorter length > similar.

    Pairs are looked for inside a namespace among patterns whose lengths can be near enough: length buckets grow by the
    factor that similarity allows, and a pattern meets its own and the next bucket. Groups are found by passing the
    smallest id along pairs until nothing changes.
    """
    kept = templates.filter(F.col("count") >= least)
    bucket = F.floor(F.log(F.greatest(F.length("pattern"), F.lit(1))) / F.log(F.lit(1 / similar)))
    a = kept.select("namespace", F.col("id").alias("a"), F.col("pattern").alias("pa"), bucket.alias("slot"))
    b = kept.select("namespace", F.col("id").alias("b"), F.col("pattern").alias("pb"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("slot"))
    pairs = a.join(b, ["namespace", "slot"]).filter("a < b")
    near = 1 - F.levenshtein("pa", "pb") / F.least(F.length("pa"), F.length("pb"))
    links = pairs.filter(near > similar).select("a", "b")
    label = smallest_reached(links)
    rows = kept.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    lead = F.max_by("pattern", F.struct("count", "pattern"))
    return rows.groupBy("namespace", "label").agg(lead.alias("pattern"), F.sum("count").alias("count"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns")).select("namespace", template_id(F.col("namespace"), F.col("pattern")).alias("id"), "pattern", "count", "first_ns", "last_ns")


def novel(current: DataFrame, before: DataFrame) -> DataFrame:
    """Current templates with novel: is the pattern absent from the window before?"""
    old = before.select("namespace", "pattern").distinct().withColumn("seen", F.lit(True))
    return current.join(old, ["namespace", "pattern"], "left").withColumn("novel", F.col("seen").isNull()).drop("seen")


def log_patterns(logs: DataFrame, start_ns: int, end_ns: int, n: int = 50) -> DataFrame:
    """The n most frequent patterns of a window: count, novelty against the window before of equal length, a sample line, pods and containers."""
    p = folded(aggressive_mask(preprocess(F.col("message"))))
    rows = logs.filter((F.col("ts_ns") >= 2 * start_ns - end_ns) & (F.col("ts_ns") < end_ns)).withColumn("pattern", p)
    now = F.col("ts_ns") >= start_ns
    agg = rows.groupBy("namespace", "pattern").agg(
        F.count_if(now).alias("count"),
        (F.count_if(~now) == 0).alias("novel"),
        F.min_by(F.when(now, F.col("message")), F.when(now, F.struct("ts_ns", "message"))).alias("sample"),
        F.array_sort(F.collect_set(F.when(now, F.col("pod")))).alias("pods"),
        F.array_sort(F.collect_set(F.when(now, F.col("container")))).alias("containers"),
    )
    return agg.filter("count > 0").orderBy(F.desc("count"), "namespace", "pattern").limit(n)


def log_overview(logs: DataFrame) -> DataFrame:
    """Per namespace: errors, warnings, other lines and all, most errors first."""
    error, warning = F.col("message").rlike(ERROR), F.col("message").rlike(WARNING)
    name = F.when(F.coalesce("namespace", F.lit("")) == "", "(no namespace)").otherwise(F.col("namespace"))
    rows = logs.groupBy(name.alias("namespace")).agg(F.count_if(error).alias("errors"), F.count_if(warning).alias("warnings"), F.count("*").alias("total"))
    return rows.withColumn("other", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("errors") - F.col("warnings"))).orderBy(F.desc("errors"), F.desc("total"), "namespace")


def level(message: Column) -> Column:
    return F.when(message.rlike(ERROR), "error").when(message.rlike(WARNING), "warning").otherwise("info")


def log_search(logs: DataFrame, text: str = "", regex: str = "", n: int = 100, start_ns: int | None = None, end_ns: int | None = None, of_level: str = "", **equal: str) -> DataFrame:
    """The newest n lines (500 at most) of [start, end) that hold the text, match the expression, and have the level and the given namespace, pod, container; truncated: there are more."""
    n = max(1, min(n, 500))
    if start_ns is not None:
        logs = logs.filter(F.col("ts_ns") >= start_ns)
    if end_ns is not None:
        logs = logs.filter(F.col("ts_ns") < end_ns)
    if of_level:
        logs = logs.filter(level(F.col("message")) == of_level)
    for column, value in equal.items():
        logs = logs.filter(F.col(column) == value)
    if text:
        logs = logs.filter(F.contains("message", F.lit(text)))
    if regex:
        logs = logs.filter(F.col("message").rlike(regex))
    order = [F.desc("ts_ns"), F.col("pod"), F.col("container"), F.col("message")]
    top = logs.orderBy(*order).limit(n + 1)
    nth = F.row_number().over(Window.orderBy(*order))  # n + 1 rows at most
    return top.withColumn("nth", nth).withColumn("truncated", F.max("nth").over(Window.partitionBy()) > n).filter(F.col("nth") <= n)


def log_histogram(logs: DataFrame, step_s: int) -> DataFrame:
    step = step_s * 1_000_000_000
    return logs.groupBy((F.floor(F.col("ts_ns") / step) * step).alias("bucket_ns")).agg(F.count("*").alias("n"))


def log_aggregate(logs: DataFrame, by: str) -> DataFrame:
    """Lines per namespace, pod, container or level."""
    return logs.withColumn("level", level(F.col("message"))).groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n"))

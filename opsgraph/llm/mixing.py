"""Mixing sources by temperature, in DataFrame functions only.

A source with share p of all tokens gets the weight p**a / sum(p**a). The exponent a in [0, 1] is found by bisection: the
least at which no source is repeated more than `max_repeats` times, or the one whose weights have a target entropy. Each
job of the bisection evaluates the sums at the exponents that the next five halvings can ask for, over the table of
source totals.

A source's documents are permuted by a hash in every epoch and laid end to end until its budget, weight times the tokens
of the mix, is used up. Positions are running sums in two levels: sums of hash buckets, at most MAX_BUCKETS a source
however large it is, and running sums inside a bucket. Position over budget, times the number of blocks, is the block, so
every block has the weights; inside it documents are permuted again.

Tokens are words: runs without ASCII white space. Null text has none. A null source is a source. Sources without tokens
have weight 0. Rows that share doc_id and text are placed each. Extra columns are ignored, or kept by `mixed`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.llm.common import saved

MAX_BUCKETS = 4096
BUCKET_ROWS = 2000
BLOCK_TOKENS = 1 << 20
HALVINGS = 5


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_totals(rows: DataFrame) -> DataFrame:
    """(source, n_docs, n_tokens, share) of rows (source, n_tokens)."""
    per = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    total = per.agg(F.sum("n_tokens").alias("total"))
    return per.crossJoin(F.broadcast(total)).withColumn("share", F.col("n_tokens") / F.greatest("total", F.lit(1)))  # total is one row


def exponent(totals: DataFrame, max_repeats: float | None = None, entropy: float | None = None, steps: int = 6) -> float:
    """The least exponent that keeps to max_repeats, or the exponent whose weights have the entropy (nats)."""

    def holds(power: Column, a: float) -> list[Column]:
        # sum p**a, sum p**a ln(p**a), max p**(a-1)
        return [F.sum(power), F.sum(power * F.log("share") * a), F.max(power / F.col("share"))]

    lo, hi = 0.0, 1.0
    real = totals.filter("share > 0")
    for _ in range(steps):
        grid = [lo + (hi - lo) * i / 2**HALVINGS for i in range(1, 2**HALVINGS)]
        row = real.agg(*[c.alias(f"x{i}_{k}") for i, a in enumerate(grid) for k, c in enumerate(holds(F.pow("share", F.lit(a)), a))]).first()

        def enough(i: int) -> bool:
            z, s, most = row[f"x{i}_0"], row[f"x{i}_1"], row[f"x{i}_2"]
            if not z:
                return True
            return most / z <= max_repeats if entropy is None else math.log(z) - s / z <= entropy

        low, high = 0, 2**HALVINGS  # both conditions turn true once as the exponent grows
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if enough(mid - 1) else (mid, high)
        lo, hi = lo + (hi - lo) * low / 2**HALVINGS, lo + (hi - lo) * high / 2**HALVINGS
    return hi


def plan(totals: DataFrame, a: float, budget: float | None = None) -> DataFrame:
    """(source, n_docs, n_tokens, weight, quota, epochs, buckets) for an exponent; budget: tokens of the mix, by default all there are."""
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(a))).otherwise(0.0)
    sums = totals.agg(F.sum(power).alias("z"), F.sum("n_tokens").alias("all"))
    rows = totals.crossJoin(F.broadcast(sums)).withColumn("weight", F.coalesce(power / F.nullif("z", F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("quota", F.col("weight") * (F.lit(float(budget)) if budget else F.col("all")))
    epochs = F.ceil(F.col("quota") / F.greatest("n_tokens", F.lit(1))).cast("int")
    buckets = F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("n_docs") / BUCKET_ROWS)).cast("int")
    return rows.select("source", "n_docs", "n_tokens", "weight", "quota", epochs.alias("epochs"), buckets.alias("buckets"))


def placements(docs: DataFrame, max_repeats: float | None = 1.5, entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """Where documents stand in the mix: row, doc_id, source, n_tokens, weight, epoch, block, slot. row: hash of doc_id and text."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), tokens(F.col("text")).alias("n_tokens"))
    rows = saved(rows, "rows")
    totals = saved(source_totals(rows), "totals")
    quotas = saved(plan(totals, exponent(totals, max_repeats, entropy), budget), "quotas")
    mix_tokens = quotas.agg(F.sum("quota")).first()[0] or 0.0
    blocks = max(1, math.ceil(mix_tokens / block_tokens))
    q = quotas.withColumnRenamed("source", "q_source").drop("n_docs", "n_tokens")
    each = rows.join(q, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source")
    each = each.filter("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    each = each.withColumn("order", F.xxhash64(F.lit(seed), "epoch", "row"))
    each = each.withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 40), F.col("buckets")).cast("int"))
    key = ["source", "epoch", "bucket"]
    inside = Window.partitionBy(*key).orderBy("order", "doc_id")
    local = F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    # Epochs come one after another, so those before a bucket are whole.
    sums = each.groupBy(*key).agg(F.sum("n_tokens").alias("held"))
    before = F.sum("held").over(Window.partitionBy("source").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")
    starts = sums.select(*[F.col(k).alias(f"b_{k}") for k in key], before.alias("before"))
    placed = each.withColumn("local", local).join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("epoch") == F.col("b_epoch")) & (F.col("bucket") == F.col("b_bucket")))
    placed = placed.withColumn("at", F.col("before") + F.col("local")).filter(F.col("at") < F.col("quota"))
    placed = placed.withColumn("block", F.floor(F.col("at") / F.col("quota") * blocks).cast("long"))
    slot = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "block", "order"), "doc_id")) - 1
    return placed.select("row", "doc_id", "source", "n_tokens", "weight", "epoch", "block", slot.alias("slot"))


def mixed(docs: DataFrame, **options: float | int | None) -> DataFrame:
    """docs as often as the mix has them, with their own columns only.

    Equal rows were placed each: their placements are dealt out to them in turn, so none is lost or added.
    """
    times = placements(docs, **options).groupBy("row").agg(F.count("*").alias("__times"))
    same = docs.select(F.xxhash64("doc_id", "text").alias("__row"), "*")
    several = same.groupBy("__row").agg(F.count("*").alias("__alike"))
    each = several.join(times, F.col("__row") == F.col("row")).select("row", "__times", "__alike")
    out = same.join(each, F.col("__row") == F.col("row"))
    alone = out.filter("__alike = 1").withColumn("__n", F.col("__times"))
    nth = F.row_number().over(Window.partitionBy("__row").orderBy(F.lit(0)))
    shared = out.filter("__alike > 1").withColumn("__nth", nth).withColumn("__n", F.floor(F.col("__times") / F.col("__alike")) + (F.col("__nth") <= F.col("__times") % F.col("__alike")).cast("long")).drop("__nth")
    placed = alone.unionByName(shared).filter("__n > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns])

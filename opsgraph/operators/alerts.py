"""Alert states and transitions: flapping, time in states, deviation from the usual, categories.

States are (alert, state, ts_ns, seq), transitions (alert, from_state, to_state, ts_ns, seq); seq breaks ties in time.
`as_of_ns` is the clock. Before its first transition an alert is normal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.operators.timeline import duration_text

SECOND_NS = 1_000_000_000
HOUR_NS = 3600 * SECOND_NS
DAY_NS = 24 * HOUR_NS


def rolled_up(instances: DataFrame) -> DataFrame:
    """(alert, state) of instances (alert, instance, state): firing or alerting over pending over normal; normal without instances."""
    rank = F.when(F.col("state").isin("firing", "alerting"), 2).when(F.col("state") == "pending", 1).otherwise(0)
    top = instances.groupBy("alert").agg(F.max(rank).alias("r"))
    return top.select("alert", F.element_at(F.array(F.lit("normal"), F.lit("pending"), F.lit("firing")), F.col("r") + 1).alias("state"))


def transitions(states: DataFrame, keep_days: int = 7) -> DataFrame:
    """Changes of state per alert; unknown before the first, or if the last known state has expired."""
    order = Window.partitionBy("alert").orderBy("ts_ns", "seq")
    prev, at = F.lag("state").over(order), F.lag("ts_ns").over(order)
    known = F.when(F.col("ts_ns") - at <= keep_days * DAY_NS, prev)
    rows = states.withColumn("from_state", F.coalesce(known, F.lit("unknown")))
    return rows.filter(F.col("from_state") != F.col("state")).select("alert", "from_state", F.col("state").alias("to_state"), "ts_ns", "seq")


def transitions_between(moves: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    return moves.filter(F.col("ts_ns").between(start_ns, end_ns)).orderBy("alert", "ts_ns", "seq")


def flappiness(moves: DataFrame, as_of_ns: int, window_h: int = 6) -> DataFrame:
    """(alert, n, score): (1 - e^(-0.15 n)) of the window's transitions, times 1.3, 1.1, 1.0 or 0.8 by how short states last."""
    window = window_h * HOUR_NS
    inside = moves.filter((F.col("ts_ns") >= as_of_ns - window) & (F.col("ts_ns") <= as_of_ns))
    ends = F.coalesce(F.lead("ts_ns").over(Window.partitionBy("alert").orderBy("ts_ns", "seq")), F.lit(as_of_ns))
    rows = inside.withColumn("held", ends - F.col("ts_ns")).groupBy("alert").agg(F.count("*").alias("n"), F.avg("held").alias("held"))
    ratio = F.col("held") / window
    factor = F.when(ratio < 0.1, 1.3).when(ratio < 0.3, 1.1).when(ratio < 0.5, 1.0).otherwise(0.8)
    return rows.select("alert", "n", F.round(F.least(F.lit(1.0), (1 - F.exp(-0.15 * F.col("n"))) * factor), 6).alias("score"))


def intervals(moves: DataFrame, end_ns: int) -> DataFrame:
    """(alert, state, a_ns, b_ns): what state an alert is in from when to when, from its first transition up to end_ns."""
    order = Window.partitionBy("alert").orderBy("ts_ns", "seq")
    rows = moves.filter(F.col("ts_ns") < end_ns)
    return rows.select("alert", F.col("to_state").alias("state"), F.col("ts_ns").alias("a_ns"), F.coalesce(F.lead("ts_ns").over(order), F.lit(end_ns)).alias("b_ns"), F.row_number().over(order).alias("nth"))


def _with_start(moves: DataFrame, end_ns: int, start_ns: int) -> DataFrame:
    """intervals, and the normal one before each alert's first transition."""
    rows = intervals(moves, end_ns)
    before = rows.filter("nth = 1").select("alert", F.lit("normal").alias("state"), F.lit(start_ns).cast("long").alias("a_ns"), F.col("a_ns").alias("b_ns"), F.lit(0).alias("nth"))
    return rows.union(before).filter("b_ns > a_ns")


def state_distribution(moves: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """(alert, state, held_ns, share) of the window; the state at its start is the last one before it, or normal."""
    rows = _with_start(moves, end_ns, start_ns)
    held = F.least("b_ns", F.lit(end_ns)) - F.greatest("a_ns", F.lit(start_ns))
    out = rows.withColumn("held", held).filter("held > 0").groupBy("alert", "state").agg(F.sum("held").alias("held_ns"))
    return out.withColumn("share", F.round(F.col("held_ns") / (end_ns - start_ns), 6))


def rolling_baseline(moves: DataFrame, as_of_ns: int, days: int = 7) -> DataFrame:
    """(alert, mean, stddev, n_days) of the firing share of the last whole days; none with under 24 hours of history.

    Each interval is put on the days it touches, so an alert's work grows with its transitions and days only. Sums and
    squares of nanoseconds are whole numbers, so neither the order of days nor how a half is written decides the sixth
    decimal; halves go up.
    """
    start = as_of_ns - days * DAY_NS
    rows = _with_start(moves, as_of_ns, start).filter(F.col("b_ns") > start)
    first, last = F.greatest(F.lit(0), F.floor((F.col("a_ns") - start) / DAY_NS)), F.least(F.lit(days - 1), F.floor((F.col("b_ns") - 1 - start) / DAY_NS))
    each = rows.filter("state = 'firing'").select("alert", "a_ns", "b_ns", F.explode(F.sequence(first, last)).alias("day"))
    day = F.lit(start) + F.col("day") * DAY_NS
    held = F.least("b_ns", day + DAY_NS) - F.greatest("a_ns", day)
    firing = each.withColumn("held", held).groupBy("alert", "day").agg(F.sum("held").alias("held"))
    grid = moves.filter(F.col("ts_ns") < as_of_ns).groupBy("alert").agg(F.min("ts_ns").alias("first")).filter(F.col("first") <= as_of_ns - DAY_NS)
    whole = F.coalesce("held", F.lit(0)).cast("decimal(18,0)")
    rows = grid.join(firing, "alert", "left").groupBy("alert").agg(F.sum(F.coalesce("held", F.lit(0))).alias("total"), F.sum(whole * whole).alias("squares"))
    # Shares in millionths: a day has 86,400,000 ns for each.
    millionth = DAY_NS // 1_000_000
    mean = F.expr(f"(2 * total + {days * millionth}) div {2 * days * millionth}") / 1_000_000
    spread = F.col("squares") * days - F.col("total").cast("decimal(18,0)") * F.col("total").cast("decimal(18,0)")
    stddev = F.floor(F.sqrt(spread.cast("double") / (days * (days - 1))) / millionth + 0.5) / 1_000_000
    return rows.select("alert", mean.alias("mean"), (stddev if days > 1 else F.lit(None).cast("double")).alias("stddev"), F.lit(days).cast("long").alias("n_days"))


def deviation(current: Column, mean: Column, stddev: Column) -> Column:
    return F.when(F.coalesce(stddev, F.lit(0.0)) == 0, 0.0).otherwise(F.abs(current - mean) / stddev)


def onset(moves: DataFrame, as_of_ns: int) -> DataFrame:
    """(alert, onset): stable-normal without firing in 7 days; new, recent, persistent by first firing; chronic if firing over 80 % of 7 days."""
    week = as_of_ns - 7 * DAY_NS
    first = moves.filter((F.col("to_state") == "firing") & F.col("ts_ns").between(week, as_of_ns)).groupBy("alert").agg(F.min("ts_ns").alias("first"))
    share = state_distribution(moves, week, as_of_ns).filter("state = 'firing'").select("alert", "share")
    rows = moves.filter(F.col("ts_ns") <= as_of_ns).select("alert").distinct().join(first, "alert", "left").join(share, "alert", "left")
    age = F.lit(as_of_ns) - F.col("first")
    named = F.when(F.col("first").isNull(), "stable-normal").when(F.col("share") > 0.8, "chronic").when(age < HOUR_NS, "new").when(age < DAY_NS, "recent").otherwise("persistent")
    return rows.select("alert", named.alias("onset"))


def pattern(moves: DataFrame, as_of_ns: int) -> DataFrame:
    """(alert, pattern): flapping; else by the firing share of the last hour against the six before, if there are two hours of history."""
    firing = lambda a, b, name: state_distribution(moves, a, b).filter("state = 'firing'").select("alert", F.col("share").alias(name))
    now, old = firing(as_of_ns - HOUR_NS, as_of_ns, "now"), firing(as_of_ns - 7 * HOUR_NS, as_of_ns - HOUR_NS, "old")
    rows = moves.filter(F.col("ts_ns") <= as_of_ns).groupBy("alert").agg(F.min("ts_ns").alias("first")).join(now, "alert", "left").join(old, "alert", "left").join(flappiness(moves, as_of_ns), "alert", "left")
    trend = F.coalesce("now", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))
    short = F.lit(as_of_ns) - F.col("first") < 2 * HOUR_NS
    last = moves.filter(F.col("ts_ns") <= as_of_ns).groupBy("alert").agg(F.max(F.struct("ts_ns", "seq", "to_state"))["to_state"].alias("last"))
    named = F.when(F.coalesce("score", F.lit(0.0)) > 0.7, "flapping").when(~short & (trend > 0.2), "trending-worse").when(~short & (trend < -0.2), "trending-better").when(F.col("last") == "firing", "stable-firing").otherwise("stable-normal")
    return rows.join(last, "alert").select("alert", named.alias("pattern"))


def analyze_alerts(moves: DataFrame, as_of_ns: int) -> DataFrame:
    """Per alert: flappiness, deviation of today's firing share, baseline, onset and pattern."""
    today = state_distribution(moves, as_of_ns - DAY_NS, as_of_ns).filter("state = 'firing'").select("alert", F.col("share").alias("firing_share"))
    rows = onset(moves, as_of_ns).join(pattern(moves, as_of_ns), "alert").join(flappiness(moves, as_of_ns), "alert", "left").join(rolling_baseline(moves, as_of_ns), "alert", "left").join(today, "alert", "left")
    share = F.coalesce("firing_share", F.lit(0.0))
    return rows.select("alert", F.coalesce("score", F.lit(0.0)).alias("flappiness"), F.round(deviation(share, F.col("mean"), F.col("stddev")), 6).alias("deviation"), "mean", "stddev", F.col("mean").isNull().alias("insufficient_data"), "onset", "pattern")


def current_states(moves: DataFrame, as_of_ns: int) -> DataFrame:
    last = F.max(F.struct("ts_ns", "seq", "to_state")).alias("m")
    return moves.filter(F.col("ts_ns") <= as_of_ns).groupBy("alert").agg(last).select("alert", F.col("m.to_state").alias("state"), F.col("m.ts_ns").alias("since_ns"))


def alerts_overview(moves: DataFrame, rules: DataFrame, as_of_ns: int) -> DataFrame:
    """Per severity of rules (alert, severity): alerts firing, pending and flapping, and the names of the firing ones."""
    rows = current_states(moves, as_of_ns).filter("state in ('firing', 'pending')").join(rules, "alert").join(flappiness(moves, as_of_ns), "alert", "left")
    count = lambda c: F.count_if(c)
    return rows.groupBy("severity").agg(count(F.col("state") == "firing").alias("firing"), count(F.col("state") == "pending").alias("pending"), count(F.col("score") > 0.7).alias("flapping"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") == "firing", F.col("alert")))), ",").alias("alerts"))


def alerts_aggregated(moves: DataFrame, as_of_ns: int, window_h: int = 1, step_min: int = 10) -> DataFrame:
    """Per alert the state at the end of each step of the window as `[F F N]`, its state, how long it fires, and its transitions.

    As-of by intervals: each interval is put on the steps that end in it.
    """
    step, start = step_min * 60 * SECOND_NS, as_of_ns - window_h * HOUR_NS
    n = window_h * 60 // step_min
    rows = _with_start(moves, as_of_ns + 1, start).filter(F.col("b_ns") > start + step)
    first = F.greatest(F.lit(1), F.ceil((F.col("a_ns") - start) / step))
    last = F.least(F.lit(n), F.ceil((F.col("b_ns") - start) / step) - 1)
    each = rows.filter(last >= first).select("alert", "state", F.explode(F.sequence(first, last)).alias("step"))
    letter = F.upper(F.substring("state", 1, 1))
    strip = each.groupBy("alert").agg(F.array_sort(F.collect_list(F.struct("step", letter.alias("s")))).alias("x")).select("alert", F.concat(F.lit("["), F.array_join(F.col("x.s"), " "), F.lit("]")).alias("timeline"))
    recent = moves.filter((F.col("ts_ns") >= start) & (F.col("ts_ns") <= as_of_ns)).groupBy("alert").agg(F.count("*").alias("n_transitions"))
    now = current_states(moves, as_of_ns)
    held = F.when(F.col("state") == "firing", duration_text((F.lit(as_of_ns) - F.col("since_ns")) / SECOND_NS)).otherwise("")
    return strip.join(now, "alert").join(recent, "alert", "left").select("alert", "timeline", "state", held.alias("firing_for"), F.coalesce("n_transitions", F.lit(0)).alias("n_transitions"))


def alert_details(moves: DataFrame, as_of_ns: int, days: int = 7) -> DataFrame:
    """The transitions of the last days with the time spent in the state before."""
    before = F.lag("ts_ns").over(Window.partitionBy("alert").orderBy("ts_ns", "seq"))
    rows = moves.withColumn("in_previous_s", F.floor((F.col("ts_ns") - before) / SECOND_NS))
    return rows.filter((F.col("ts_ns") >= as_of_ns - days * DAY_NS) & (F.col("ts_ns") <= as_of_ns)).select("alert", "from_state", "to_state", "ts_ns", "in_previous_s")

"""Alerts' firing shares where the sixth decimal is a tie."""

from __future__ import annotations

from fractions import Fraction

from opsgraph.operators import alerts

MS, DAY = 1_000_000, 86_400_000_000_000


def test_rolling_baseline_rounds_halves_up(spark):
    """Firing times of an odd number of 302.4 ms have a mean of so many and a half millionths of seven days."""
    as_of, rows, want = 20 * DAY, [], {}
    for k in range(400):
        held = 302_400_000 * (2 * (k * 1231 + 7) + 1)
        # In three parts on different days, so that sums of doubles end up on either side of the half.
        parts = [held // 3 // 1000 * 1000, held // 5 // 1000 * 1000]
        parts.append(held - sum(parts))
        rows.append((f"a{k}", "unknown", "normal", as_of - 10 * DAY, 0))
        for i, part in enumerate(parts):
            at = as_of - (6 - 2 * i) * DAY + 5 * MS
            rows += [(f"a{k}", "normal", "firing", at, 2 * i + 1), (f"a{k}", "firing", "normal", at + part, 2 * i + 2)]
        want[f"a{k}"] = int(Fraction(held, 7 * DAY) * 10**6 + Fraction(1, 2)) / 10**6
    got = {r["alert"]: r["mean"] for r in alerts.rolling_baseline(spark.createDataFrame(rows, "alert string, from_state string, to_state string, ts_ns long, seq long"), as_of).collect()}
    assert got == want


def test_rolling_baseline_of_an_alert_that_never_fired_is_zero(spark):
    rows = [("quiet", "unknown", "pending", 10 * DAY, 0), ("quiet", "pending", "normal", 15 * DAY, 1), ("loud", "unknown", "firing", 10 * DAY, 0)]
    got = alerts.rolling_baseline(spark.createDataFrame(rows, "alert string, from_state string, to_state string, ts_ns long, seq long"), 20 * DAY)
    assert {r["alert"]: (r["mean"], r["stddev"]) for r in got.collect()}["quiet"] == (0.0, 0.0)

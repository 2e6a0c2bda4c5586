"""Medians by the P-square method (Jain and Chlamtac, 1985): five markers, whatever the number of values.

Only for results that must follow the order of arrival as such an estimator does; features() takes exact medians
otherwise.  An account's values are read in order by one task, so this mode does not spread a hot account.
"""

from __future__ import annotations

import statistics
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the five markers should be, as shares of the count: least, quarter, half, three quarters, most.
SHARES = (0.0, 0.25, 0.5, 0.75, 1.0)


def p_square_median(values: Iterable[float]) -> float:
    """Exact for up to five values; NaN without any.  NaN values don't count."""
    stream = (float(v) for v in values if v == v)
    first = [v for _, v in zip(range(5), stream, strict=False)]
    if len(first) < 5:
        return statistics.median(first) if first else float("nan")
    height, place = sorted(first), [0, 1, 2, 3, 4]
    last = 4  # the place of the newest value
    for v in stream:
        last += 1
        height[0], height[4] = min(height[0], v), max(height[4], v)
        # markers above the value move up by one; a value on the top marker lies below it
        for i in (1, 2, 3):
            place[i] += v < height[i]
        place[4] = last
        for i in (1, 2, 3):
            off = SHARES[i] * last - place[i]
            step = 1 if off >= 1 and place[i + 1] - place[i] > 1 else -1 if off <= -1 and place[i] - place[i - 1] > 1 else 0
            if step:
                height[i] = _moved(height, place, i, step)
                place[i] += step
    return height[2]


def _moved(height: list[float], place: list[int], i: int, step: int) -> float:
    """The height at the next place by a parabola through three markers, or by a line if that breaks their order."""
    below, above = place[i] - place[i - 1], place[i + 1] - place[i]
    up, down = (height[i + 1] - height[i]) / above, (height[i] - height[i - 1]) / below
    curve = height[i] + step * ((below + step) * up + (above - step) * down) / (above + below)
    if height[i - 1] < curve < height[i + 1]:
        return curve
    return height[i] + (up if step > 0 else -down)


def streaming_medians(events: DataFrame) -> DataFrame:
    """account_id, median_outgoing_amount, median_incoming_amount of account_events(), in order of time."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["t", "ord"], kind="stable")
        return pd.DataFrame({"account_id": [g["account_id"].iloc[0]], "median_outgoing_amount": [p_square_median(g.loc[g["out"] == 1, "out_amount"])], "median_incoming_amount": [p_square_median(g.loc[g["inc"] == 1, "in_amount"])]})

    rows = events.select("account_id", "t", "ord", "out", "inc", "out_amount", "in_amount")
    return rows.where(F.col("account_id").isNotNull()).groupBy("account_id").applyInPandas(run, "account_id string, median_outgoing_amount double, median_incoming_amount double")

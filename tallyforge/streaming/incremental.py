"""An extension: cadence kept up to date over a stream of payments."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.operators.cadence import day_gaps, period_of_gaps


def running_cadence(payments: DataFrame, delay: str = "7 days") -> DataFrame:
    """(merchant, payments, period) after each trigger, of distinct events (event_id, ts,
    merchant) that aren't later than the watermark. State holds a merchant's days."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days = dict(zip(*state.get)) if state.exists else {}
        for pdf in batches:
            for day, n in pdf["ts"].dt.date.value_counts().items():
                days[day.toordinal()] = days.get(day.toordinal(), 0) + int(n)
        order = sorted(days)
        state.update((order, [days[d] for d in order]))
        found = day_gaps([(datetime.date.fromordinal(d), days[d]) for d in order])
        yield pd.DataFrame({"merchant": [key[0]], "payments": [sum(days.values())], "period": [period_of_gaps(found)]})

    rows = payments.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return rows.groupBy("merchant").applyInPandasWithState(update, "merchant string, payments long, period string", "days array<long>, n array<long>", "append", GroupStateTimeout.NoTimeout)

"""Counters of a run: totals gathered while a plan runs, in batches and on streams, without a second pass over the rows."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Counters:
    """Named totals of places in a plan.

    watch() marks a place; values() gives the totals once an action has run all of it. A place that several actions run is counted
    in the first. Rows below a shuffle by ranges run twice, once for its sample, and would count twice: watch them on their way into
    a written table. Totals are whole numbers; a place that saw no rows has zeros.
    """

    def __init__(self) -> None:
        self._held: dict[str, Observation] = {}

    def watch(self, df: DataFrame, place: str, **totals: Column) -> DataFrame:
        """df, with totals (sums of these columns; rows, if none are given) gathered as it runs."""
        if place in self._held:
            raise ValueError(f"{place} is watched already")
        self._held[place] = Observation(place)
        sums = totals or {"rows": F.lit(1)}
        return df.observe(self._held[place], *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in sums.items()))

    def values(self) -> dict[str, dict[str, int]]:
        """Place to totals. Waits for places whose plans haven't run."""
        return {place: {k: int(v) for k, v in o.get.items()} for place, o in self._held.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """place, counter and n."""
        rows = [(place, k, v) for place, totals in self.values().items() for k, v in totals.items()]
        return spark.createDataFrame(rows, "place string, counter string, n long")


def watch_stream(df: DataFrame, place: str, **totals: Column) -> DataFrame:
    """A stream whose totals of each micro-batch go to the session's listeners, such as StreamCounters."""
    sums = totals or {"rows": F.lit(1)}
    return df.observe(place, *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in sums.items()))


class StreamCounters(StreamingQueryListener):
    """Adds up the totals of watched places over the micro-batches of all queries of a session.

    A batch that is run again after a failure reports under the same number, and replaces what it has reported before.
    """

    def __init__(self) -> None:
        self._batches: dict[tuple, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for place, row in event.progress.observedMetrics.items():
            self._batches[str(event.progress.id), event.progress.batchId, place] = {k: int(v or 0) for k, v in row.asDict().items()}

    def values(self) -> dict[str, dict[str, int]]:
        out: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for (_, _, place), totals in self._batches.items():
            for k, v in totals.items():
                out[place][k] += v
        return {p: dict(t) for p, t in out.items()}

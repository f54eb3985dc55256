"""Resumable roll-ups: the last report of each question is state, and only what it changes goes on.

Reports may come twice, late, in any order or again after a restart; a question counts by its latest report.
What a report changes is a row of differences, so a board is a sum of differences and is never computed again
from all reports.  With ``keep_ms``, state of a question that no report has touched for so long expires; a further report of
it is then taken as new, so it must be longer than reports can be late.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scorewright.streaming.board import KEY, QUESTION, write_batches

LAST = "at long, mode string, max_points double, awarded double"
CHANGES = "entry_id string, subset string, run_index int, question_id string, questions long, awarded double, max_points double, judged long"
CHANGES_NAMES = [c.split(" ")[0] for c in CHANGES.split(", ")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _order(r) -> tuple:
    """Which of two reports counts: the later one, of equal times the one with more points."""
    return (r.at, r.awarded if r.awarded is not None else float("-inf"), r.max_points or 0.0, r.mode or "")


class LastReport(StatefulProcessor):
    """Keeps a question's last report; emits the differences that a later one makes."""

    def __init__(self, keep_ms: int | None = None):
        self._keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", LAST, *([self._keep] if self._keep else []))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = Row(*[n.split(" ")[0] for n in LAST.split(", ")])(*self._last.get()) if self._last.exists() else None
        best = before
        for r in rows:
            if r.at is not None and (best is None or _order(r) > _order(best)):
                best = r
        if best is before:
            return
        self._last.update((best.at, best.mode, best.max_points, best.awarded))
        of = lambda r: (1, r.awarded or 0.0, r.max_points or 0.0, int(r.mode == "judge")) if r is not None else (0, 0.0, 0.0, 0)
        old, new = of(before), of(best)
        yield Row(*CHANGES_NAMES)(*key, *(n - o for n, o in zip(new, old, strict=True)))

    def close(self) -> None:
        pass


def changes(rows: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Differences that arriving reports (``board.QUESTION``) make; a report that changes nothing makes no row.

    The state store must be the one that ``PROVIDER`` names.  With ``keep_ms`` time goes on without data, so the query must
    run on: under the trigger availableNow it would not end.
    """
    timed = rows.withColumn("at", F.unix_micros("graded_at"))
    return timed.groupBy(*KEY).transformWithState(LastReport(keep_ms), CHANGES, outputMode="Append", timeMode="ProcessingTime" if keep_ms else "None")


def start(spark: SparkSession, source: str, path: str, checkpoint: str) -> StreamingQuery:
    """Take the reports that are new below ``source``, add their differences to the table at ``path`` and stop.

    A batch that is done again after a failure replaces its own rows; the state of the last whole batch is in ``checkpoint``.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = changes(spark.readStream.schema(QUESTION).json(source))
    return rows.writeStream.foreachBatch(write_batches(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def rolled_up(table: DataFrame, by: tuple[str, ...] = ("entry_id", "subset")) -> DataFrame:
    """Questions, points and judged questions of each group from the table of differences."""
    return table.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("questions", "judged")), *(F.round(F.sum(c), 6).alias(c) for c in ("awarded", "max_points")))


def compacted(table: DataFrame) -> DataFrame:
    """The table with one row per question: differences add up, so the sums stay."""
    return table.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in ("questions", "awarded", "max_points", "judged")))


def batch_result(rows: DataFrame, by: tuple[str, ...] = ("entry_id", "subset")) -> DataFrame:
    """The same from all reports at once: the latest of each question."""
    order = F.struct("graded_at", F.coalesce("awarded", F.lit(float("-inf"))).alias("a"), F.coalesce("max_points", F.lit(0.0)).alias("m"), F.coalesce("mode", F.lit("")).alias("d"))
    last = rows.where("graded_at IS NOT NULL").groupBy(*KEY).agg(F.max_by(F.struct("mode", "max_points", "awarded"), order).alias("x")).select(*KEY, "x.*")
    zero = lambda c: F.round(F.sum(F.coalesce(c, F.lit(0.0))), 6).alias(c)
    return last.groupBy(*by).agg(F.count("*").alias("questions"), F.count_if(F.col("mode") == "judge").alias("judged"), zero("awarded"), zero("max_points"))

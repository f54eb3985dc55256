"""Roll-ups that resume: replayed, late, doubled and corrected reports give the batch result."""

from __future__ import annotations

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from scorewright.streaming import board, resume


def test_resumed_roll_ups_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    source, table, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)

    def report(hour):
        entry, subset = rng.choice("abc"), rng.choice(["law", "art"])
        awarded = rng.choice([None, 0.5, 1.0, 2.0])
        return (entry, subset, rng.randrange(1, 3), f"q{rng.randrange(5)}", rng.choice(["judge", "deterministic", "error"]), 2.0, awarded, at(hour))

    everything = []
    for day in range(3):
        new = [report(10 * day + rng.randrange(12)) for _ in range(60)]  # days overlap: some are late
        new += rng.sample(new, 10)  # doubled
        new += rng.sample(everything, min(15, len(everything)))  # replayed
        new.append(("a", "law", 1, "q9", None, None, None, None))  # without a time: left out
        everything += new
        spark.createDataFrame(new, board.QUESTION).coalesce(2).write.mode("append").json(source)
        resume.start(spark, source, table, mark).awaitTermination()
        got = spark.read.parquet(table)
        want = resume.batch_result(spark.createDataFrame(everything, board.QUESTION))
        assert sorted(map(tuple, resume.rolled_up(got).collect())) == sorted(map(tuple, want.collect()))
    changed = got.count()
    resume.start(spark, source, table, mark).awaitTermination()  # nothing new
    assert spark.read.parquet(table).count() == changed < len(everything)
    small = resume.compacted(spark.read.parquet(table))
    assert small.count() == len({r[:4] for r in everything}) - 1 and sorted(map(tuple, resume.rolled_up(small).collect())) == sorted(map(tuple, want.collect()))


def test_state_expires(spark, tmp_path):
    """A question's report makes a row once, and once more when its state has gone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", resume.PROVIDER)
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    one = spark.createDataFrame([("a", "law", 1, "q", "judge", 2.0, 1.0, dt.datetime(2026, 1, 1))], board.QUESTION)
    one.write.mode("append").json(source)
    rows = resume.changes(spark.readStream.schema(board.QUESTION).json(source), 3000)
    query = rows.writeStream.foreachBatch(board.write_batches(table)).option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="1 second").start()

    def wait(n):
        for _ in range(60):
            time.sleep(1)
            assert query.exception() is None
            try:
                if spark.read.parquet(table).count() >= n:
                    return True
            except Exception:  # nothing is written yet
                continue
        return False

    try:
        assert wait(1)
        time.sleep(5)
        one.withColumn("graded_at", F.col("graded_at")).write.mode("append").json(source)
        assert wait(2)
    finally:
        query.stop()
    assert resume.rolled_up(spark.read.parquet(table)).first().questions == 2

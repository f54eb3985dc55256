"""Rubric verdicts: snapping to levels, combination of judges, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.functions import scoring as S

VERDICT = ["run_id", "question_id", "judge"]


def snap(verdicts: DataFrame, scores: DataFrame, rubric: DataFrame, limits: DataFrame) -> DataFrame:
    """Verdicts forced onto the rubric's levels.

    verdicts: VERDICT, total; scores: VERDICT, pos, criterion_id, points; rubric: question_id,
    criterion_id, levels array<double>; limits: question_id, max_points, min_points.  The last of
    repeated criteria counts, unknown ones do not, an omitted one has min(lowest level, 0); without a
    rubric the total is clamped.  Returns VERDICT, raw_total, total, changed.
    """
    last = scores.groupBy(*VERDICT, "criterion_id").agg(F.max_by("points", "pos").alias("points"))
    wanted = verdicts.join(limits, "question_id").join(rubric, "question_id", "left")
    met = wanted.join(last, [*VERDICT, "criterion_id"], "left")
    level = F.when(F.col("points").isNull(), F.least(F.array_min("levels"), F.lit(0.0))).otherwise(S.nearest_level(F.col("levels"), F.col("points")))
    snapped = met.withColumn("snapped", F.when(F.col("criterion_id").isNotNull(), level))
    moved = F.col("criterion_id").isNotNull() & (F.col("points").isNull() | (F.col("points") != F.col("snapped")))
    out = snapped.groupBy(*VERDICT).agg(
        F.first("total").alias("raw_total"),
        F.sum("snapped").alias("sum"),
        F.first("max_points").alias("high"),
        F.first("min_points").alias("low"),
        F.max(moved).alias("moved"),
    )
    total = S.clamp(F.coalesce("sum", "raw_total"), F.col("low"), F.col("high"))
    return out.select(*VERDICT, "raw_total", total.alias("total"), (F.col("moved") | (total != F.col("raw_total"))).alias("changed"))


def unknown_criteria(scores: DataFrame, rubric: DataFrame) -> DataFrame:
    return scores.join(rubric, ["question_id", "criterion_id"], "left_anti")


def combine(verdicts: DataFrame, how: str = "mean") -> DataFrame:
    """run_id, question_id, awarded over judges: mean, median, min or max of ``total``."""
    way = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}[how]
    return verdicts.groupBy("run_id", "question_id").agg(way("total").alias("awarded"))


def agreement(verdicts: DataFrame, limits: DataFrame) -> DataFrame:
    """Per run and question: judges, spread, sample deviation (0 under two), share of the maximum, unanimous."""
    per = verdicts.groupBy("run_id", "question_id").agg(
        F.count("*").alias("judge_count"),
        (F.max("total") - F.min("total")).alias("spread"),
        F.coalesce(F.stddev_samp("total"), F.lit(0.0)).alias("stdev"),
    )
    return per.join(limits.select("question_id", "max_points"), "question_id").select(
        "run_id",
        "question_id",
        "judge_count",
        "spread",
        "stdev",
        F.when(F.col("max_points") != 0, F.try_divide("spread", "max_points")).otherwise(0.0).alias("normalized_spread"),
        (F.abs("spread") <= 1e-9).alias("unanimous"),
    )


def agreement_summary(per_question: DataFrame) -> DataFrame:
    """One row per run that was judged; spreads are over questions with two judges or more."""
    multi = F.col("judge_count") >= 2
    return per_question.groupBy("run_id").agg(
        F.count("*").alias("judged_questions"),
        F.count_if(multi).alias("multi_judge_questions"),
        F.count_if(multi & ~F.col("unanimous")).alias("disagreed_questions"),
        F.coalesce(F.avg(F.when(multi, F.col("spread"))), F.lit(0.0)).alias("mean_spread"),
        F.coalesce(F.max(F.when(multi, F.col("spread"))), F.lit(0.0)).alias("max_spread"),
        F.coalesce(F.avg(F.when(multi, F.col("normalized_spread"))), F.lit(0.0)).alias("mean_normalized_spread"),
    )


def judge_means(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("run_id", "judge").agg(F.avg("total").alias("mean"), F.count("*").alias("verdicts"))


def verdict_problems(scores: DataFrame, rubric: DataFrame) -> DataFrame:
    """Verdicts whose criteria are not exactly the rubric's: missing, unknown and repeated ids."""
    wanted = rubric.groupBy("question_id").agg(F.array_sort(F.collect_set("criterion_id")).alias("wanted"))
    given = scores.groupBy(*VERDICT).agg(F.array_sort(F.collect_set("criterion_id")).alias("given"), F.count("*").alias("n"))
    return given.join(wanted, "question_id").select(
        *VERDICT,
        F.array_except("wanted", "given").alias("missing"),
        F.array_except("given", "wanted").alias("unknown"),
        (F.col("n") > F.size("given")).alias("repeated"),
    ).where("size(missing) > 0 OR size(unknown) > 0 OR repeated")


def leniency(verdicts: DataFrame) -> DataFrame:
    """Mean deviation of each judge from the mean of all judges of the same answer."""
    panel = F.avg("total").over(Window.partitionBy("run_id", "question_id"))
    return verdicts.withColumn("off", F.col("total") - panel).groupBy("judge").agg(F.avg("off").alias("leniency"))


def zipped_verdicts(rows: DataFrame) -> DataFrame:
    """Verdicts of a report with their judges, by position: run_id, question_id, pos, judge, total, rationale, scores, problem.

    rows: run_id, question_id, judge_models array<string>, judge_verdicts array<string> (JSON objects with total_points,
    rationale, criteria).  The shorter list ends both.  A verdict that is no object or has no finite total is a row with a
    problem and no total; criteria without an id or points are left out of scores and named as a problem.  So a broken
    verdict costs its own question nothing but itself, and other questions nothing.
    """
    n = F.least(F.size("judge_models"), F.size("judge_verdicts"))
    both = F.arrays_zip(F.slice("judge_models", F.lit(1), n).alias("judge"), F.slice("judge_verdicts", F.lit(1), n).alias("text"))
    at = rows.where(n > 0).select("run_id", "question_id", F.posexplode(both).alias("pos", "z")).select("run_id", "question_id", "pos", "z.judge", F.try_parse_json("z.text").alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    total = get("$.total_points", "double")
    total = F.when(F.abs(total) < float("inf"), total)
    criteria = F.coalesce(get("$.criteria", "array<variant>"), F.array().cast("array<variant>"))
    scores = F.transform(criteria, lambda c: F.struct(F.try_variant_get(c, "$.id", "string").alias("id"), F.try_variant_get(c, "$.points", "double").alias("points")))
    read = at.select("run_id", "question_id", "pos", "judge", total.alias("total"), get("$.rationale", "string").alias("rationale"), scores.alias("all"), F.col("v").isNull().alias("lost"))
    good = F.filter("all", lambda c: c["id"].isNotNull() & c["points"].isNotNull())
    problem: Column = F.when(F.col("lost"), "not readable").when(F.col("total").isNull(), "no total").when(F.size(good) < F.size("all"), "bad criteria")
    return read.select("run_id", "question_id", "pos", "judge", "total", "rationale", good.alias("scores"), problem.alias("problem"))


def judge_means_by_position(rows: DataFrame) -> DataFrame:
    """Mean total of each judge over a run's readable verdicts: run_id, judge, mean, verdicts."""
    return judge_means(zipped_verdicts(rows).where("total IS NOT NULL"))

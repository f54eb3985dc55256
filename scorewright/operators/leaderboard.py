"""Leaderboards over papers of entries: eligibility, averages, cost, spread, frontier, grouping.

papers: entry_id, subset, ok_runs, and per class (deterministic_, judge_) awarded, covered_max,
questions, skipped; solve_secs, output_tokens; awarded_samples, det_awarded_samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.functions.scoring import percent_or_null
from scorewright.functions.text import floor5, effort_rank, short_subject, split_model

z = lambda c: F.coalesce(F.col(c), F.lit(0.0))


def selection(meta: DataFrame, subsets: DataFrame | None = None, det_only: bool = False) -> DataFrame:
    """Selected papers; with ``det_only`` those without rule-graded points are left out first."""
    chosen = meta if subsets is None else meta.join(subsets, "subset", "left_semi")
    return chosen.where("deterministic_points > 0") if det_only else chosen


def score_entries(papers: DataFrame, chosen: DataFrame, det_only: bool = False, cost: str = "solve_secs", per_question: bool = False) -> DataFrame:
    """One row per entry over the chosen papers.

    micro: points over points; macro: mean of paper percentages; spread: sample deviation of
    run totals if every paper has the same number of ok runs, at least two.  An entry
    without an ok run on any chosen paper is not eligible.
    """
    wanted = chosen.select("subset").distinct()
    a, m = z("deterministic_awarded"), z("deterministic_covered_max")
    if not det_only:
        a, m = a + z("judge_awarded"), m + z("judge_covered_max")
    asked = z("deterministic_questions") - z("deterministic_skipped") + z("judge_questions") - z("judge_skipped")
    rows = papers.where("ok_runs > 0").join(wanted, "subset", "left_semi").select(
        "entry_id", "subset", "ok_runs", a.alias("a"), m.alias("m"), asked.alias("asked"), z(cost).alias("cost"), F.col("det_awarded_samples" if det_only else "awarded_samples").alias("samples")
    )
    per = rows.groupBy("entry_id").agg(
        F.count_distinct("subset").alias("papers"),
        F.sum("a").alias("awarded"),
        F.sum("m").alias("covered_max"),
        F.sum("asked").alias("questions"),
        F.sum("cost").alias("cost"),
        F.avg(percent_or_null(F.col("a"), F.col("m"))).alias("macro"),
        F.min("ok_runs").alias("least_runs"),
        F.max("ok_runs").alias("most_runs"),
    )
    totals = (
        rows.select("entry_id", F.posexplode(F.slice("samples", F.lit(1), F.col("ok_runs").cast("int"))).alias("run", "sample"))
        .groupBy("entry_id", "run")
        .agg(F.sum("sample").alias("total"))
        .groupBy("entry_id")
        .agg(F.stddev_samp("total").alias("dev"))
    )
    n = wanted.agg(F.count("*").alias("wanted"))
    same = (F.col("least_runs") == F.col("most_runs")) & (F.col("least_runs") >= 2)
    out = per.join(totals, "entry_id", "left").join(F.broadcast(n))  # one row
    return out.select(
        "entry_id",
        "papers",
        ((F.col("papers") == F.col("wanted")) & (F.col("papers") > 0)).alias("eligible"),
        "awarded",
        "covered_max",
        "questions",
        percent_or_null(F.col("awarded"), F.col("covered_max")).alias("micro"),
        "macro",
        (F.when(F.col("questions") > 0, F.col("cost") / F.col("questions")).otherwise(F.col("cost")) if per_question else F.col("cost")).alias("cost"),
        F.when(same, F.when(F.col("covered_max") > 0, 100.0 * F.col("dev") / F.col("covered_max")).otherwise(0.0)).alias("spread"),
    )


def ranked(scores: DataFrame, score: str = "micro") -> DataFrame:
    """Eligible entries by score, null last as -1, ties by id.  Ranking is global, over entries alone."""
    order = Window.orderBy(F.coalesce(F.col(score), F.lit(-1.0)).desc(), "entry_id")
    return scores.where("eligible").withColumn("rank", F.row_number().over(order))


#: Ranges of cost over which running maxima are spread.
RANGES = 256


def running_best(scores: DataFrame, score: str = "score", cost: str = "cost", ranges: int = RANGES) -> DataFrame:
    """Per distinct cost: _cost, _top (best score at it), _before (best at all lower costs, null at the lowest).

    Costs are cut into ranges at approximate quantiles, a bounded list of numbers; each range has its running maximum
    in its own task, and the maxima of whole ranges, one row each, give what lies before.
    """
    tops = scores.groupBy(F.col(cost).alias("_cost")).agg(F.max(score).alias("_top"))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = tops.agg(F.percentile_approx("_cost", F.array(*map(F.lit, steps)), 10_000)).first()[0] or []
    kind = tops.schema["_cost"].dataType
    cuts = F.array(*(F.lit(x).cast(kind) for x in sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    at = tops.withColumn("_range", F.size(F.filter(cuts, lambda x: x < F.col("_cost"))))
    whole = at.groupBy("_range").agg(F.max("_top").alias("_most"))
    lower = F.max("_most").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # at most ``ranges`` rows
    inside = F.max("_top").over(Window.partitionBy("_range").orderBy("_cost").rowsBetween(Window.unboundedPreceding, -1))
    met = at.join(F.broadcast(whole.select("_range", lower.alias("_lower"))), "_range").withColumn("_inside", inside)
    return met.select("_cost", "_top", F.greatest("_inside", "_lower").alias("_before"))


def _usable(scores: DataFrame, score: str, cost: str) -> DataFrame:
    return scores.where(F.col(score).isNotNull() & (F.col(cost) > 0))


def pareto(scores: DataFrame, score: str = "score", cost: str = "cost") -> DataFrame:
    """Rows that none beats on both axes: best of their cost, and above all that cost less."""
    usable = _usable(scores, score, cost)
    lead = running_best(usable, score, cost).where("_before IS NULL OR _top > _before")
    return usable.join(lead, (F.col(cost) == F.col("_cost")) & (F.col(score) == F.col("_top")), "left_semi")


def dominance(scores: DataFrame, score: str = "score", cost: str = "cost") -> DataFrame:
    """Every usable row with what beats it: 'cheaper' (at least its score for less), else 'equal cost', null on the frontier."""
    usable = _usable(scores, score, cost)
    met = usable.join(running_best(usable, score, cost), F.col(cost) == F.col("_cost"))
    by = F.when(F.col("_before") >= F.col(score), "cheaper").when(F.col("_top") > F.col(score), "equal cost")
    return met.withColumn("beaten_by", by).drop("_cost", "_top", "_before")


def common_papers(papers: DataFrame) -> DataFrame:
    """Papers that every entry sat; all papers if there is none."""
    sat = papers.where("ok_runs > 0")
    n = sat.agg(F.count_distinct("entry_id").alias("n"))
    per = sat.groupBy("subset").agg(F.count_distinct("entry_id").alias("entries")).join(F.broadcast(n))  # one row
    some = per.where("entries = n").agg(F.count("*").alias("some"))
    return per.join(F.broadcast(some)).where("entries = n OR some = 0").select("subset")


def effort_lines(scores: DataFrame) -> DataFrame:
    """Place of each entry along its model's effort dial, and whether it is an end of the line."""
    w = Window.partitionBy("model")
    order = w.orderBy(effort_rank(F.col("effort")), "entry_id")
    return scores.withColumn("step", F.row_number().over(order)).withColumn("line_end", (F.col("step") == 1) | (F.col("step") == F.count("*").over(w)))


def by_exam(papers: DataFrame, exams: DataFrame) -> DataFrame:
    """Points-weighted percentage per entry and exam; groups without a paper are null.  exams: subset, exam."""
    a, m = z("deterministic_awarded") + z("judge_awarded"), z("deterministic_covered_max") + z("judge_covered_max")
    sums = papers.where("ok_runs > 0").join(exams.select("subset", F.coalesce("exam", F.lit("other")).alias("exam")), "subset").groupBy("entry_id", "exam").agg(F.sum(a).alias("awarded"), F.sum(m).alias("covered_max"))
    every = papers.select("entry_id").distinct().join(F.broadcast(exams.select(F.coalesce("exam", F.lit("other")).alias("exam")).distinct()))
    return every.join(sums, ["entry_id", "exam"], "left").na.fill(0.0, ["awarded", "covered_max"]).withColumn("percentage", percent_or_null(F.col("awarded"), F.col("covered_max")))


def radar(papers: DataFrame, subsets: list[str]) -> DataFrame:
    """One column of percentages per paper, null where the entry has none."""
    a, m = z("deterministic_awarded") + z("judge_awarded"), z("deterministic_covered_max") + z("judge_covered_max")
    return papers.withColumn("pct", percent_or_null(a, m)).groupBy("entry_id").pivot("subset", subsets).agg(F.first("pct"))


def display_names(models: DataFrame) -> DataFrame:
    """The bare model name unless two models share it."""
    named = models.select("model").distinct().withColumn("bare", split_model(F.col("model"))["name"])
    shared = F.count("*").over(Window.partitionBy("bare"))
    return named.select("model", F.when(shared > 1, F.col("model")).otherwise(F.col("bare")).alias("name"))


def axis_names(subsets: DataFrame) -> DataFrame:
    """Short paper names, with the exam before those that repeat."""
    named = subsets.select("subset").withColumn("short", short_subject(F.col("subset")))
    exam = F.split("subset", "-")[0]
    twice = (F.count("*").over(Window.partitionBy("short")) > 1) & (exam != "") & (exam != F.col("subset"))
    return named.select("subset", F.when(twice, F.concat_ws(" ", exam, "short")).otherwise(F.col("short")).alias("name"))


def step_frontier(scores: DataFrame, score: str = "score", cost: str = "cost") -> DataFrame:
    """Running maximum of the score along the cost; rows of one cost share it."""
    usable = _usable(scores, score, cost)
    best = running_best(usable, score, cost).select("_cost", F.greatest("_top", "_before").alias("best_so_far"))
    return usable.join(best, F.col(cost) == F.col("_cost")).drop("_cost")


def board_markdown(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """The board as one Markdown text; for a board's top, as it gathers all its rows."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", cells.alias("line")))), lambda x: x["line"]), "\n")
    return numbered.agg(F.concat(F.lit(head), lines).alias("markdown"))


def dropped_papers(papers: DataFrame) -> DataFrame:
    """Papers without deterministic points, which a board of deterministic points leaves out."""
    return papers.groupBy("subset").agg(F.max(F.coalesce("deterministic_covered_max", F.lit(0.0))).alias("most")).where("most <= 0").select("subset")


def selected_papers(papers: DataFrame, wanted: DataFrame, det_only: bool = False) -> DataFrame:
    """Papers of a selection (subset), without those that a board of deterministic points drops."""
    out = papers.join(wanted.select("subset").distinct(), "subset", "left_semi")
    return out.join(dropped_papers(papers), "subset", "left_anti") if det_only else out


def unknown_subsets(wanted: DataFrame, papers: DataFrame) -> DataFrame:
    """Selected subsets that no paper has."""
    return wanted.select("subset").distinct().join(papers.select("subset").distinct(), "subset", "left_anti")


def score_floor(least: Column) -> Column:
    """Where a score axis begins: the five below the least score, at most 80."""
    return F.least(floor5(least), F.lit(80.0))


def stub_numbers(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Number of each row within its group, given before any filter, so that filters do not move it."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def judges_seen(papers: DataFrame, by: str, order: str, judges: str = "judge_models") -> DataFrame:
    """Distinct judges of each entry in the order in which its papers name them."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(order, judges))), lambda x: x[judges])
    return papers.groupBy(by).agg(F.array_distinct(F.flatten(lists)).alias("judges"))

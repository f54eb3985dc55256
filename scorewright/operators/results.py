"""Roll-ups: point buckets, bench summaries, papers, entries, the index and its upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.functions.scoring import percent_or_null
from scorewright.functions.text import slugify

CLASSES = ("deterministic", "judge")
USAGE = ("requests", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens")
COUNTERS = ("questions", "max_points", "skipped_points", "covered_max", "awarded", "full_credit", "unanswered", "errored", "skipped")


def rule_class(kind: Column) -> Column:
    """Which half of the score a rule's kind belongs to; an unknown rule is deterministic."""
    return F.when(F.coalesce(kind, F.lit("")) == "judge", "judge").otherwise("deterministic")


def class_from_mode(mode: Column) -> Column:
    """Fallback without rules: judged questions that failed fall into the wrong half."""
    return F.when(mode == "judge", "judge").otherwise("deterministic")


def classify_points(results: DataFrame, by: tuple[str, ...] = ("run_id",), rule: Column | None = None) -> DataFrame:
    """Buckets of both classes for each run, also when one is empty.

    results: ``by``, kind (or ``rule`` gives the class), mode, max_points, awarded.
    """
    rule = rule_class(F.col("kind")) if rule is None else rule
    mode, out = F.col("mode"), []
    for c in CLASSES:
        here = F.col("class") == c
        pts = lambda cond, col: F.round(F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0.0)), 6)
        cells = {
            "questions": F.count_if(here),
            "max_points": pts(here, "max_points"),
            "skipped_points": pts(here & (mode == "skipped"), "max_points"),
            "awarded": pts(here, "awarded"),
            "full_credit": F.count_if(here & (F.col("max_points") > 0) & (F.col("awarded") >= F.col("max_points") - 1e-9)),
            "unanswered": F.count_if(here & (mode == "unanswered")),
            "errored": F.count_if(here & (mode == "error")),
            "skipped": F.count_if(here & (mode == "skipped")),
        }
        cells["covered_max"] = F.round(cells["max_points"] - cells["skipped_points"], 6)
        out.append(F.struct(F.lit(c).alias("class"), *(cells[k].alias(k) for k in COUNTERS)))
    per = results.withColumn("class", rule).groupBy(*by).agg(F.array(*out).alias("buckets"))
    return per.select(*by, F.inline("buckets"))


def row_tokens(solve: Column, grade: Column) -> Column:
    return F.coalesce(solve, F.lit(0)) + F.coalesce(grade, F.lit(0))


def summarize_models(rows: DataFrame, value: str = "awarded", percent: str = "covered_percentage") -> DataFrame:
    """One row per model: attempts, ok runs, means (nulls skipped) and sample deviations over ok runs."""
    ok = F.col("status") == "ok"
    of = lambda c: F.when(ok, F.col(c))
    return rows.groupBy("model").agg(
        F.count("*").alias("runs"),
        F.count_if(ok).alias("ok_runs"),
        F.avg(of(value)).alias("awarded_mean"),
        F.stddev_samp(of(value)).alias("awarded_std"),
        F.avg(of(percent)).alias("percentage_mean"),
        F.stddev_samp(of(percent)).alias("percentage_std"),
    )


def unique_slugs(models: DataFrame, pos: str = "pos") -> DataFrame:
    """Slug of each model in order: a repeated slug gets -2, -3 and so on.

    A slug that thereby meets another model's natural slug is counted on among both.
    """
    base = models.withColumn("base", slugify(F.col("model"), default="model"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy(pos))
    first = base.withColumn("slug", F.when(nth == 1, F.col("base")).otherwise(F.concat_ws("-", F.col("base"), nth.cast("string"))))
    again = F.row_number().over(Window.partitionBy("slug").orderBy((F.col("slug") != F.col("base")).cast("int"), pos))
    return first.withColumn("again", again).select(
        pos, "model", F.when(F.col("again") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("again").cast("string"))).alias("slug")
    )


def run_order(models: DataFrame, repeat: int) -> DataFrame:
    """Runs of a matrix, all models of one repeat before the next."""
    return models.select("model", "pos", F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("run_index")).orderBy("run_index", "pos")


def usage_by_phase(usage: DataFrame) -> DataFrame:
    """Sums of the six counters by run and phase, and in total (phase null)."""
    return usage.rollup("run_id", "phase").agg(*(F.sum(c).alias(c) for c in USAGE)).where("run_id IS NOT NULL")


def paper_results(buckets: DataFrame, runs: DataFrame) -> DataFrame:
    """Means over a configuration's ok runs on each paper.

    buckets: run_id, class, COUNTERS; runs: run_id, entry_id, subset, run_index, status, secs.
    """
    ok = runs.where("status = 'ok'").select("run_id", "entry_id", "subset", "run_index", "secs")
    wide = ok.join(buckets, "run_id")
    aggs = []
    for c in CLASSES:
        here = F.col("class") == c
        for k in COUNTERS[1:]:
            aggs.append(F.round(F.avg(F.when(here, F.col(k))), 6).alias(f"{c}_{k}"))
        aggs.append(F.min_by(F.when(here, F.col("questions")), F.when(here, F.col("run_index"))).alias(f"{c}_questions"))
    sums = wide.groupBy("entry_id", "subset").agg(*aggs)
    per_run = wide.groupBy("entry_id", "subset", "run_index").agg(
        F.round(F.sum("awarded"), 6).alias("total"), F.sum(F.when(F.col("class") == "deterministic", F.col("awarded"))).alias("det")
    )
    samples = per_run.groupBy("entry_id", "subset").agg(F.array_sort(F.collect_list(F.struct("run_index", "total", "det"))).alias("s"))
    counts = runs.groupBy("entry_id", "subset").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "ok").alias("ok_runs"), F.round(F.avg(F.when(F.col("status") == "ok", F.col("secs"))), 3).alias("solve_secs")
    )
    return counts.join(sums, ["entry_id", "subset"], "left").join(samples, ["entry_id", "subset"], "left").select(
        *counts.columns,
        *[c for c in sums.columns if c not in ("entry_id", "subset")],
        F.transform("s", lambda x: x["total"]).alias("awarded_samples"),
        F.transform("s", lambda x: x["det"]).alias("det_awarded_samples"),
    )


def mixed_entries(runs: DataFrame) -> DataFrame:
    """Entries whose runs are of more than one (model, effort): one entry is one configuration."""
    return (
        runs.groupBy("entry_id")
        .agg(F.count_distinct(F.struct("model", F.coalesce("effort", F.lit("")).alias("effort"))).alias("configurations"))
        .where("configurations > 1")
    )


def index_entries(papers: DataFrame) -> DataFrame:
    """Headline numbers of each entry from its papers (``paper_results``)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    per = papers.groupBy("entry_id").agg(
        F.count("*").alias("papers"),
        F.count_if(F.col("ok_runs") > 0).alias("ok_papers"),
        F.round(F.sum(z("deterministic_awarded") + z("judge_awarded")), 6).alias("awarded"),
        F.round(F.sum(z("deterministic_covered_max") + z("judge_covered_max")), 6).alias("covered_max"),
        F.round(F.sum(z("deterministic_awarded")), 6).alias("det_awarded"),
        F.round(F.sum(z("deterministic_covered_max")), 6).alias("det_covered_max"),
        F.round(F.sum(z("solve_secs")), 3).alias("solve_secs"),
    )
    return per.withColumns(
        {
            "percentage": F.round(percent_or_null(F.col("awarded"), F.col("covered_max")), 4),
            "det_percentage": F.round(percent_or_null(F.col("det_awarded"), F.col("det_covered_max")), 4),
        }
    )


def board_key() -> Column:
    """Order of the board: percentage falling, with 0 and null together below all."""
    pct = F.col("percentage")
    return F.when(pct.isNull() | (pct == 0), F.lit(-1.0)).otherwise(pct).desc()


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` with the rows of ``new`` added, or put in place of those with their key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the largest ``order``."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("x")).select(key, "x.*")


def paper_meta(subset: Column) -> tuple[Column, Column]:
    """Exam and year of a paper's name."""
    parts = F.split(subset, "-")
    exam = F.when(F.size(parts) > 1, parts[0])
    year = F.when((F.size(parts) > 2) & F.get(parts, 1).rlike(r"^\d+$"), F.get(parts, 1))
    return exam, year


def coverage_warning(runs: DataFrame) -> DataFrame:
    """Papers whose takers covered different points."""
    return runs.groupBy("subset").agg(F.count_distinct(F.round("covered_max", 6)).alias("covers")).where("covers > 1")


def question_rows(results: DataFrame, agreement: DataFrame | None = None) -> DataFrame:
    """Run x question table: results with ratio (null on zero points) and, if given, the judges' spread."""
    out = results.withColumn("ratio", F.try_divide("awarded", "max_points"))
    if agreement is None:
        return out
    return out.join(agreement.select("run_id", "question_id", F.col("spread").alias("judge_spread")), ["run_id", "question_id"], "left")


def entries(runs: DataFrame) -> DataFrame:
    """One row per entry from its runs: taker, repeats, first and last run; mixed configurations stop the query.

    runs: entry_id, model, effort, run_index, started_at, finished_at, subset.
    """
    mixed = F.count_distinct(F.struct("model", F.coalesce("effort", F.lit("")).alias("effort"))) > 1
    return runs.groupBy("entry_id").agg(
        F.when(mixed, F.raise_error(F.concat(F.lit("more than one configuration in entry "), F.col("entry_id")))).otherwise(F.min("model")).alias("model"),
        F.min("effort").alias("effort"),
        F.max("run_index").alias("repeat"),
        F.count_distinct("subset").alias("papers"),
        F.min("started_at").alias("first_run_at"),
        F.max(F.coalesce("finished_at", "started_at")).alias("last_run_at"),
    )


def failed_statuses(runs: DataFrame) -> DataFrame:
    """Statuses of the runs of each entry and paper that failed, in order of the runs."""
    bad = F.filter(F.array_sort(F.collect_list(F.struct("run_index", "status"))), lambda x: x["status"] != "ok")
    return runs.groupBy("entry_id", "subset").agg(F.transform(bad, lambda x: x["status"]).alias("failed"))


def reindex(papers: DataFrame, path: str = "path") -> DataFrame:
    """The index from scratch: headline numbers of every entry, of papers read twice the one of the later path."""
    cols = [c for c in papers.columns if c not in ("entry_id", "subset")]
    last = papers.groupBy("entry_id", "subset").agg(F.max_by(F.struct(*cols), path).alias("x")).select("entry_id", "subset", "x.*")
    return index_entries(last)


# Columns and types of the published question table of a result.
QUESTION_COLUMNS = (
    "entry_id string, model string, effort string, source_repo string, subset string, run_index int, question_id string, section_id string, number string, "
    "question_type string, rule_kind string, mode string, max_points double, awarded double, ratio double, judge_verdicts int, judge_spread double, detail_json string"
)


def published_questions(results: DataFrame) -> DataFrame:
    """The published table: all columns of ``QUESTION_COLUMNS`` in order and with their types.

    A column that ``results`` lacks is empty text or null; number falls back to question_id, ratio is awarded over max_points.
    """
    out = results.withColumn("ratio", F.try_divide("awarded", "max_points"))
    cols = []
    for field in QUESTION_COLUMNS.split(", "):
        name, kind = field.split(" ")
        value = F.col(name) if name in out.columns else F.lit(None)
        if name == "number":
            value = F.coalesce(value, "question_id")
        cols.append((F.coalesce(value, F.lit("")) if kind == "string" and name != "detail_json" else value).cast(kind).alias(name))
    return out.select(*cols)

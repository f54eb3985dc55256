"""Rater reliability over study rows (qid, sheet, judge, rep, p, and attributes)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = ["qid", "sheet", "judge"]


def cells(rows: DataFrame) -> DataFrame:
    """Mean over repeats of each question, sheet and judge; null scores are skipped."""
    return rows.groupBy(*CELL).agg(F.avg("p").alias("p"))


def within_sd(rows: DataFrame) -> DataFrame:
    """Per judge: root of the mean population variance of repeated cells, and the share of identical repeats."""
    per = rows.where("p IS NOT NULL").groupBy(*CELL).agg(F.var_pop("p").alias("v"), F.count("*").alias("n"), (F.max("p") == F.min("p")).alias("same"))
    return per.where("n > 1").groupBy("judge").agg(
        F.sqrt(F.avg("v")).alias("within_sd"), F.avg(F.col("same").cast("double")).alias("identical"), F.count("*").alias("cells")
    )


def complete(cell_rows: DataFrame, judges: int, by: list[str] | None = None) -> DataFrame:
    """Cells of answers that all ``judges`` judges scored, in each group of ``by``."""
    w = Window.partitionBy(*(by or []), "qid", "sheet")
    return cell_rows.where("p IS NOT NULL").withColumn("_k", F.count("*").over(w)).where(F.col("_k") == judges).drop("_k")


#: Rows of per-judge and per-group means that are small enough to be broadcast.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if its counted rows are few."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def mean_squares(cell_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, k and the mean squares of answers, judges and residual of complete cells (two-way layout).

    Answers' means come from a window over each answer; those of judges and of groups are joined.
    """
    by = by or []
    col = cell_rows.groupBy(*by, "judge").agg(F.avg("p").alias("cm"))
    grand = cell_rows.groupBy(*by).agg(F.avg("p").alias("g"))
    rows = cell_rows.withColumn("rm", F.avg("p").over(Window.partitionBy(*by, "qid", "sheet")))
    x = rows.join(small(col), [*by, "judge"])
    x = x.join(small(grand), by) if by else x.crossJoin(F.broadcast(grand))  # one row
    sq = lambda a, b: F.sum((F.col(a) - F.col(b)) ** 2)
    s = x.groupBy(*by).agg(
        F.count_distinct("qid", "sheet").alias("n"), F.count_distinct("judge").alias("k"), sq("rm", "g").alias("ssr"), sq("cm", "g").alias("ssc"), sq("p", "g").alias("sst")
    )
    return s.where("n > 0").select(
        *by,
        "n",
        "k",
        F.try_divide("ssr", F.col("n") - 1).alias("msr"),
        F.try_divide("ssc", F.col("k") - 1).alias("msc"),
        F.try_divide(F.col("sst") - F.col("ssr") - F.col("ssc"), (F.col("n") - 1) * (F.col("k") - 1)).alias("mse"),
    )


def icc(cell_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ICC(2,1): two-way random effects, absolute agreement, single rater; null without two answers and judges."""
    return mean_squares(cell_rows, by).withColumn("icc", _icc())


def _icc() -> Column:
    n, k, msr, msc, mse = (F.col(c) for c in ("n", "k", "msr", "msc", "mse"))
    below = msr + (k - 1) * mse + k * (msc - mse) / n
    return F.when((n >= 2) & (k >= 2), F.try_divide(msr - mse, F.nullif(below, F.lit(0.0))))


def variance_shares(cell_rows: DataFrame) -> DataFrame:
    """Variance of answers, judges and residual, and their shares."""
    m = mean_squares(cell_rows)
    out = m.select(
        F.greatest((F.col("msr") - F.col("mse")) / F.col("k"), F.lit(0.0)).alias("answers"),
        F.greatest((F.col("msc") - F.col("mse")) / F.col("n"), F.lit(0.0)).alias("judges"),
        F.col("mse").alias("residual"),
    )
    total = F.col("answers") + F.col("judges") + F.col("residual")
    return out.select("*", *(F.try_divide(c, total).alias(f"{c}_share") for c in ("answers", "judges", "residual")))


def judge_pairs(cell_rows: DataFrame) -> DataFrame:
    """Per pair of judges: common answers, mean absolute difference, correlation.

    Judges of one answer are few, so the pairs of an answer are.
    """
    right = cell_rows.select("qid", "sheet", F.col("judge").alias("other"), F.col("p").alias("q"))
    both = cell_rows.join(right, ["qid", "sheet"]).where("judge < other")
    return both.groupBy("judge", "other").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("p") - F.col("q"))).alias("mean_abs"), F.corr("p", "q").alias("r"))


def panels(cell_rows: DataFrame) -> DataFrame:
    """Mean score of every panel of two judges or more on every answer (2^judges panels)."""
    judges = cell_rows.select("judge").distinct().withColumn("bit", F.row_number().over(Window.orderBy("judge")) - 1)
    n = judges.count()
    sets = cell_rows.sparkSession.range(1 << n).withColumnRenamed("id", "panel").withColumn("size", F.bit_count("panel")).where("size >= 2")
    member = judges.join(sets, F.expr("(shiftright(panel, bit) & 1) = 1"))
    return cell_rows.join(member, "judge").groupBy("panel", "size", "qid", "sheet").agg(F.avg("p").alias("p"))


def ordinal(values: DataFrame, by: list[str], value: str, out: str, tie: list[str]) -> DataFrame:
    """Ordinal ranks from 0 of ``value`` within ``by``; ties in order of ``tie`` (not averaged)."""
    return values.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(value, *tie)) - 1)


def spearman_within(values: DataFrame, by: list[str], x: str, y: str, tie: list[str], least: int = 4) -> DataFrame:
    """Rank correlation inside each group of at least ``least`` rows, with ordinal ranks."""
    r = ordinal(ordinal(values, by, x, "_rx", tie), by, y, "_ry", tie)
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.corr(F.col("_rx").cast("double"), F.col("_ry").cast("double")).alias("rho")).where(F.col("n") >= least)


def leniency(cell_rows: DataFrame) -> DataFrame:
    """Mean and mean absolute deviation of each judge from the panel mean of the answer."""
    panel = F.avg("p").over(Window.partitionBy("qid", "sheet"))
    return cell_rows.withColumn("d", F.col("p") - panel).groupBy("judge").agg(F.avg("d").alias("mean_dev"), F.avg(F.abs("d")).alias("mean_abs_dev"))


def leave_one_out(cell_rows: DataFrame, include_self: bool = False) -> DataFrame:
    """Mean absolute deviation of each judge from the mean of the others (or of all) on the answer."""
    w = Window.partitionBy("qid", "sheet")
    s, n = F.sum("p").over(w), F.count("p").over(w)
    rest = s / n if include_self else F.try_divide(s - F.col("p"), n - 1)
    return cell_rows.withColumn("d", F.abs(F.col("p") - rest)).groupBy("judge").agg(F.avg("d").alias("mae"))


def level_shift(cell_rows: DataFrame, level: str, low: str, high: str, by: list[str]) -> DataFrame:
    """Mean and mean absolute change from level ``low`` to ``high`` on the same ``by``."""
    at = lambda v, name: cell_rows.where(F.col(level) == v).groupBy(*by).agg(F.avg("p").alias(name))
    return at(low, "a").join(at(high, "b"), by).agg(
        F.count("*").alias("n"), F.avg(F.col("b") - F.col("a")).alias("shift"), F.avg(F.abs(F.col("b") - F.col("a"))).alias("mean_abs"), F.max(F.abs(F.col("b") - F.col("a"))).alias("max_abs")
    )


def panel_swap(cell_rows: DataFrame, cheap: list[str], dear: list[str]) -> DataFrame:
    """How far answers move between two panels of judges, and the correlation of their means."""
    of = lambda names: F.avg(F.when(F.col("judge").isin(names), F.col("p")))
    per = cell_rows.groupBy("qid", "sheet").agg(of(cheap).alias("a"), of(dear).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return per.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs"), F.corr("a", "b").alias("r"))


def anchor_validity(rows: DataFrame, empty: str, reference: str, no_key: DataFrame) -> DataFrame:
    """Share of empty anchors scored at most 0.1, and of reference anchors (with a key) at least 0.9."""
    keyed = rows.join(no_key.withColumn("_none", F.lit(True)), "qid", "left")
    e, r = F.col("sheet") == empty, (F.col("sheet") == reference) & F.col("_none").isNull()
    return keyed.agg(
        F.count_if(e).alias("empty"), F.count_if(e & (F.col("p") <= 0.1)).alias("empty_low"), F.count_if(r).alias("reference"), F.count_if(r & (F.col("p") >= 0.9)).alias("reference_high"), F.avg(F.when(r, F.col("p"))).alias("reference_mean")
    )


def answer_spread(cell_rows: DataFrame) -> DataFrame:
    """Per question: population deviation of the sheets' means, and the judges' mean range."""
    per = cell_rows.groupBy("qid", "sheet").agg(F.avg("p").alias("m"), (F.max("p") - F.min("p")).alias("range"))
    return per.groupBy("qid").agg(F.stddev_pop("m").alias("spread"), F.avg("range").alias("disagreement"))


def retention(spreads: DataFrame, full: str, least: float = 0.10) -> DataFrame:
    """Median ratio of each condition's spread to the full condition's, on questions that discriminate there."""
    base = spreads.where(F.col("condition") == full).where(F.col("spread") >= least).select("qid", F.col("spread").alias("base"))
    return spreads.where(F.col("condition") != full).join(base, "qid").groupBy("condition").agg(F.count("*").alias("questions"), F.median(F.try_divide("spread", "base")).alias("median_ratio"))


def family_table(rows: DataFrame) -> DataFrame:
    """Means by judge family, writer family, both and overall (null: all)."""
    return rows.cube("jfam", "wfam").agg(F.avg("p").alias("mean"), F.count("p").alias("n"))


def stratum_table(rows: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Per stratum: mean, population deviation of answer means, and the judges' mean range."""
    per = rows.groupBy(stratum, "qid", "sheet").agg(F.avg("p").alias("m"), (F.max("p") - F.min("p")).alias("range"))
    return per.groupBy(stratum).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("answer_sd"), F.avg("range").alias("disagreement"))


def passes(rows: DataFrame, expected: int) -> DataFrame:
    """Grading passes (sheet, judge, rep) and whether each has all expected questions."""
    return rows.groupBy("sheet", "judge", "rep").agg(F.count_distinct("qid").alias("questions")).withColumn("complete", F.col("questions") == expected)


def multiplicity(draw: Column, qid: Column, seed: int) -> Column:
    """How often a question occurs in a draw: a Poisson number of mean 1 from a digest of both, so draws can be repeated anywhere."""
    u = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), draw, qid)), 1, 8), 16, 10).cast("double") / (1 << 32)
    below, term, out = math.exp(-1), math.exp(-1), F.lit(0)
    for i in range(1, 13):
        out = F.when(u >= below, i).otherwise(out)
        term /= i
        below += term
    return out


def cluster_bootstrap(cell_rows: DataFrame, draws: int = 200, seed: int = 1) -> DataFrame:
    """ICC(2,1) of ``draws`` resamples of whole questions: draw, n, k, icc; null where a draw has fewer than two answers.

    Cells must be complete.  One pass makes the sums that the mean squares need, per question and judge; a draw
    weighs a question's sums by its multiplicity, so not cells but a question's few sums meet the draws, and
    partial aggregation leaves one row of a draw and judge in each task.
    """
    rm = F.avg("p").over(Window.partitionBy("qid", "sheet"))
    sums = cell_rows.withColumn("rm", rm).groupBy("qid", "judge").agg(F.count("*").alias("a"), F.sum("p").alias("s"), F.sum(F.col("p") ** 2).alias("p2"), F.sum(F.col("rm") ** 2).alias("r2"))
    times = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", multiplicity(F.col("draw"), F.col("qid"), seed)).where("w > 0")
    per = times.groupBy("draw", "judge").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in ("a", "s", "p2", "r2")))
    n, k, c = F.col("n"), F.col("k"), F.col
    all_ = per.groupBy("draw").agg(F.max("a").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("p2").alias("p2"), F.sum("r2").alias("r2"), F.sum(c("s") ** 2 / c("a")).alias("c2"))
    mean2 = c("s") ** 2 / (n * k)
    msr, msc = F.try_divide(c("r2") - mean2, n - 1), F.try_divide(c("c2") - mean2, k - 1)
    squares = all_.select("draw", "n", "k", msr.alias("msr"), msc.alias("msc"), F.try_divide(c("p2") - c("r2") - c("c2") + mean2, (n - 1) * (k - 1)).alias("mse"))
    return squares.select("draw", "n", "k", _icc().alias("icc"))


def icc_interval(cell_rows: DataFrame, draws: int = 1000, level: float = 0.95, seed: int = 1) -> DataFrame:
    """One row: icc of all questions, and the bounds of the bootstrap's middle ``level``; cells must be complete."""
    tail = (1 - level) / 2
    bounds = cluster_bootstrap(cell_rows, draws, seed).agg(F.percentile("icc", F.lit(tail)).alias("low"), F.percentile("icc", F.lit(1 - tail)).alias("high"), F.count("icc").alias("draws"))
    return icc(cell_rows).select("n", "k", "icc").join(F.broadcast(bounds))  # one row each


def conditions(rows: DataFrame, empty: str, reference: str) -> DataFrame:
    """Per condition: answers, ICC, judges' mean range, mean score, and means of the empty and the reference anchor.

    The ICC is that of answers which all judges of their condition scored.  rows: condition, qid, sheet, judge, p.
    """
    of = ["condition"]
    per = rows.groupBy(*of, "qid", "sheet").agg(F.avg("p").alias("m"), (F.max("p") - F.min("p")).alias("range"))
    real = ~F.col("sheet").isin(empty, reference)
    at = lambda cond, c: F.avg(F.when(cond, F.col(c)))
    table = per.groupBy(*of).agg(
        F.count_if(real).alias("answers"),
        at(real, "range").alias("disagreement"),
        at(real, "m").alias("mean"),
        at(F.col("sheet") == empty, "m").alias("empty_mean"),
        at(F.col("sheet") == reference, "m").alias("reference_mean"),
    )
    scored = rows.where(real & F.col("p").isNotNull()).groupBy(*of, *CELL).agg(F.avg("p").alias("p"))
    judges = scored.groupBy(*of).agg(F.count_distinct("judge").alias("_judges"))
    whole = scored.withColumn("_k", F.count("*").over(Window.partitionBy(*of, "qid", "sheet"))).join(small(judges), of).where("_k = _judges").drop("_k", "_judges")
    return table.join(small(icc(whole, of).select(*of, F.col("n").alias("icc_answers"), "icc")), of, "left")


def writers(rows: DataFrame, writer: str = "sheet") -> DataFrame:
    """Per writer: mean, population deviation and minimum of the panel's means over questions."""
    per = rows.groupBy(writer, "qid").agg(F.avg("p").alias("m"))
    return per.groupBy(writer).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"), F.min("m").alias("least"))


def writer_ranks(rows: DataFrame, first: list[str], second: list[str], writer: str = "sheet") -> DataFrame:
    """Rank of every writer under two panels of judges, best first, ties by name.

    Ranks go over writers, a handful, so one task makes them.
    """
    of = lambda names: F.avg(F.when(F.col("judge").isin(names), F.col("p")))
    per = rows.groupBy(writer).agg(of(first).alias("a"), of(second).alias("b"))
    rank = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc_nulls_last(), writer))
    return per.withColumns({"rank_a": rank("a"), "rank_b": rank("b")})


def family_lengths(rows: DataFrame, family: str = "wfam", length: str = "len") -> DataFrame:
    """Mean answer length of each writer family, each answer once."""
    once = rows.groupBy(family, "qid", "sheet").agg(F.max(length).alias("n"))
    return once.groupBy(family).agg(F.avg("n").alias("mean_length"), F.count("*").alias("answers"))


#: Parts into which the values of a group are cut to find its median.
PARTS = 1024


def exact_median(values: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    """``by``, out, n: the median of each group's values (mean of the middle two), nulls left out.

    Equal values are counted first; a group's range is cut into parts, whose counts tell in which the
    middle lies, and only the values of that part are ordered.  So no group is gathered, be it all rows.
    """
    v = F.col("_v")
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    spans = counts.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("n"))
    on = lambda a, b, keys: a.join(b, keys) if keys else a.join(F.broadcast(b))  # noqa: E731  without keys b is one row
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0))
    at = on(counts, spans, by).withColumn("_part", part.cast("int"))
    sums = at.groupBy(*by, "_part").agg(F.sum("_c").alias("_s"), F.first("n").alias("n"))
    upto = F.sum("_s").over(Window.partitionBy(*by).orderBy("_part"))  # at most PARTS rows a group
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)  # places of the middle two, from 1
    mid = sums.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_s")).where((F.col("_before") < high) & (F.col("_upto") >= low))
    near = at.drop("n").join(mid.select(*by, "_part", "_before", "n"), [*by, "_part"])
    place = F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v")) + F.col("_before")
    hit = near.withColumn("_to", place).withColumn("_from", F.col("_to") - F.col("_c"))
    first, second = (F.max(F.when((F.col("_from") < p) & (F.col("_to") >= p), v)) for p in (low, high))
    return hit.groupBy(*by, "n").agg(first.alias("_a"), second.alias("_b")).select(*by, ((F.col("_a") + F.col("_b")) / 2).alias(out), "n")


def median_spearman(values: DataFrame, by: list[str], x: str, y: str, tie: list[str], least: int = 4) -> DataFrame:
    """The median over groups of their rank correlations."""
    rho = spearman_within(values, by, x, y, tie, least).where("rho IS NOT NULL")
    return exact_median(rho, [], "rho", "median_rho").withColumnRenamed("n", "groups")


STUDY_FILE = r"([A-Za-z0-9.]+)__([A-Za-z0-9.:-]+?)(?:__r([0-9]+))?[.]json$"


def study_rows(reports: DataFrame, pattern: str = STUDY_FILE) -> DataFrame:
    """Study rows from grade reports (file, question_id, mode, awarded, max_points): sheet, judge and repeat from file names.

    Only judged questions count; p is the share of the points, null without points.
    """
    part = lambda i: F.regexp_extract("file", pattern, i)
    return reports.where("mode = 'judge'").select(
        F.col("question_id").alias("qid"), part(1).alias("sheet"), part(2).alias("judge"),
        F.coalesce(F.nullif(part(3), F.lit("")).try_cast("int"), F.lit(1)).alias("rep"), F.try_divide("awarded", "max_points").alias("p"),
    ).where("sheet <> ''")

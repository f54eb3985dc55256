"""Queries: bench summaries, results, leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import text as T
from scorewright.operators import leaderboard, results
from scorewright.plans import adapters as A
from scorewright.plans import grading as G

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    f"""WITH {A.RUNS_SQL} SELECT model, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok_runs,
    round(avg(det_awarded) FILTER (status = 'ok'), 6) AS awarded_mean, round(stddev_samp(det_awarded) FILTER (status = 'ok'), 6) AS awarded_std,
    round(avg(100 * det_awarded / nullif(det_max, 0)) FILTER (status = 'ok'), 6) AS percentage_mean, round(stddev_samp(100 * det_awarded / nullif(det_max, 0)) FILTER (status = 'ok'), 6) AS percentage_std
    FROM runs GROUP BY model"""
)
def bench_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.runs(spark, sf_dir).withColumn("covered_percentage", F.try_divide(100 * F.col("det_awarded"), F.col("det_max")))
    return _rounded(results.summarize_models(r, "det_awarded"), "awarded_mean", "awarded_std", "percentage_mean", "percentage_std")


@query(
    """WITH m AS (SELECT p_partkey AS pos, 'Lab:' || p_brand AS model, regexp_replace(regexp_replace(lower('Lab:' || p_brand), '[^a-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos) AS nth FROM m) SELECT pos, model, base || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS slug FROM n"""
)
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("Lab:"), "p_brand").alias("model"))
    return results.unique_slugs(m)


@query(
    f"""WITH {G._LADDER_SQL}, x AS (SELECT *, CASE WHEN q % 11 = 0 THEN 'judge' ELSE 'deterministic' END AS class FROM graded), runs AS (SELECT DISTINCT run FROM x), k AS (SELECT unnest(['judge', 'deterministic']) AS class)
    SELECT CAST(r.run AS VARCHAR) AS run_id, k.class, count(x.run) AS questions, round(coalesce(sum(high), 0), 6) AS max_points, round(coalesce(sum(high) FILTER (mode = 'skipped'), 0), 6) AS skipped_points,
    round(coalesce(sum(high), 0) - coalesce(sum(high) FILTER (mode = 'skipped'), 0), 6) AS covered_max, round(coalesce(sum(awarded), 0), 6) AS awarded,
    count(*) FILTER (high > 0 AND awarded >= high - 1e-9) AS full_credit, count(*) FILTER (mode = 'unanswered') AS unanswered, count(*) FILTER (mode = 'error') AS errored, count(*) FILTER (mode = 'skipped') AS skipped
    FROM runs r CROSS JOIN k LEFT JOIN x ON x.run = r.run AND x.class = k.class GROUP BY r.run, k.class"""
)
def classify_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.classify_points(G.results(spark, sf_dir))


@query(
    """WITH u AS (SELECT o_orderkey % 50 AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'grade' ELSE 'solve' END AS phase, o_custkey AS t FROM orders)
    SELECT run_id, phase, CAST(count(*) AS BIGINT) AS requests, CAST(sum(t) AS BIGINT) AS input_tokens FROM u GROUP BY GROUPING SETS ((run_id, phase), (run_id))"""
)
def usage_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    zero = {c: F.lit(0).cast("bigint") for c in results.USAGE}
    u = o.select((F.col("o_orderkey") % 50).alias("run_id"), F.when(F.col("o_orderkey") % 3 == 0, "grade").otherwise("solve").alias("phase"), F.col("o_custkey").alias("t")).withColumns(zero | {"requests": F.lit(1).cast("bigint"), "input_tokens": F.col("t")})
    return results.usage_by_phase(u).select("run_id", "phase", "requests", "input_tokens")


def _paper_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.runs(spark, sf_dir)
    zero = F.lit(0).cast("bigint")

    def bucket(name: str, awarded: str, most: str):
        return F.struct(
            F.lit(name).alias("class"), F.lit(5).cast("bigint").alias("questions"), F.col(most).alias("max_points"), F.lit(0.0).alias("skipped_points"), F.col(most).alias("covered_max"), F.col(awarded).alias("awarded"),
            zero.alias("full_credit"), zero.alias("unanswered"), zero.alias("errored"), zero.alias("skipped"),
        )

    buckets = r.select("run_id", F.inline(F.array(bucket("deterministic", "det_awarded", "det_max"), bucket("judge", "judge_awarded", "judge_max"))))
    return results.paper_results(buckets, r)


_PAPER_RESULTS_SQL = (
    A.RUNS_SQL
    + """, pr AS (
    SELECT entry_id, subset, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok_runs, round(avg(secs) FILTER (status = 'ok'), 3) AS solve_secs,
           round(avg(det_awarded) FILTER (status = 'ok'), 6) AS da, round(avg(det_max) FILTER (status = 'ok'), 6) AS dm,
           round(avg(judge_awarded) FILTER (status = 'ok'), 6) AS ja, round(avg(judge_max) FILTER (status = 'ok'), 6) AS jm
    FROM runs GROUP BY entry_id, subset)"""
)


@query(f"WITH {_PAPER_RESULTS_SQL} SELECT entry_id, subset, runs, ok_runs, da AS deterministic_awarded, dm AS deterministic_covered_max, ja AS judge_awarded FROM pr")
def paper_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paper_results(spark, sf_dir).select("entry_id", "subset", "runs", "ok_runs", "deterministic_awarded", "deterministic_covered_max", "judge_awarded")


_INDEX_SQL = (
    _PAPER_RESULTS_SQL
    + """, idx AS (
    SELECT entry_id, count(*) AS papers, count(*) FILTER (ok_runs > 0) AS ok_papers, round(sum(coalesce(da, 0) + coalesce(ja, 0)), 6) AS awarded, round(sum(coalesce(dm, 0) + coalesce(jm, 0)), 6) AS covered_max,
           round(sum(coalesce(da, 0)), 6) AS det_awarded, round(sum(coalesce(dm, 0)), 6) AS det_covered_max FROM pr GROUP BY entry_id)"""
)


@query(f"WITH {_INDEX_SQL} SELECT *, round(100 * awarded / nullif(covered_max, 0), 4) AS percentage, round(100 * det_awarded / nullif(det_covered_max, 0), 4) AS det_percentage FROM idx")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.index_entries(_paper_results(spark, sf_dir)).drop("solve_secs")


@query(
    f"""WITH {_INDEX_SQL}, p AS (SELECT entry_id, round(100 * awarded / nullif(covered_max, 0), 4) AS percentage FROM idx)
    SELECT entry_id, row_number() OVER (ORDER BY CASE WHEN percentage IS NULL OR percentage = 0 THEN -1 ELSE percentage END DESC, entry_id) AS rank FROM p"""
)
def board_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = results.index_entries(_paper_results(spark, sf_dir))
    return e.select("entry_id", F.row_number().over(Window.orderBy(results.board_key(), "entry_id")).cast("bigint").alias("rank"))


@query("SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(s_acctbal, c_acctbal) AS balance FROM customer FULL JOIN supplier ON s_suppkey = c_custkey")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers put over customers by key."""
    old = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    new = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return results.upsert(old, new, "id")


@query("SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.last_wins(A.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey").select("o_custkey", "o_totalprice")


@query(
    """WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'mock' WHEN 1 THEN 'mock-115' WHEN 2 THEN 'mock-115-math-a' ELSE 'mock-x-math' END AS subset FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN 'mock' END AS exam, CASE WHEN p_partkey % 4 = 2 THEN '115' END AS year, CASE p_partkey % 4 WHEN 2 THEN 'math-a' WHEN 3 THEN 'math' ELSE subset END AS short FROM s"""
)
def paper_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = A.table(spark, sf_dir, "part").withColumn("subset", F.when(k % 4 == 0, "mock").when(k % 4 == 1, "mock-115").when(k % 4 == 2, "mock-115-math-a").otherwise("mock-x-math"))
    exam, year = results.paper_meta(F.col("subset"))
    return s.select("p_partkey", exam.alias("exam"), year.alias("year"), T.short_subject(F.col("subset")).alias("short"))


@query("SELECT o_custkey % 100 AS entry_id, count(DISTINCT (o_orderpriority, o_orderstatus)) AS configurations FROM orders GROUP BY ALL HAVING count(DISTINCT (o_orderpriority, o_orderstatus)) > 1")
def mixed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.mixed_entries(A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("entry_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("effort")))


@query(f"WITH {G._LADDER_SQL} SELECT CAST(run AS VARCHAR) AS run_id, CAST(q AS VARCHAR) AS question_id, mode, round(awarded / nullif(high, 0), 6) AS ratio FROM graded")
def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.question_rows(G.results(spark, sf_dir)).select("run_id", "question_id", "mode", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {G._LADDER_SQL}, c AS (SELECT run, sum(high) FILTER (mode <> 'skipped') AS covered FROM graded GROUP BY run) SELECT 'p' || (run % 2) AS subset, count(DISTINCT round(covered, 6)) AS covers FROM c GROUP BY ALL HAVING count(DISTINCT round(covered, 6)) > 1")
def coverage_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorewright.operators.grading import report_totals

    r = report_totals(G.results(spark, sf_dir)).withColumn("subset", F.concat(F.lit("p"), (F.col("run_id").cast("int") % 2).cast("string")))
    return results.coverage_warning(r)


# --- leaderboards -------------------------------------------------------------------


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.papers(spark, sf_dir).groupBy("subset").agg(F.max("deterministic_covered_max").alias("deterministic_points")).withColumn("exam", F.split("subset", "-")[0])


def _scores_sql(det: bool, cost: str = "secs", per_question: bool = False) -> str:
    a, m = ("da", "dm") if det else ("da + ja", "dm + jm")
    s = "da" if det else "da + ja"
    chosen = "SELECT subset FROM papers GROUP BY subset HAVING max(dm) > 0" if det else "SELECT DISTINCT subset FROM papers"
    price = "sum(secs) / (count(*) * 11)" if per_question else "sum(secs)"
    return f"""{A.PAPERS_SQL}, chosen AS ({chosen}), sat AS (SELECT * FROM papers WHERE ok_runs > 0 AND subset IN (FROM chosen)), totals AS (
        SELECT entry_id, sample, sum({s}) AS t FROM nth WHERE subset IN (FROM chosen) GROUP BY entry_id, sample
    ), dev AS (SELECT entry_id, stddev_samp(t) AS d FROM totals GROUP BY entry_id), scores AS (
        SELECT entry_id, count(*) AS papers, count(*) = (SELECT count(*) FROM chosen) AS eligible, sum({a}) AS awarded, sum({m}) AS covered_max, 100 * sum({a}) / nullif(sum({m}), 0) AS micro,
               avg(100 * ({a}) / nullif({m}, 0)) AS macro, {price} AS cost, min(ok_runs) AS lo, max(ok_runs) AS hi FROM sat GROUP BY entry_id
    )"""


_SCORE_COLUMNS = "entry_id, papers, eligible, round(awarded, 6) AS awarded, round(covered_max, 6) AS covered_max, round(micro, 6) AS micro, round(macro, 6) AS macro, round(cost, 7) AS cost, round(CASE WHEN lo = hi AND lo >= 2 THEN 100 * d / covered_max END, 6) AS spread"


def _scores(spark: SparkSession, sf_dir: str, det: bool = False, per_question: bool = False) -> DataFrame:
    chosen = leaderboard.selection(_meta(spark, sf_dir), det_only=det)
    return leaderboard.score_entries(A.papers(spark, sf_dir), chosen, det, per_question=per_question)


def _shown(df: DataFrame) -> DataFrame:
    return _rounded(df.drop("questions"), "awarded", "covered_max", "micro", "macro", "spread").withColumn("cost", F.round("cost", 7))


@query(f"WITH {_scores_sql(False)} SELECT {_SCORE_COLUMNS} FROM scores JOIN dev USING (entry_id)")
def leaderboard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro and macro averages, cost and spread of every entry over all papers."""
    return _shown(_scores(spark, sf_dir))


@query(f"WITH {_scores_sql(True)} SELECT {_SCORE_COLUMNS} FROM scores JOIN dev USING (entry_id)")
def leaderboard_det_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_scores(spark, sf_dir, det=True))


@query(f"WITH {_scores_sql(False, per_question=True)} SELECT entry_id, round(cost, 7) AS cost, CAST(papers * 11 AS BIGINT) AS questions FROM scores")
def leaderboard_cost_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, per_question=True).select("entry_id", F.round("cost", 7).alias("cost"), F.col("questions").cast("bigint").alias("questions"))


@query(f"WITH {_scores_sql(False)} SELECT entry_id, row_number() OVER (ORDER BY coalesce(round(micro, 9), -1) DESC, entry_id) AS rank FROM scores WHERE eligible")
def leaderboard_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir).withColumn("micro", F.round("micro", 9))
    return leaderboard.ranked(s).select("entry_id", F.col("rank").cast("bigint").alias("rank"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entries with ties: score in tens, cost in hundreds."""
    c = A.table(spark, sf_dir, "customer")
    return c.select("c_custkey", (F.col("c_custkey") * 7919 % 1000).cast("double").alias("score"), (F.floor(F.col("c_acctbal") / 100) + F.col("c_custkey") * 7919 % 1000).cast("double").alias("cost"))


_PARETO_SQL = """WITH p AS (SELECT c_custkey, CAST(c_custkey * 7919 % 1000 AS DOUBLE) AS score, CAST(floor(c_acctbal / 100) + c_custkey * 7919 % 1000 AS DOUBLE) AS cost FROM customer), u AS (SELECT * FROM p WHERE cost > 0)
    SELECT c_custkey, score, cost FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.cost <= a.cost AND b.score >= a.score AND (b.cost < a.cost OR b.score > a.score))"""


@query(_PARETO_SQL)
def pareto_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.pareto(_points(spark, sf_dir))


@query(_PARETO_SQL)
def pareto_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier as the rows that nothing beats."""
    return leaderboard.dominance(_points(spark, sf_dir)).where("beaten_by IS NULL").drop("beaten_by")


@query(
    """WITH p AS (SELECT c_custkey, CAST(c_custkey * 7919 % 1000 AS DOUBLE) AS score, CAST(floor(c_acctbal / 100) + c_custkey * 7919 % 1000 AS DOUBLE) AS cost FROM customer), u AS (SELECT * FROM p WHERE cost > 0),
    w AS (SELECT *, max(score) OVER (PARTITION BY cost) AS top, max(score) OVER (ORDER BY cost RANGE BETWEEN UNBOUNDED PRECEDING AND 0.5 PRECEDING) AS low FROM u)
    SELECT c_custkey, CASE WHEN low >= score THEN 'cheaper' WHEN top > score THEN 'equal cost' END AS beaten_by FROM w"""
)
def beaten_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What beats each customer; costs are whole numbers."""
    return leaderboard.dominance(_points(spark, sf_dir)).select("c_custkey", "beaten_by")


@query(f"WITH {A.PAPERS_SQL}, s AS (SELECT subset, count(DISTINCT entry_id) AS n FROM papers WHERE ok_runs > 0 GROUP BY subset), t AS (SELECT count(DISTINCT entry_id) AS n FROM papers WHERE ok_runs > 0) SELECT subset FROM s WHERE n = (SELECT n FROM t) OR NOT EXISTS (SELECT 1 FROM s WHERE n = (SELECT n FROM t))")
def common_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.common_papers(A.papers(spark, sf_dir))


@query(
    f"""WITH {A.RUNS_SQL}, e AS (SELECT DISTINCT entry_id, model, CASE effort WHEN '1' THEN 'low' WHEN '2' THEN 'medium' WHEN '3' THEN 'high' WHEN '4' THEN 'odd' END AS effort FROM runs),
    r AS (SELECT *, CASE effort WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE -1 END AS k FROM e), n AS (SELECT entry_id, model, row_number() OVER (PARTITION BY model ORDER BY k, entry_id) AS step, count(*) OVER (PARTITION BY model) AS c FROM r)
    SELECT entry_id, step, step = 1 OR step = c AS line_end FROM n"""
)
def effort_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    dial = F.create_map(*[F.lit(x) for x in ("1", "low", "2", "medium", "3", "high", "4", "odd")])
    e = A.runs(spark, sf_dir).select("entry_id", "model", F.try_element_at(dial, F.col("effort")).alias("effort")).distinct()
    return leaderboard.effort_lines(e).select("entry_id", F.col("step").cast("bigint").alias("step"), "line_end")


@query(
    f"""WITH {A.PAPERS_SQL}, s AS (SELECT entry_id, split_part(subset, '-', 1) AS exam, sum(da + ja) AS a, sum(dm + jm) AS m FROM papers WHERE ok_runs > 0 GROUP BY ALL)
    SELECT e.entry_id, x.exam, round(coalesce(a, 0), 6) AS awarded, round(100 * a / nullif(m, 0), 6) AS percentage FROM (SELECT DISTINCT entry_id FROM papers) e CROSS JOIN (SELECT DISTINCT split_part(subset, '-', 1) AS exam FROM papers) x LEFT JOIN s USING (entry_id, exam)"""
)
def group_by_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaderboard.by_exam(A.papers(spark, sf_dir), _meta(spark, sf_dir).select("subset", "exam"))
    return _rounded(out.select("entry_id", "exam", "awarded", "percentage"), "awarded", "percentage")


_AXES = [f"exam{i}-115-s{j}" for i in range(3) for j in range(7)]


@query(f"WITH {A.PAPERS_SQL} SELECT entry_id, " + ", ".join(f"round(max(100 * (da + ja) / (dm + jm)) FILTER (subset = '{s}'), 6) AS \"{s}\"" for s in _AXES) + " FROM papers GROUP BY entry_id")
def radar_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaderboard.radar(A.papers(spark, sf_dir), _AXES)
    return out.select("entry_id", *(F.round(F.col(f"`{s}`"), 6).alias(s) for s in _AXES))


@query(f"WITH {A.RUNS_SQL}, m AS (SELECT DISTINCT model, split_part(model, ':', 2) AS bare FROM runs) SELECT model, CASE WHEN count(*) OVER (PARTITION BY bare) > 1 THEN model ELSE bare END AS name FROM m")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.display_names(A.runs(spark, sf_dir))


@query(f"WITH {A.PAPERS_SQL}, s AS (SELECT DISTINCT subset, split_part(subset, '-', 3) AS short FROM papers) SELECT subset, CASE WHEN count(*) OVER (PARTITION BY short) > 1 THEN split_part(subset, '-', 1) || ' ' || short ELSE short END AS name FROM s")
def axis_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.axis_names(A.papers(spark, sf_dir).select("subset").distinct())


@query(
    r"""SELECT '| n_name | n_regionkey |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation"""
)
def board_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.board_markdown(A.table(spark, sf_dir, "nation"), ["n_name", "n_regionkey"], [F.col("n_nationkey")])

"""Benchmark-shaped relations from the driver's tables, by integer arithmetic that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LETTERS = ["A", "B", "C", "D", "E"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(mask: Column) -> Column:
    """Options whose bits are set."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, F.lit(x)) for i, x in enumerate(LETTERS)]))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One choice rule per part."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("question_id"),
        letters((F.col("p_size") % 31 + 1).cast("int")).alias("correct"),
        (p % 5 + 1).cast("double").alias("max_points"),
        F.when(p % 7 == 0, -1.0).otherwise(0.0).alias("min_points"),
        (p % 4 == 0).alias("single"),
        (p % 2 == 0).alias("partial"),
        F.when(p % 3 == 0, 0.5).otherwise(0.0).alias("penalty"),
        F.when(p % 7 == 0, -0.5).alias("negative"),
    )


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers sit parts: taker, question_id, selected."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("taker"), F.col("l_partkey").alias("question_id"))
        .agg((F.max("l_quantity").cast("int") % 32).alias("mask"))
        .select("taker", "question_id", letters(F.col("mask")).alias("selected"))
    )


#: The same in SQL, with options as bits.
SQL = """
rules AS (
    SELECT p_partkey AS question_id, CAST(p_size % 31 + 1 AS BIGINT) AS cor, CAST(p_partkey % 5 + 1 AS DOUBLE) AS high,
           CASE WHEN p_partkey % 7 = 0 THEN -1.0 ELSE 0.0 END AS low, p_partkey % 4 = 0 AS single, p_partkey % 2 = 0 AS part,
           CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 0.0 END AS pen, CASE WHEN p_partkey % 7 = 0 THEN -0.5 END AS neg
    FROM part
), picks AS (
    SELECT l_suppkey AS taker, l_partkey AS question_id, CAST(max(l_quantity) AS BIGINT) % 32 AS sel
    FROM lineitem GROUP BY l_suppkey, l_partkey
), met AS (
    SELECT taker, question_id, sel, cor, high, low, single, part, pen, neg, bit_count(sel & cor) AS hits,
           bit_count(sel & (31 - cor)) AS wrong, bit_count(cor & (31 - sel)) AS missed, bit_count(cor) AS size
    FROM picks JOIN rules USING (question_id)
), scored AS (
    SELECT *, CASE WHEN wrong + missed = 0 OR (single AND hits > 0) THEN high
                   WHEN hits = 0 AND neg IS NOT NULL THEN least(neg, high)
                   WHEN part THEN greatest(low, least(high, high * hits / size - pen * wrong))
                   ELSE greatest(low, least(high, 0.0)) END AS points
    FROM met
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bench runs from orders: model, effort, entry, paper, run index, status and results of both classes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w = Window.partitionBy("entry_id", "subset").orderBy("run_id")
    o = table(spark, sf_dir, "orders").select(
        k.alias("run_id"),
        F.concat(F.lit("lab"), (c % 3).cast("string"), F.lit(":m"), (c % 12).cast("string")).alias("model"),
        F.substring("o_orderpriority", 1, 1).alias("effort"),
        F.concat(F.lit("m"), (c % 12).cast("string"), F.lit("-"), F.substring("o_orderpriority", 1, 1)).alias("entry_id"),
        F.concat(F.lit("exam"), (k % 3).cast("string"), F.lit("-115-s"), (k % 7).cast("string")).alias("subset"),
        F.when(F.col("o_orderstatus") == "F", "solve_error").when((F.col("o_orderstatus") == "P") & (k % 2 == 0), "grade_error").otherwise("ok").alias("status"),
        (k % 3).cast("double").alias("judge_awarded"),
        F.lit(3.0).alias("judge_max"),
        (k % 41).cast("double").alias("det_awarded"),
        F.when(k % 3 == 0, 0.0).otherwise(40.0).alias("det_max"),
        F.col("o_totalprice").alias("secs"),
    )
    return o.withColumn("det_awarded", F.least("det_awarded", "det_max")).withColumn("run_index", F.row_number().over(w).cast("int"))


RUNS_SQL = """
base AS (
    SELECT o_orderkey AS run_id, 'lab' || (o_custkey % 3) || ':m' || (o_custkey % 12) AS model, substr(o_orderpriority, 1, 1) AS effort,
           'm' || (o_custkey % 12) || '-' || substr(o_orderpriority, 1, 1) AS entry_id,
           'exam' || (o_orderkey % 3) || '-115-s' || (o_orderkey % 7) AS subset,
           CASE WHEN o_orderstatus = 'F' THEN 'solve_error' WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'grade_error' ELSE 'ok' END AS status,
           CAST(o_orderkey % 3 AS DOUBLE) AS judge_awarded, 3.0 AS judge_max,
           least(CAST(o_orderkey % 41 AS DOUBLE), CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 40.0 END) AS det_awarded,
           CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 40.0 END AS det_max, o_totalprice AS secs
    FROM orders
), runs AS (
    SELECT *, row_number() OVER (PARTITION BY entry_id, subset ORDER BY run_id) AS run_index FROM base
)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry x paper roll-up of ``runs`` in the shape of ``results.paper_results``; three repeats, each the mean of its orders."""
    ok = F.col("status") == "ok"
    cols = {"d": "det_awarded", "dm": "det_max", "j": "judge_awarded", "jm": "judge_max", "secs": "secs"}
    reps = (
        runs(spark, sf_dir)
        .withColumn("rep", F.floor(F.col("run_id") / 21) % 3)
        .groupBy("entry_id", "subset", "rep")
        .agg(*(F.avg(F.when(ok, F.col(c))).alias(k) for k, c in cols.items()))
    )
    s = F.filter(F.array_sort(F.collect_list(F.struct("rep", (F.col("d") + F.col("j")).alias("t"), "d"))), lambda x: x["d"].isNotNull())
    per = reps.groupBy("entry_id", "subset").agg(F.count("d").alias("ok_runs"), *(F.avg(k).alias(k) for k in cols), s.alias("s"))
    return per.select(
        "entry_id", "subset", "ok_runs", F.col("d").alias("deterministic_awarded"), F.col("dm").alias("deterministic_covered_max"),
        F.col("j").alias("judge_awarded"), F.col("jm").alias("judge_covered_max"), F.col("secs").alias("solve_secs"),
        F.lit(10).alias("deterministic_questions"), F.lit(1).alias("deterministic_skipped"), F.lit(2).alias("judge_questions"), F.lit(0).alias("judge_skipped"),
        F.transform("s", lambda x: x["t"]).alias("awarded_samples"),
        F.transform("s", lambda x: x["d"]).alias("det_awarded_samples"),
    )


PAPERS_SQL = RUNS_SQL + """,
reps AS (
    SELECT entry_id, subset, run_id // 21 % 3 AS rep, avg(det_awarded) FILTER (status = 'ok') AS da, avg(det_max) FILTER (status = 'ok') AS dm,
           avg(judge_awarded) FILTER (status = 'ok') AS ja, avg(judge_max) FILTER (status = 'ok') AS jm, avg(secs) FILTER (status = 'ok') AS secs
    FROM runs GROUP BY ALL
), nth AS (
    SELECT *, row_number() OVER (PARTITION BY entry_id, subset ORDER BY rep) AS sample FROM reps WHERE da IS NOT NULL
), papers AS (
    SELECT entry_id, subset, count(da) AS ok_runs, avg(da) AS da, avg(dm) AS dm, avg(ja) AS ja, avg(jm) AS jm, avg(secs) AS secs FROM reps GROUP BY entry_id, subset
)"""


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study rows from events: five judges, eight sheets, 24 questions; p has a question effect."""
    q = (F.col("user_id") % 24).cast("long")
    w = Window.partitionBy("qid", "sheet", "judge").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(
        q.alias("qid"),
        (F.col("event_id") % 8).alias("sheet"),
        F.col("event_type").alias("judge"),
        (0.8 * q / 23 + 0.2 * F.col("value") / 499.7).alias("p"),
        (q % 4).alias("stratum"),
        (F.length("event_type") % 2).cast("string").alias("jfam"),
        (F.col("event_id") % 2).cast("string").alias("wfam"),
        (F.col("event_id") % 97).alias("len"),
        "ts",
        "event_id",
    )
    return e.withColumn("rep", F.row_number().over(w))


STUDY_SQL = """
study AS (
    SELECT user_id % 24 AS qid, event_id % 8 AS sheet, event_type AS judge, 0.8 * (user_id % 24) / 23 + 0.2 * value / 499.7 AS p,
           (user_id % 24) % 4 AS stratum, CAST(length(event_type) % 2 AS VARCHAR) AS jfam, CAST(event_id % 2 AS VARCHAR) AS wfam, event_id % 97 AS len,
           row_number() OVER (PARTITION BY user_id % 24, event_id % 8, event_type ORDER BY ts, event_id) AS rep
    FROM events
), cells AS (
    SELECT qid, sheet, judge, avg(p) AS p FROM study GROUP BY qid, sheet, judge
)"""


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed question numbers per customer nation: orders' keys leave gaps, some numbers are ranges."""
    c = table(spark, sf_dir, "customer")
    n = F.floor(F.col("c_custkey") / 25).cast("int") + 1
    shown = F.when(n % 5 == 0, F.concat(n.cast("string"), F.lit("-"), (n + 1).cast("string"))).when(n % 3 == 0, F.concat(F.lit("第 "), n.cast("string"), F.lit(" 題"))).otherwise(F.concat(F.lit("Q"), n.cast("string"), F.lit(".")))
    return c.select(F.col("c_nationkey").alias("doc"), n.alias("n"), shown.alias("number")).distinct().withColumn("pos", F.row_number().over(Window.partitionBy("doc").orderBy("n")))


NUMBERS_SQL = """
numbers AS (
    SELECT DISTINCT c_nationkey AS doc, CAST(c_custkey // 25 AS INT) + 1 AS n FROM customer
), covered AS (
    SELECT DISTINCT doc, x AS n FROM (SELECT doc, n AS x FROM numbers UNION ALL SELECT doc, n + 1 FROM numbers WHERE n % 5 = 0)
)"""

"""Queries: texts, selections, seams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import render as R
from scorewright.operators import seams, structure
from scorewright.plans import adapters as A
from scorewright.plans import boards, exams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'A, C' WHEN 1 THEN CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END ELSE 'a: ' || o_orderstatus || chr(10) || 'b: ' || o_orderpriority END AS shown FROM orders"""
)
def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "multiple_choice").when(k % 3 == 1, "true_false").otherwise("fill_in_blank")
    blanks = F.create_map(F.lit("b"), F.col("o_orderpriority"), F.lit("a"), F.col("o_orderstatus"))
    shown = R.answer_text(kind, F.array(F.lit("C"), F.lit("A")), F.col("o_orderstatus") == "O", blanks, blanks, F.lit(""))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"))


@query(
    """WITH n AS (SELECT l_suppkey, 'order ' || l_orderkey AS t, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS nth, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem))
    SELECT l_suppkey, string_agg('- ' || t, chr(10) ORDER BY nth) || CASE WHEN max(n) > 5 THEN chr(10) || 'and ' || (max(n) - 5) || ' more' ELSE '' END AS lines FROM n WHERE nth <= 5 GROUP BY l_suppkey"""
)
def problem_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top five of each group, as the report shows them."""
    x = A.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct().withColumn("t", F.concat(F.lit("order "), F.col("l_orderkey").cast("string")))
    return R.problem_list(x, "l_suppkey", "t", "l_orderkey", 5)


@query(f"WITH {A.PAPERS_SQL} SELECT DISTINCT subset FROM papers WHERE subset LIKE 'exam1-%' OR subset = 'exam2-115-s3'")
def parse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parse_selection(F.lit("exam1, exam2-115-s3"), boards._meta(spark, sf_dir).select("subset", "exam"), spark).select("subset")


@query("SELECT p_partkey, CAST(p_partkey % 3 AS BIGINT) AS a, CAST(7 AS BIGINT) AS b FROM part")
def last_entry_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("bigint").alias("value"))
    p = F.col("p_partkey")
    m = R.last_entries(F.array(e("a", F.lit(1)), e("b", F.lit(7)), e("a", p % 3)))
    return A.table(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("SELECT p_partkey AS question_id, CASE WHEN p_partkey % 4 = 2 THEN p_name END AS reference_answer FROM part WHERE p_partkey % 4 IN (2, 3) AND p_partkey % 4 = 2 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey % 4 = 3")
def ablation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "part")
    rules = p.select(F.col("p_partkey").alias("question_id"), F.array(F.col("p_brand")).alias("rubric"), F.col("p_type").alias("instructions"), F.col("p_name").alias("reference_answer"))
    strata = p.select(F.col("p_partkey").alias("question_id"), F.get(F.array(*map(F.lit, "ABCD")), (F.col("p_partkey") % 4).cast("int")).alias("stratum"))
    return R.derive_ablation(rules, strata, ["C", "D"]).where("rubric IS NULL AND instructions IS NULL").select("question_id", "reference_answer")


@query(f"WITH {boards._scores_sql(False)} SELECT entry_id FROM scores WHERE eligible ORDER BY round(micro, 9) DESC, entry_id LIMIT 4")
def top_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leaders of the radar."""
    s = boards._scores(spark, sf_dir).where("eligible")
    return s.orderBy(F.round("micro", 9).desc(), "entry_id").select("entry_id").limit(4)


@query("SELECT s_suppkey % 4 AS run, count(*) AS questions, count(*) FILTER (s_suppkey % 5 <> 0) AS ok FROM supplier GROUP BY ALL")
def solve_with_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic stand-in solver that fails on every fifth question."""
    s = A.table(spark, sf_dir, "supplier")
    q = s.select((F.col("s_suppkey") % 4).cast("string").alias("run_id"), F.col("s_suppkey").cast("string").alias("question_id"), F.to_json(F.struct("s_suppkey")).alias("question"))

    def solver(question: dict) -> dict:
        if question["s_suppkey"] % 5 == 0:
            raise ValueError("no answer")
        return {"type": "true_false", "value": question["s_suppkey"] % 2 == 0}

    out = seams.solve(q, solver)
    return out.groupBy(F.col("run_id").cast("bigint").alias("run")).agg(F.count("*").alias("questions"), F.count_if(F.col("status") == "ok").alias("ok"))


@query(
    """SELECT 'c' || o_custkey AS exam_id, count(*) AS questions, CAST(sum(CASE o_orderkey % 4 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END) AS BIGINT) AS strings,
    count(*) FILTER (o_orderkey % 4 IN (0, 2)) AS enums FROM orders GROUP BY o_custkey"""
)
def answer_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.answer_schema(structure.leaves(exams.nodes(spark, sf_dir)))
    required = F.from_json(F.get_json_object("schema", "$.properties.answers.required"), "array<string>")
    count = lambda rx: F.size(F.regexp_extract_all("schema", F.lit(rx), F.lit(0))).cast("bigint")
    return s.select("exam_id", F.size(required).cast("bigint").alias("questions"), count(r'\{"type": "string"\}').alias("strings"), count(r'\{"enum": ').alias("enums"))

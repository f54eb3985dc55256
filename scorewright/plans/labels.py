"""Queries of small texts and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import labels
from scorewright.operators import leaderboard
from scorewright.plans import adapters as A

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
    """WITH u AS (SELECT l_orderkey, count(*) AS r, CAST(sum(l_partkey) AS BIGINT) * 1000 AS i, CAST(sum(l_suppkey) AS BIGINT) * 7 AS o, CASE WHEN l_orderkey % 2 = 0 THEN sum(l_linenumber) * 1000 ELSE 0 END AS x, CASE WHEN l_orderkey % 3 = 0 THEN count(*) * 5 ELSE 0 END AS w FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, 'Tokens: ' || format('{:,}', i) || ' in / ' || format('{:,}', o) || ' out' || CASE WHEN x > 0 AND w > 0 THEN ' (reasoning ' || format('{:,}', CAST(x AS BIGINT)) || ', cache write ' || format('{:,}', CAST(w AS BIGINT)) || ')' WHEN x > 0 THEN ' (reasoning ' || format('{:,}', CAST(x AS BIGINT)) || ')'
    WHEN w > 0 THEN ' (cache write ' || format('{:,}', CAST(w AS BIGINT)) || ')' ELSE '' END || ' over ' || r || ' request(s)' AS line FROM u"""
)
def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as requests."""
    k = F.col("l_orderkey")
    u = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("r"), (F.sum("l_partkey") * 1000).alias("i"), (F.sum("l_suppkey") * 7).alias("o"), (F.sum("l_linenumber") * 1000).alias("x"))
    return u.select("l_orderkey", labels.usage_line(F.col("r"), F.col("i"), F.col("o"), F.when(k % 2 == 0, F.col("x")).otherwise(0), F.lit(0), F.when(k % 3 == 0, F.col("r") * 5).otherwise(0)).alias("line"))


_PROVIDERS = ["openai", "google", "codex", "claude", "elsewhere"]
_EFFORTS = ["minimal", "low", "medium", "high", "xhigh", "max"]


@query(
    f"""WITH m AS (SELECT c_custkey, {_PROVIDERS}[c_custkey % 5 + 1] AS p, {_EFFORTS}[c_custkey % 7 + 1] AS e FROM customer)
    SELECT c_custkey, CASE WHEN p = 'elsewhere' OR e IS NULL THEN NULL WHEN p = 'google' AND e IN ('xhigh', 'max') THEN 'high' WHEN p = 'codex' AND e = 'max' THEN 'xhigh' WHEN p = 'claude' AND e = 'minimal' THEN 'low' ELSE e END AS setting, p IN ('codex', 'claude') AS harness FROM m"""
)
def effort_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as models of five providers and with six efforts or none."""
    k = F.col("c_custkey")
    provider, effort = F.get(F.array(*map(F.lit, _PROVIDERS)), (k % 5).cast("int")), F.get(F.array(*map(F.lit, _EFFORTS)), (k % 7).cast("int"))
    model = F.concat(provider, F.lit(":m"), k.cast("string"))
    return A.table(spark, sf_dir, "customer").select("c_custkey", labels.effort_setting(model, effort).alias("setting"), labels.is_harness(model, ["codex", "claude"]).alias("harness"))


@query(
    """SELECT DISTINCT CASE WHEN s_suppkey % 4 = 0 THEN 'codex:' ELSE 'lab:' END || s_suppkey AS model, CASE WHEN s_suppkey % 5 = 0 THEN 'no such model' WHEN s_suppkey % 4 = 0 THEN 'opens files' ELSE 'applies' END AS effect FROM supplier WHERE s_suppkey % 3 = 0"""
)
def text_only_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the suppliers is declared to read text only; a fifth of all is no model."""
    k = F.col("s_suppkey")
    s = A.table(spark, sf_dir, "supplier").select(k, F.concat(F.when(k % 4 == 0, "codex:").otherwise("lab:"), k.cast("string")).alias("model"))
    return labels.text_only(s.where(k % 3 == 0), s.where(k % 5 != 0), ["codex"])


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'gi')")
def names_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.named_like(A.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "GI", "p_name")


@query("SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS day, CASE WHEN count(*) FILTER (o_orderkey % 2 = 0) > 0 THEN count(*) FILTER (o_orderkey % 6 = 0) || '/' || count(*) FILTER (o_orderkey % 2 = 0) ELSE '–' END AS delta FROM orders GROUP BY o_custkey")
def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's last day, and its orders as questions: every second has several judges, every sixth divides them."""
    k = F.col("o_orderkey")
    o = A.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"), F.count_if(k % 6 == 0).alias("d"), F.count_if(k % 2 == 0).alias("n"))
    return o.select("o_custkey", labels.card_date(F.col("at")).alias("day"), labels.judge_delta(F.col("d"), F.col("n")).alias("delta"))


@query(
    """SELECT c_nationkey, CASE WHEN least(100, min(c_acctbal / 100)) < 0 THEN 0.0 ELSE least(floor(least(100, min(c_acctbal / 100)) / 5) * 5.0, 80.0) END AS radar, least(greatest(floor(min(c_acctbal / 100) / 5) * 5.0, 0), 80.0) AS board FROM customer GROUP BY c_nationkey"""
)
def axis_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min(F.col("c_acctbal") / 100).alias("least"))
    return c.select("c_nationkey", labels.radar_floor(F.col("least")).alias("radar"), leaderboard.score_floor(F.col("least")).alias("board"))

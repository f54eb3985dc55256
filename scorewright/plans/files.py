"""Queries of sources and sinks: files are written into the shared folder from the tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.plans import adapters as A
from scorewright.session import shared_folder
from scorewright.sources import folders, io

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's quantity by line number."""
    return A.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("awarded"), F.count("*").alias("n"))


def _bytes(document: Column) -> Column:
    return F.encode(F.to_json(document, {"pretty": "true"}), "UTF-8")


def bench_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bench folder per nation: suppliers are runs of four models, every fifth failed; the others have a report of seven questions."""
    s, key = A.table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    folder = F.concat(F.lit("runs/n"), F.col("s_nationkey").cast("string")).alias("folder")
    report = F.concat(key, F.lit("-report.json"))
    ok = F.col("s_suppkey") % 5 != 0
    row = F.struct(
        F.col("s_suppkey").alias("run_index"), F.concat(F.lit("m"), (F.col("s_suppkey") % 4).cast("string")).alias("model"), F.concat(F.lit("run-"), key).alias("slug"),
        F.when(ok, "ok").otherwise("failed").alias("status"), F.when(ok, report).alias("report_path"),
    )
    bench = s.groupBy(folder, "s_nationkey").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    document = F.struct(F.lit("exam").alias("exam_id"), F.concat(F.lit("/data/n"), F.col("s_nationkey").cast("string")).alias("bundle_dir"), "rows")
    benches = bench.select("folder", F.lit("bench.json").alias("name"), _bytes(document).alias("content"))
    question = F.struct(F.lit("deterministic").alias("mode"), (F.col("n") * 50.0).alias("max_points"), "awarded")
    results = _lines(spark, sf_dir).groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("q"), F.col("l_linenumber").cast("string")), question))).alias("results"))
    reports = s.where(ok).join(results, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(folder, report.alias("name"), _bytes(F.struct(F.coalesce("results", F.create_map().cast(results.schema["results"].dataType)).alias("results"))).alias("content"))
    return benches.unionByName(reports)


@query(
    """WITH l AS (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS a FROM lineitem GROUP BY ALL), x AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 4 IN (1, 2) AND s_suppkey % 5 <> 0)
    SELECT 'n' || s_nationkey AS subset, 'm' || s_suppkey % 4 AS model, count(DISTINCT s_suppkey) AS runs, count(l_linenumber) AS questions, coalesce(round(sum(a), 6), 0) AS awarded FROM x LEFT JOIN l ON l_suppkey = s_suppkey GROUP BY ALL"""
)
def bench_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished runs of two models from bench files; reports of the others stay closed."""
    path = shared_folder(spark, "bench")
    folders.write_folders(bench_files(spark, sf_dir), path)
    runs = folders.read_runs(spark, path).where("model IN ('m1', 'm2') AND status = 'ok'")
    total = F.aggregate("results", F.lit(0.0), lambda s, q: s + q["awarded"])
    return runs.groupBy("subset", "model").agg(F.count("*").alias("runs"), F.sum(F.size("results")).alias("questions"), F.round(F.sum(total), 6).alias("awarded"))


@query(
    """WITH l AS (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS a FROM lineitem GROUP BY ALL)
    SELECT 'e-' || l_suppkey AS entry_id, count(*) AS papers, round(sum(CASE WHEN l_suppkey % 3 = 0 THEN 2 * a ELSE a END), 6) AS awarded FROM l WHERE l_suppkey % 3 <> 0 OR l_linenumber <= 3 GROUP BY l_suppkey"""
)
def entry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are entries, line numbers their papers; a third of the entries is published again with fewer papers and twice the points."""
    path = shared_folder(spark, "entries")
    entry = F.concat(F.lit("e-"), F.col("l_suppkey").cast("string")).alias("entry_id")
    lines = _lines(spark, sf_dir)
    paper = lambda times: (entry, F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("subset"), F.lit(1).alias("ok_runs"), (times * F.col("awarded")).alias("deterministic_awarded"))
    first = lines.select(*paper(1))
    again = lines.where("l_suppkey % 3 = 0 AND l_linenumber <= 3").select(*paper(2))
    for papers in (first, again):
        folders.write_folders(io.entry_documents(papers.select("entry_id").distinct(), papers), path)
    return io.read_entries(spark, path).groupBy("entry_id").agg(F.count("*").alias("papers"), F.round(F.sum("deterministic_awarded"), 6).alias("awarded"))


@query(
    """WITH l AS (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS a, count(*) AS n FROM lineitem GROUP BY ALL), ok AS (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0)
    SELECT 'n' || s_nationkey AS subset, 'm' || s_suppkey % 4 AS model, count(DISTINCT s_suppkey) AS runs, count(l_linenumber) AS questions, coalesce(round(sum(a), 6), 0) AS awarded FROM ok LEFT JOIN l ON l_suppkey = s_suppkey GROUP BY ALL
    UNION ALL SELECT 'n' || s_nationkey, 'm' || s_suppkey % 4, count(*), 0, 0 FROM supplier WHERE s_suppkey % 5 = 0 GROUP BY ALL"""
)
def loaded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs below a folder by Spark's JSON reader, joined with their reports."""
    path = shared_folder(spark, "loaded")
    folders.write_folders(bench_files(spark, sf_dir), path)
    total = F.coalesce(F.aggregate("results", F.lit(0.0), lambda s, q: s + q["awarded"]), F.lit(0.0))
    runs = io.load_runs(spark, path).withColumns({"_n": F.coalesce(F.size("results"), F.lit(0)), "_a": total})
    return runs.groupBy("subset", "model", "status").agg(F.count("*").alias("runs"), F.sum("_n").alias("questions"), F.round(F.sum("_a"), 6).alias("awarded")).drop("status")


@query("SELECT 'e' || l_suppkey % 5 AS entry_id, count(*) AS questions, round(sum(a), 6) AS awarded FROM (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS a FROM lineitem GROUP BY ALL) GROUP BY ALL")
def question_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question table in one folder per entry; one entry is written twice and stands there once."""
    path = shared_folder(spark, "questions")
    rows = _lines(spark, sf_dir).select(F.concat(F.lit("e"), (F.col("l_suppkey") % 5).cast("string")).alias("entry_id"), F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("question"), "awarded")
    io.write_questions(rows, path)
    io.write_questions(rows.where("entry_id = 'e1'"), path)
    return spark.read.parquet(path).groupBy("entry_id").agg(F.count("*").alias("questions"), F.round(F.sum("awarded"), 6).alias("awarded"))

"""Queries of the smaller operators: keys, pages, gaps, checks, statuses, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import text as T
from scorewright.operators import grading, ingest, judging, leaderboard, reliability, results, seams, structure
from scorewright.plans import adapters as A
from scorewright.plans import grading as G
from scorewright.sources import io

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
    """SELECT CAST(p_partkey % 7 AS VARCHAR) AS exam_id, CAST(p_partkey AS VARCHAR) AS question_id, 'no rule' AS problem FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 3 <> 0
    UNION ALL SELECT CAST(p_partkey % 7 AS VARCHAR), CAST(p_partkey AS VARCHAR), 'no leaf' FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0"""
)
def missing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as questions: those divisible by 3 have no leaf, those by 5 no rule."""
    p = F.col("p_partkey")
    q = A.table(spark, sf_dir, "part").select((p % 7).cast("string").alias("exam_id"), p.cast("string").alias("question_id"), p)
    return grading.missing_rules(q.where(p % 3 != 0), q.where(p % 5 != 0))


@query(
    """WITH k AS (SELECT o_custkey AS doc, CAST(o_orderkey % 9 AS VARCHAR) AS key, min(o_orderkey) AS pos FROM orders GROUP BY ALL),
    l AS (SELECT c_custkey AS doc, c_custkey % 9 AS a, (c_custkey + 4) % 9 AS b FROM customer)
    SELECT l.doc, coalesce(x.key, y.key) AS key, coalesce(x.pos, y.pos) AS answer FROM l LEFT JOIN k x ON x.doc = l.doc AND x.key = CAST(l.a AS VARCHAR) LEFT JOIN k y ON y.doc = l.doc AND y.key = CAST(l.b AS VARCHAR)"""
)
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question of each customer with two printed candidates, among the keys that its orders make."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    entries = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("pos"), F.concat(F.lit("Q"), (k % 9).cast("string"), F.lit(".")).alias("question_number"), k.alias("answer"))
    keys = ingest.merge_keys(entries, ["doc"], ["answer"])
    leaves = A.table(spark, sf_dir, "customer").select(c.alias("doc"), c.cast("string").alias("question_id"), F.array(F.concat((c % 9).cast("string"), F.lit(")")), F.concat(F.lit("第"), ((c + 4) % 9).cast("string"), F.lit("題"))).alias("candidates"))
    return ingest.match_keys(leaves, keys, ["doc"]).select("doc", "key", "answer")


@query(
    """WITH b AS (SELECT c_custkey AS doc, i AS pos, 'b' || i AS blank_id, '(' || chr(CAST(105 + i AS INT)) || ')' AS label FROM customer, range(3) t(i)),
    a AS (SELECT c_custkey AS doc, i AS pos, CASE c_custkey % 4 WHEN 0 THEN ' B' || ((i + 1) % 3) || ' ' WHEN 1 THEN '(' || chr(CAST(73 + i AS INT)) || ')' WHEN 2 THEN 'x' || i ELSE 'y' || i END AS key, c_custkey * 10 + i AS v FROM customer, range(3) t(i) WHERE NOT (c_custkey % 4 = 3 AND i = 2)),
    n AS (SELECT doc, count(*) AS k FROM a GROUP BY doc)
    SELECT b.doc, b.blank_id, coalesce(x.v, y.v, p.v) AS v FROM b JOIN n ON n.doc = b.doc LEFT JOIN a x ON x.doc = b.doc AND lower(trim(x.key)) = b.blank_id LEFT JOIN a y ON y.doc = b.doc AND lower(trim(y.key)) = b.label LEFT JOIN a p ON p.doc = b.doc AND p.pos = b.pos AND n.k = 3"""
)
def match_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three blanks for each customer: keys by id, by label, by place, and two keys only, which match nothing."""
    c, i = F.col("c_custkey"), F.col("pos")
    base = A.table(spark, sf_dir, "customer").select(c, F.posexplode(F.array(*map(F.lit, "ijk"))).alias("pos", "letter"))
    label = F.concat(F.lit("("), "letter", F.lit(")"))
    blanks = base.select(c.alias("doc"), "pos", F.concat(F.lit("b"), i.cast("string")).alias("blank_id"), label.alias("label"))
    shown = (
        F.when(c % 4 == 0, F.concat(F.lit(" B"), ((i + 1) % 3).cast("string"), F.lit(" ")))
        .when(c % 4 == 1, F.upper(label))
        .when(c % 4 == 2, F.concat(F.lit("x"), i.cast("string")))
        .otherwise(F.concat(F.lit("y"), i.cast("string")))
    )
    answers = base.where(~((c % 4 == 3) & (i == 2))).select(c.alias("doc"), "pos", shown.alias("key"), F.array((c * 10 + i).cast("bigint")).alias("values"))
    return ingest.match_blanks(blanks, answers, ["doc"]).select("doc", "blank_id", F.get("values", F.lit(0)).alias("v"))


@query(
    """WITH p AS (SELECT page_id % 13 AS doc, page_id, CASE WHEN page_id % 13 = 5 THEN 'cover' WHEN page_id % 4 = 0 THEN 'answer_key' WHEN page_id % 4 = 1 THEN 'questions' ELSE 'questions' END AS role FROM pages)
    SELECT doc, page_id AS page_index, role, role = 'questions' OR doc = 5 AS is_question_page FROM p"""
)
def route_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the pages hold keys, half are unclassified; document 5 has covers only, so all its pages are read."""
    i, doc = F.col("page_id"), (F.col("page_id") % 13).alias("doc")
    pages = A.table(spark, sf_dir, "pages")
    roles = pages.where((i % 13 == 5) | (i % 4 < 2)).select(doc, i.alias("page_index"), F.when(i % 13 == 5, "cover").when(i % 4 == 0, "answer_key").otherwise("questions").alias("role"))
    return ingest.route_pages(pages.select(doc, i.alias("page_index")), roles)


_GAPS = f"""{A.NUMBERS_SQL}, nxt AS (SELECT doc, n, lead(n) OVER (PARTITION BY doc ORDER BY n) AS m FROM covered),
    gaps AS (SELECT doc, n + 1 AS first, m - 1 AS last FROM nxt WHERE m > n + 1)"""


@query(f"WITH {_GAPS} SELECT doc, first, last, CAST(x // 5 AS INT) AS chunk FROM (SELECT doc, first, last, first - 1 AS x FROM gaps UNION SELECT doc, first, last, last + 1 FROM gaps) GROUP BY ALL")
def gap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of five numbers each that hold a gap's neighbours."""
    n = A.numbers(spark, sf_dir)
    have = n.select("doc", F.explode(T.covered_numbers(F.col("number"))).alias("n")).distinct()
    return ingest.gap_chunks(ingest.find_gaps(n, ["doc"]), have.withColumn("chunk", F.floor(F.col("n") / 5).cast("int")), ["doc"])


@query(
    """WITH k AS (SELECT DISTINCT o_custkey AS doc, o_orderkey % 12 + 1 AS n FROM orders), x AS (SELECT doc, n, lead(n) OVER (PARTITION BY doc ORDER BY n) AS m FROM k),
    g AS (SELECT doc, count(*) AS runs, sum(m - n - 1) AS missing FROM x WHERE m > n + 1 GROUP BY doc), c AS (SELECT doc, count(*) AS n FROM k GROUP BY doc)
    SELECT doc, runs, CAST(missing AS BIGINT) AS missing FROM g JOIN c USING (doc) WHERE runs <= 5 AND missing <= greatest(10, n / 5.0)"""
)
def repair_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question number of each of a customer's orders, from 1 to 12."""
    n = F.col("o_orderkey") % 12 + 1
    q = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), n.cast("string").alias("number"), n.alias("pos")).distinct()
    return ingest.repair_allowed(ingest.find_gaps(q, ["doc"]), q, ["doc"]).select("doc", "runs", F.col("missing").cast("bigint").alias("missing"))


@query(
    """WITH u AS (SELECT c_custkey, CAST(c_custkey * 7919 % 1000 AS DOUBLE) AS score, CAST(floor(c_acctbal / 100) + c_custkey * 7919 % 1000 AS DOUBLE) AS cost FROM customer)
    SELECT c_custkey, max(score) OVER (ORDER BY cost, score DESC ROWS UNBOUNDED PRECEDING) AS best FROM u WHERE cost > 0"""
)
def step_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") * 7919 % 1000
    points = A.table(spark, sf_dir, "customer").select("c_custkey", k.cast("double").alias("score"), (F.floor(F.col("c_acctbal") / 100) + k).cast("double").alias("cost"))
    return leaderboard.step_frontier(points).select("c_custkey", F.col("best_so_far").alias("best"))


@query("SELECT DISTINCT o_orderkey % 3 + 1 AS run_index, 'm' || (o_custkey % 12) AS model FROM orders, range(3) t(i)")
def run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three repeats of every model."""
    m = A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 12).alias("pos")).distinct().withColumn("model", F.concat(F.lit("m"), F.col("pos").cast("string")))
    return results.run_order(m, 3).select(F.col("run_index").cast("bigint").alias("run_index"), "model")


@query(
    """SELECT o_orderkey, CASE WHEN t IN ('single_choice', 'multiple_choice') AND n < 2 THEN 'short_answer' WHEN t = 'matching' AND n < 1 THEN 'short_answer' WHEN t = 'composite' AND n < 1 THEN 'short_answer' ELSE t END AS type, CASE WHEN n > 0 THEN CAST(n AS DOUBLE) ELSE 1.0 END AS points
    FROM (SELECT o_orderkey, ['single_choice', 'multiple_choice', 'matching', 'composite', 'essay'][CAST(o_orderkey % 5 + 1 AS INT)] AS t, o_orderkey % 4 - 1 AS n FROM orders)"""
)
def coerced_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n, t = k % 4 - 1, F.get(F.array(*map(F.lit, ("single_choice", "multiple_choice", "matching", "composite", "essay"))), (k % 5).cast("int"))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", ingest.coerced_type(t, n, n, n).alias("type"), ingest.default_points(n.cast("double")).alias("points"))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END, 0) + coalesce(CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey END, 0) AS tokens FROM lineitem")
def row_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    tokens = results.row_tokens(F.when(n % 2 == 0, F.col("l_partkey")), F.when(n % 3 == 0, F.col("l_suppkey")))
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tokens.alias("tokens"))


@query(f"WITH {A.STUDY_SQL}, d AS (SELECT judge, abs(p - avg(p) OVER (PARTITION BY qid, sheet)) AS d FROM cells) SELECT judge, round(avg(d), 6) AS mae FROM d GROUP BY judge")
def mae_include_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.leave_one_out(reliability.cells(A.study(spark, sf_dir)), include_self=True).withColumn("mae", F.round("mae", 6))


@query(f"WITH {A.STUDY_SQL}, m AS (SELECT sheet, qid, avg(p) AS m FROM study GROUP BY ALL) SELECT sheet, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sd, round(min(m), 6) AS least FROM m GROUP BY sheet")
def writer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.writers(A.study(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean", "sd", "least")})


@query(
    f"""WITH {A.STUDY_SQL}, w AS (SELECT sheet, avg(p) FILTER (judge < 'm') AS a, avg(p) FILTER (judge >= 'm') AS b FROM study GROUP BY sheet)
    SELECT sheet, row_number() OVER (ORDER BY a DESC NULLS LAST, sheet) AS rank_a, row_number() OVER (ORDER BY b DESC NULLS LAST, sheet) AS rank_b FROM w"""
)
def writer_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.study(spark, sf_dir)
    names = sorted(r["judge"] for r in rows.select("judge").distinct().collect())  # a handful of judges
    out = reliability.writer_ranks(rows, [n for n in names if n < "m"], [n for n in names if n >= "m"])
    return out.select("sheet", F.col("rank_a").cast("bigint").alias("rank_a"), F.col("rank_b").cast("bigint").alias("rank_b"))


@query(
    f"""WITH {A.STUDY_SQL}, m AS (SELECT wfam AS condition, qid, sheet, avg(p) AS m, max(p) - min(p) AS r FROM study GROUP BY ALL),
    c AS (SELECT wfam AS condition, qid, sheet, judge, avg(p) AS p FROM study WHERE sheet NOT IN (0, 1, 7) GROUP BY ALL),
    f AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY condition, qid, sheet) AS k FROM c) JOIN (SELECT condition, count(DISTINCT judge) AS all_k FROM c GROUP BY condition) USING (condition) WHERE k = all_k),
    x AS (SELECT *, avg(p) OVER (PARTITION BY condition, qid, sheet) AS rm, avg(p) OVER (PARTITION BY condition, judge) AS cm, avg(p) OVER (PARTITION BY condition) AS g FROM f),
    ss AS (SELECT condition, count(DISTINCT (qid, sheet)) AS n, count(DISTINCT judge) AS k, sum((rm - g) ** 2) AS r, sum((cm - g) ** 2) AS c, sum((p - g) ** 2) AS t FROM x GROUP BY condition),
    ms AS (SELECT condition, n, k, r / (n - 1) AS msr, c / (k - 1) AS msc, (t - r - c) / ((n - 1) * (k - 1)) AS mse FROM ss),
    i AS (SELECT condition, n AS icc_answers, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc FROM ms), t AS (
    SELECT condition, count(*) FILTER (sheet NOT IN (0, 1, 7)) AS answers, round(avg(r) FILTER (sheet NOT IN (0, 1, 7)), 6) AS disagreement, round(avg(m) FILTER (sheet NOT IN (0, 1, 7)), 6) AS mean,
    round(avg(m) FILTER (sheet IN (0, 1)), 6) AS empty_mean, round(avg(m) FILTER (sheet = 7), 6) AS reference_mean FROM m GROUP BY condition) SELECT * FROM t LEFT JOIN i USING (condition)"""
)
def condition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets 0 and 1 are empty anchors, sheet 7 is the reference."""
    sheet = F.when(F.col("sheet") <= 1, "empty").when(F.col("sheet") == 7, "reference").otherwise(F.col("sheet").cast("string"))
    rows = A.study(spark, sf_dir).withColumn("sheet", sheet).withColumnRenamed("wfam", "condition")
    out = reliability.conditions(rows, "empty", "reference")
    return out.withColumns({c: F.round(c, 6) for c in ("icc", "disagreement", "mean", "empty_mean", "reference_mean")})


@query(
    """SELECT o_orderkey, 'j' || j AS judge, CASE WHEN (o_orderkey + j) % 5 IN (1, 2) THEN NULL ELSE CAST(o_orderkey % 10 + j AS DOUBLE) / 2 END AS total,
    CASE (o_orderkey + j) % 5 WHEN 1 THEN 'not readable' WHEN 2 THEN 'no total' WHEN 3 THEN 'bad criteria' END AS problem, CASE (o_orderkey + j) % 5 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS scores
    FROM orders, range(3) t(j) WHERE j < o_orderkey % 4"""
)
def zipped_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four verdicts for three judges; two in five are broken, one in five has a broken criterion."""
    k = F.col("o_orderkey")

    def verdict(j: int):
        of, total = (k + j) % 5, ((k % 10 + j) / 2).cast("string")
        good = F.concat(F.lit('{"total_points": '), total, F.lit(', "rationale": "r", "criteria": [{"id": "a", "points": 1}, {"id": "b", "points": 0.5}]}'))
        odd = F.concat(F.lit('{"total_points": '), total, F.lit(', "criteria": [{"id": "a", "points": 1}, {"id": "b", "points": "many"}]}'))
        return F.when(of == 1, F.lit('{"total_points": 3,')).when(of == 2, F.lit('{"total_points": "high"}')).when(of == 3, odd).otherwise(good)

    o = A.table(spark, sf_dir, "orders")
    rows = o.select(F.lit("r").alias("run_id"), k.cast("string").alias("question_id"), F.array(*map(F.lit, ("j0", "j1", "j2"))).alias("judge_models"), F.slice(F.array(*map(verdict, range(4))), F.lit(1), (k % 4).cast("int")).alias("judge_verdicts"))
    out = judging.zipped_verdicts(rows)
    return out.select(F.col("question_id").cast("bigint").alias("o_orderkey"), "judge", "total", "problem", F.size("scores").alias("scores"))


@query(f"WITH {A.STUDY_SQL}, o AS (SELECT wfam, qid, sheet, max(len) AS n FROM study GROUP BY ALL) SELECT wfam, round(avg(n), 6) AS mean_length, count(*) AS answers FROM o GROUP BY wfam")
def family_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.family_lengths(A.study(spark, sf_dir)).withColumn("mean_length", F.round("mean_length", 6))


@query(f"WITH {A.PAPERS_SQL} SELECT subset FROM papers GROUP BY subset HAVING max(coalesce(dm, 0)) <= 0")
def dropped_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.dropped_papers(A.papers(spark, sf_dir))


@query(f"WITH {A.PAPERS_SQL} SELECT 'exam' || i || '-115-s' || j AS subset FROM range(5) a(i), range(9) b(j) EXCEPT SELECT subset FROM papers")
def unknown_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(45).select(F.concat(F.lit("exam"), (F.col("id") % 5).cast("string"), F.lit("-115-s"), F.floor(F.col("id") / 5).cast("string")).alias("subset"))
    return leaderboard.unknown_subsets(wanted, A.papers(spark, sf_dir))


@query("SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS number, least(greatest(0.0, floor(n_nationkey * 4.5 / 5) * 5.0), 80.0) AS axis FROM nation")
def stub_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = leaderboard.stub_numbers(A.table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey")
    return n.select("n_nationkey", F.col("number").cast("bigint").alias("number"), leaderboard.score_floor(F.col("n_nationkey") * 4.5).alias("axis"))


@query(
    f"""WITH {A.RUNS_SQL} SELECT entry_id, min(model) AS model, max(run_index) AS repeat, count(DISTINCT subset) AS papers, min(run_id) AS first_run_at, max(run_id) AS last_run_at FROM runs GROUP BY entry_id"""
)
def entry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.runs(spark, sf_dir).withColumns({"started_at": F.col("run_id"), "finished_at": F.lit(None).cast("bigint")})
    out = results.entries(r)
    return out.select("entry_id", "model", F.col("repeat").cast("bigint").alias("repeat"), "papers", "first_run_at", "last_run_at")


@query(f"WITH {A.RUNS_SQL} SELECT entry_id, subset, coalesce(string_agg(status, ',' ORDER BY run_index) FILTER (status <> 'ok'), '') AS failed FROM runs GROUP BY ALL")
def failed_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.failed_statuses(A.runs(spark, sf_dir)).withColumn("failed", F.array_join("failed", ","))


@query(
    f"""WITH {A.PAPERS_SQL}, twice AS (SELECT *, 'a' AS path FROM papers UNION ALL SELECT entry_id, subset, ok_runs, da / 2, dm, ja, jm, secs, 'b' FROM papers WHERE subset LIKE '%s1'),
    one AS (SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY entry_id, subset ORDER BY path DESC) = 1)
    SELECT entry_id, count(*) AS papers, round(sum(coalesce(da, 0) + coalesce(ja, 0)), 4) AS awarded FROM one GROUP BY entry_id"""
)
def reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers read from two folders; the later folder's are half as good."""
    p = A.papers(spark, sf_dir)
    half = p.where(F.col("subset").endswith("s1")).withColumn("deterministic_awarded", F.col("deterministic_awarded") / 2)
    out = results.reindex(p.withColumn("path", F.lit("a")).unionByName(half.withColumn("path", F.lit("b"))))
    return out.select("entry_id", "papers", F.round("awarded", 4).alias("awarded"))


@query(
    """WITH a AS (SELECT l_suppkey AS run, count(*) FILTER (l_linenumber % 2 = 0 AND l_suppkey % 7 <> 0) AS n, count(*) FILTER (l_linenumber = 4 AND l_suppkey % 5 <> 0) AS g FROM lineitem GROUP BY ALL)
    SELECT CAST(run AS VARCHAR) AS run_id, CASE WHEN n = 0 THEN 'solve_error' WHEN g = 0 THEN 'grade_error' ELSE 'ok' END AS status FROM a"""
)
def matrix_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    x = A.table(spark, sf_dir, "lineitem")
    answered = x.select(s.cast("string").alias("run_id"), F.when((n % 2 == 0) & (s % 7 != 0), "ok").otherwise("error").alias("status"))
    graded = x.select(s.cast("string").alias("run_id"), F.when((n == 4) & (s % 5 != 0), "deterministic").otherwise("error").alias("mode"))
    return seams.matrix_status(answered, graded)


@query(
    """WITH v AS (SELECT event_id, event_id % 4 AS k FROM events)
    SELECT event_id, CASE WHEN k = 0 THEN 'b' ELSE '' END AS missing, CASE WHEN k = 1 THEN 'z' ELSE '' END AS unknown, k = 2 AS repeated FROM v WHERE k <> 3"""
)
def verdict_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four verdicts one lacks a criterion, one has an unknown one, one repeats one, one is whole."""
    k = F.col("event_id") % 4
    ids = F.when(k == 0, F.array(F.lit("a"))).when(k == 1, F.array(*map(F.lit, "abz"))).when(k == 2, F.array(*map(F.lit, "aba"))).otherwise(F.array(*map(F.lit, "ab")))
    scores = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.lit("q").alias("question_id"), F.lit("j").alias("judge"), F.explode(ids).alias("criterion_id"))
    rubric = spark.createDataFrame([("q", "a"), ("q", "b")], "question_id string, criterion_id string")
    out = judging.verdict_problems(scores, rubric)
    return out.select(F.col("run_id").alias("event_id"), F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"), "repeated")


@query("SELECT event_id FROM events WHERE event_id % 4 = 1")
def unknown_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select("event_id", F.lit("q").alias("question_id"), F.when(F.col("event_id") % 4 == 1, "z").otherwise("a").alias("criterion_id"))
    return judging.unknown_criteria(e, spark.createDataFrame([("q", "a")], "question_id string, criterion_id string")).select("event_id")


@query(
    f"""WITH {G._LADDER_SQL}, c AS (SELECT run, CASE WHEN mode = 'judge' THEN 'judge' ELSE 'deterministic' END AS class, high, awarded FROM graded), k AS (SELECT unnest(['deterministic', 'judge']) AS class)
    SELECT CAST(r.run AS VARCHAR) AS run_id, k.class, count(c.run) AS questions, round(coalesce(sum(c.high), 0), 6) AS max_points, round(coalesce(sum(c.awarded), 0), 6) AS awarded
    FROM (SELECT DISTINCT run FROM graded) r CROSS JOIN k LEFT JOIN c ON c.run = r.run AND c.class = k.class GROUP BY ALL"""
)
def classify_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point buckets without the rules, by what happened."""
    out = results.classify_points(G.results(spark, sf_dir), rule=results.class_from_mode(F.col("mode")))
    return out.select("run_id", "class", "questions", "max_points", "awarded")


@query(
    """SELECT o_orderkey, printf('%.1f', a) || CASE WHEN o_orderkey % 3 = 0 THEN '%' ELSE ' ± ' || printf('%.1f', b) || '%' END AS shown, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderkey || '-' || (o_orderkey + 1) END AS label, greatest(0.0, floor(a / 5) * 5.0) AS floor5
    FROM (SELECT o_orderkey, CAST(o_orderkey % 200 AS DOUBLE) - 50 AS a, CAST(o_orderkey % 7 AS DOUBLE) / 2 AS b FROM orders)"""
)
def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a, b = (k % 200).cast("double") - 50, F.when(k % 3 != 0, (k % 7).cast("double") / 2)
    return A.table(spark, sf_dir, "orders").select(
        "o_orderkey", T.mean_and_spread(a, b, "%").alias("shown"), T.run_label(k, k + F.when(k % 2 == 0, 0).otherwise(1)).alias("label"), T.floor5(a).alias("floor5")
    )


@query("SELECT p_partkey, p_partkey % 3 = 0 AS unsafe, p_partkey % 4 = 0 AS repo, p_partkey % 5 <> 0 AS entry FROM part")
def name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset paths, repository names and entry names, some of them not allowed."""
    p = F.col("p_partkey")
    n = p.cast("string")
    rows = A.table(spark, sf_dir, "part").select(
        "p_partkey", F.when(p % 3 == 0, F.when(p % 2 == 0, F.concat(F.lit("/a/"), n)).otherwise(F.concat(F.lit("a/../"), n))).otherwise(F.concat(F.lit("a/"), n, F.lit("..png"))).alias("asset"),
        F.when(p % 4 == 0, F.concat(F.lit("lab/x"), n)).otherwise(F.concat(F.lit("-lab/x"), n)).alias("repo"), F.when(p % 5 == 0, F.concat(F.lit("results-"), n)).otherwise(F.concat(F.lit("e"), n)).alias("entry"),
    )
    bad = structure.unsafe_assets(rows).select("p_partkey", F.lit(True).alias("_bad"))
    return rows.join(bad, "p_partkey", "left").select("p_partkey", F.coalesce("_bad", F.lit(False)).alias("unsafe"), io.is_repo_id(F.col("repo")).alias("repo"), io.is_entry_id(F.col("entry")).alias("entry"))


@query("SELECT l_orderkey AS doc, 'L' || l_linenumber AS l FROM lineitem WHERE l_linenumber <= 4 AND l_suppkey % 3 <> 0")
def valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of order lines with suppliers' groups: lines up to 4 and groups 1 and 2 exist."""
    x = A.table(spark, sf_dir, "lineitem")
    line, group = F.concat(F.lit("L"), F.col("l_linenumber").cast("string")), F.concat(F.lit("R"), (F.col("l_suppkey") % 3).cast("string"))
    pairs = x.select(F.col("l_orderkey").alias("doc"), line.alias("l"), group.alias("r"))
    docs = pairs.select("doc").distinct()
    ids = lambda *names: docs.select("doc", F.explode(F.array(*map(F.lit, names))).alias("id"))
    return ingest.valid_pairs(pairs, ids("L1", "L2", "L3", "L4"), ids("R1", "R2"), ["doc"]).select("doc", "l")


@query("SELECT l_orderkey, CAST(l_suppkey % 3 AS VARCHAR) AS key, arg_max(l_partkey, l_linenumber * 1000000 + l_partkey) AS value FROM lineitem GROUP BY ALL")
def answer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as key-value lists; the last of a key counts."""
    x = A.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), (F.col("l_suppkey") % 3).cast("string").alias("key"), F.col("l_partkey").alias("value"))
    return ingest.answer_values(x, ["l_orderkey"]).select("l_orderkey", F.explode("values").alias("key", "value"))


@query(
    """WITH q AS (SELECT l_orderkey AS doc, l_linenumber AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem WHERE l_linenumber % 3 <> 0)
    SELECT doc, pos, 'q' || n AS question_id FROM q UNION ALL SELECT l.l_orderkey, l.l_linenumber, 'q' || q.n || '.a' FROM lineitem l JOIN q ON q.doc = l.l_orderkey AND q.pos = l.l_linenumber - 1 WHERE l.l_linenumber % 3 = 0"""
)
def question_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line of an order is a part of the line before."""
    n = F.col("l_linenumber")
    x = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), n.alias("pos"), F.when(n % 3 == 0, n - 1).alias("parent_pos"), F.when(n % 3 == 0, "a").alias("suffix"))
    return ingest.question_ids(x, ["doc"]).select("doc", "pos", "question_id")


@query(
    f"""WITH {A.PAPERS_SQL}, o AS (SELECT entry_id, 'j' || (length(subset) + row_number() OVER (PARTITION BY entry_id ORDER BY subset)) % 3 AS j, subset FROM papers), f AS (SELECT entry_id, j, min(subset) AS s FROM o GROUP BY ALL)
    SELECT entry_id, string_agg(j, ',' ORDER BY s) AS judges FROM f GROUP BY entry_id"""
)
def judges_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("entry_id").orderBy("subset"))
    p = A.papers(spark, sf_dir).select("entry_id", "subset", F.array(F.concat(F.lit("j"), ((F.length("subset") + n) % 3).cast("string"))).alias("judge_models"))
    return leaderboard.judges_seen(p, "entry_id", "subset").select("entry_id", F.array_join("judges", ",").alias("judges"))

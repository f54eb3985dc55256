"""Queries: scoring rules, text matching, reports and judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import scoring as S
from scorewright.functions import text as T
from scorewright.operators import grading, judging
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


def _choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = A.picks(spark, sf_dir).join(A.rules(spark, sf_dir), "question_id")
    c = F.col
    points = S.choice_points(c("selected"), c("correct"), c("max_points"), c("min_points"), c("single"), c("partial"), c("penalty"), c("negative"))
    return met.withColumn("points", points)


@query(f"WITH {A.SQL} SELECT taker, round(sum(points), 6) AS awarded, round(sum(high), 6) AS max_points, count(*) AS questions FROM scored GROUP BY taker")
def grade_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of every taker under choice rules with accept-lists, partial credit, penalties and negative marks."""
    return _choice(spark, sf_dir).groupBy("taker").agg(F.round(F.sum("points"), 6).alias("awarded"), F.round(F.sum("max_points"), 6).alias("max_points"), F.count("*").alias("questions"))


@query(f"WITH {A.SQL} SELECT question_id, taker, round(points, 6) AS points FROM scored WHERE single")
def grade_choice_accept_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choice(spark, sf_dir).where("single").select("question_id", "taker", F.round("points", 6).alias("points"))


@query(f"WITH {A.SQL} SELECT question_id, taker, round(points, 6) AS points FROM scored WHERE neg IS NOT NULL AND hits = 0")
def grade_choice_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, _, _ = S.set_counts(F.col("selected"), F.col("correct"))
    return _choice(spark, sf_dir).where(F.col("negative").isNotNull() & (hits == 0)).select("question_id", "taker", F.round("points", 6).alias("points"))


@query(
    f"""WITH {A.SQL}, table_scored AS (
        SELECT taker, CASE WHEN sel = 0 THEN 0.0 ELSE high * CASE wrong + missed WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.2 ELSE 0.0 END END AS p, wrong + missed AS errors FROM met)
    SELECT taker, errors, count(*) AS questions, round(sum(p), 6) AS awarded FROM table_scored GROUP BY taker, errors"""
)
def grade_per_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = A.picks(spark, sf_dir).join(A.rules(spark, sf_dir), "question_id")
    _, wrong, missed = S.set_counts(F.col("selected"), F.col("correct"))
    p = S.per_option_points(F.col("selected"), F.col("correct"), F.array(F.lit(1.0), F.lit(0.6), F.lit(0.2)), F.col("max_points"), F.lit(0.0))
    return met.select("taker", (wrong + missed).cast("bigint").alias("errors"), p.alias("p")).groupBy("taker", "errors").agg(F.count("*").alias("questions"), F.round(F.sum("p"), 6).alias("awarded"))


@query(
    """SELECT l_suppkey AS taker, round(sum(CASE WHEN l_quantity % 2 = l_partkey % 2 THEN 2.0 WHEN l_partkey % 3 = 0 THEN -0.5 ELSE 0.0 END), 6) AS awarded
    FROM lineitem GROUP BY l_suppkey"""
)
def grade_true_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = A.table(spark, sf_dir, "lineitem")
    p = S.true_false_points(F.col("l_quantity") % 2 == 1, F.col("l_partkey") % 2 == 1, F.lit(2.0), F.lit(0.0), F.when(F.col("l_partkey") % 3 == 0, -0.5))
    return x.groupBy(F.col("l_suppkey").alias("taker")).agg(F.round(F.sum(p), 6).alias("awarded"))


_BLANKS_SQL = """WITH b AS (
    SELECT c_custkey, upper(trim(c_mktsegment)) = CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE 'BUILDING' END AS m1,
           abs(c_custkey % 10 - 5) <= 1 AS m2
    FROM customer)
SELECT c_custkey, round(4.0 * ((CASE WHEN m1 THEN 3 ELSE 0 END) + (CASE WHEN m2 THEN 1 ELSE 0 END)) / 4, 6) AS weighted,
       CASE WHEN m1 AND m2 THEN 4.0 ELSE 0.0 END AS strict FROM b"""


@query(_BLANKS_SQL)
def grade_fill_in_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blanks weighted 3 to 1: a segment in any case and spacing, and a number within 1 of 5."""
    c = A.table(spark, sf_dir, "customer")
    given = F.create_map(F.lit("b1"), F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" ")), F.lit("b2"), (F.col("c_custkey") % 10).cast("string"))
    accepted = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit("BUILDING"))
    blanks = F.array(
        F.struct(F.lit("b1").alias("id"), F.array(accepted).alias("accepted"), F.lit(3.0).alias("weight")),
        F.struct(F.lit("b2").alias("id"), F.array(F.lit("5")).alias("accepted"), F.lit(1.0).alias("weight")),
    )
    m = grading.blank_matches(given, blanks, F.lit(1.0), F.lit(False))
    return c.select("c_custkey", F.round(S.blanks_points(m, F.lit(4.0), F.lit(0.0), F.lit(False)), 6).alias("weighted"), S.blanks_points(m, F.lit(4.0), F.lit(0.0), F.lit(True)).alias("strict"))


#: Texts of four scripts and widths, and what each is after normalisation.
_SCRIPTS = [("ＢＵＩＬＤＩＮＧ　１", "building 1"), ("Straße", "STRASSE"), ("ﬁsh", "FISH"), ("１２", "12"), ("ΣΊΣΥΦΟΣ", "σίσυφος"), ("３／４", "0.75"), ("日本", "日 本"), ("I", "ı")]
#: Which of them match: by their normal form, or as numbers within a thousandth.
_SCRIPTS_MATCH = [1, 1, 1, 1, 1, 0, 0, 0]


@query(
    f"""WITH t AS (SELECT o_orderkey, CAST(o_orderkey % 8 AS INT) AS k, o_orderkey % 3 = 0 AS plain FROM orders)
    SELECT o_orderkey, CASE WHEN plain THEN k = 3 ELSE {_SCRIPTS_MATCH}[k + 1] = 1 END AS matched FROM t"""
)
def grade_blank_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks in full-width, ligatured, cased and spaced letters; a third of the rules switch all normalisation off.

    Full-width digits are read as numbers even then, so 12 matches within its tolerance.
    """
    k = F.col("o_orderkey")
    at = lambda i: F.get(F.array(*(F.lit(p[i]) for p in _SCRIPTS)), (k % 8).cast("int"))
    blanks = F.array(F.struct(F.lit("b").alias("id"), F.array(F.lit("none of these"), at(1)).alias("accepted"), F.lit(1.0).alias("weight")))
    on = k % 3 != 0
    m = grading.blank_matches(F.create_map(F.lit("b"), at(0)), blanks, F.lit(0.001), F.lit(False), dict.fromkeys(grading.SWITCHES, on))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", m[0]["matched"].alias("matched"))


@query(
    """WITH g AS (SELECT s_suppkey, n_nationkey AS l, (n_regionkey + CASE WHEN (s_suppkey + n_nationkey) % 3 = 0 THEN 1 ELSE 0 END) AS r, n_regionkey AS e,
                         (s_suppkey + n_nationkey) % 5 = 0 AS absent FROM supplier CROSS JOIN nation)
    SELECT s_suppkey, round(greatest(0.0, 10.0 * count(*) FILTER (NOT absent AND r = e) / count(*) - 0.25 * count(*) FILTER (NOT absent AND r <> e)), 6) AS points
    FROM g GROUP BY s_suppkey"""
)
def grade_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs nation -> region; a third of the pairs wrong, a fifth absent."""
    n = A.table(spark, sf_dir, "nation")
    key = n.agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_regionkey"))).alias("expected"))  # 25 rows
    s = A.table(spark, sf_dir, "supplier").crossJoin(F.broadcast(key))
    k = F.col("s_suppkey")
    given = F.map_filter(F.transform_values("expected", lambda a, b: b + F.when((k + a) % 3 == 0, 1).otherwise(0)), lambda a, b: (k + a) % 5 != 0)
    return s.select("s_suppkey", F.round(S.matching_points(given, F.col("expected"), F.lit(10.0), F.lit(0.0), F.lit(0.25), F.lit(False)), 6).alias("points"))


def _sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """An exam for each supplier over the parts it met; a tenth of them it leaves unanswered, and odd exams lack a rule here and there.

    Text-only takers are those with an odd id.
    """
    t, q = F.col("taker"), F.col("question_id")
    met = A.picks(spark, sf_dir)
    ruled = met.select("taker", "question_id").join(A.rules(spark, sf_dir), "question_id").where(~((q % 17 == 0) & (t % 2 == 1)))
    exam = t.cast("string").alias("exam_id")
    rules = ruled.select(
        exam, q.cast("string").alias("question_id"), F.concat(F.lit("s"), (q % 5).cast("string")).alias("section_id"),
        F.when(q % 11 == 0, "judge").otherwise("choice").alias("kind"), "max_points", "min_points", "correct", F.lit(None).cast("boolean").alias("correct_bool"),
        F.col("partial").alias("partial_credit"), F.col("penalty").alias("wrong_penalty"), "negative", F.lit(None).cast("array<double>").alias("ratios"),
        F.lit(None).cast("array<struct<id: string, accepted: array<string>, weight: double>>").alias("blanks"), F.lit(None).cast("double").alias("tolerance"),
        F.lit(False).alias("relative"), F.lit(False).alias("all_or_nothing"), F.lit(None).cast("map<string,string>").alias("pairs"),
    )
    answers = met.where((t + q) % 10 != 0).select(
        t.cast("string").alias("run_id"), exam, q.cast("string").alias("question_id"),
        F.when(q % 13 == 0, "essay").when(q % 4 == 0, "single_choice").otherwise("multiple_choice").alias("type"), "selected", F.lit(None).cast("boolean").alias("value"),
        F.lit(None).cast("map<string,string>").alias("blanks"), F.lit(None).cast("map<string,string>").alias("pairs"), F.lit("").alias("text"),
    )
    s = F.col("s_suppkey")
    able = F.when(s % 2 == 1, F.array(F.lit("text"))).otherwise(F.array(F.lit("image"), F.lit("text")))
    runs = A.table(spark, sf_dir, "supplier").select(s.cast("string").alias("run_id"), s.cast("string").alias("exam_id"), able.alias("capabilities"))
    needs = ruled.where(q % 3 == 0).select(exam, q.cast("string").alias("question_id"), F.array(F.lit("image"), F.lit("text")).alias("modalities"))
    judged = answers.where(F.col("question_id").cast("bigint") % 22 == 0).select("run_id", "question_id", F.lit(0.5).alias("awarded"))
    return rules, answers, runs, needs, judged


_LADDER_SQL = A.SQL + """, res AS (
    SELECT taker AS run, question_id AS q, question_id % 5 AS section, high,
           CASE WHEN (taker + question_id) % 10 = 0 AND taker % 2 = 1 AND question_id % 3 = 0 THEN 'skipped'
                WHEN (taker + question_id) % 10 = 0 THEN 'unanswered'
                WHEN question_id % 22 = 0 THEN 'judge'
                WHEN question_id % 11 = 0 THEN 'error'
                WHEN question_id % 13 = 0 THEN 'error' ELSE 'deterministic' END AS mode, points
    FROM scored WHERE NOT (question_id % 17 = 0 AND taker % 2 = 1)
), graded AS (
    SELECT *, CASE mode WHEN 'judge' THEN 0.5 WHEN 'deterministic' THEN points ELSE 0.0 END AS awarded FROM res
)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, answers, runs, needs, judged = _sheets(spark, sf_dir)
    return grading.grade_sheets(rules, answers, runs, needs, judged)


@query(f"WITH {_LADDER_SQL} SELECT CAST(run AS VARCHAR) AS run_id, mode, count(*) AS questions, round(sum(awarded), 6) AS awarded FROM graded GROUP BY run, mode")
def grade_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every run against every rule through the whole decision ladder."""
    return results(spark, sf_dir).groupBy("run_id", "mode").agg(F.count("*").alias("questions"), F.round(F.sum("awarded"), 6).alias("awarded"))


@query(f"WITH {_LADDER_SQL} SELECT CAST(run AS VARCHAR) AS run_id, CAST(run AS VARCHAR) AS exam_id, 's' || section AS section_id, round(sum(awarded), 6) AS awarded, round(sum(high), 6) AS max_points FROM graded GROUP BY run, section")
def section_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grading.section_totals(results(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("awarded", "max_points")})


@query(
    f"""WITH {_LADDER_SQL} SELECT CAST(run AS VARCHAR) AS run_id, round(sum(awarded), 6) AS awarded, round(sum(high), 6) AS total_points,
    round(coalesce(sum(high) FILTER (mode <> 'skipped'), 0), 6) AS covered_max, count(*) FILTER (mode = 'skipped') AS skipped, count(*) FILTER (mode = 'unanswered') AS unanswered,
    count(*) FILTER (mode = 'error') AS errors, count(*) FILTER (mode = 'deterministic' AND abs(awarded - high) < 1e-9) AS full_credit,
    round(100 * sum(awarded) / sum(high), 6) AS percentage, round(coalesce(100 * sum(awarded) / nullif(sum(high) FILTER (mode <> 'skipped'), 0), 0), 6) AS covered_percentage
    FROM graded GROUP BY run"""
)
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grading.report_totals(results(spark, sf_dir)).drop("exam_id")
    return out.withColumns({c: F.round(c, 6) for c in ("awarded", "total_points", "covered_max", "percentage", "covered_percentage")})


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS run_id, CAST(l_partkey AS VARCHAR) AS question_id FROM lineitem WHERE (l_suppkey + l_partkey) % 10 <> 0 AND l_partkey % 17 = 0 AND l_suppkey % 2 = 1")
def unknown_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, answers, *_ = _sheets(spark, sf_dir)
    return grading.unknown_answers(answers, rules).select("run_id", "question_id")


@query(
    "SELECT CAST(s_suppkey AS VARCHAR) AS run_id, 'judges itself' AS warning FROM supplier WHERE s_suppkey % 4 = 1 AND s_suppkey % 20 % 2 = 1 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'one judge' FROM supplier WHERE s_suppkey % 20 % 2 = 1"
)
def self_judging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd exams have m1 as their only judge, the others two that take none."""
    s = F.col("s_suppkey")
    model = F.concat(F.lit("m"), (s % 4).cast("string")).alias("model")
    runs = A.table(spark, sf_dir, "supplier").select(s.cast("string").alias("run_id"), (s % 20).cast("string").alias("exam_id"), model)
    judges = spark.createDataFrame([(str(e), j) for e in range(20) for j in (["m1"] if e % 2 else ["x", "y"])], "exam_id string, judge string")
    return grading.self_judging(runs, judges)


# --- text ---------------------------------------------------------------------------


@query(r"SELECT doc_id, sha256(lower(trim(regexp_replace(regexp_replace(text, '^[\t\n\x0b\f\r ]+|[\t\n\x0b\f\r ]+$', '', 'g'), '[\t\n\x0b\f\r ]+', ' ', 'g')))) AS sha, length(text) AS n FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(T.normalize_ascii(F.col("text")), 256).alias("sha"), F.length("text").cast("bigint").alias("n"))


@query(
    """WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'straße ' WHEN 1 THEN '１２ ' WHEN 2 THEN 'ﬁ ' ELSE 'plain ' END AS head, lower(c_name) AS name FROM customer)
    SELECT c_custkey, CASE head WHEN 'straße ' THEN 'strasse ' WHEN '１２ ' THEN '12 ' WHEN 'ﬁ ' THEN 'fi ' ELSE 'plain ' END || name AS normal, CASE head WHEN '１２ ' THEN 12.0 END AS number FROM t"""
)
def normalize_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names behind words in other widths and cases, with ideographic spaces around."""
    k = F.col("c_custkey")
    head = F.when(k % 4 == 0, "STRAẞE").when(k % 4 == 1, "１２").when(k % 4 == 2, "ﬁ").otherwise("plain")
    shown = F.concat(F.lit("\u3000"), head, F.lit(" \u3000\n"), "c_name", F.lit("\u2003"))
    return A.table(spark, sf_dir, "customer").select("c_custkey", T.normalize_text(shown).alias("normal"), T.parse_number(head).alias("number"))


@query()
def normalize_text_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC, strip, collapse and fold case; beyond SQL, held against plain Python in the tests."""
    return A.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("sha"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN round((o_orderkey % 7) / ((o_orderkey % 3) + 1.0), 6) WHEN 2 THEN NULL
       ELSE CAST(o_orderkey % 1000 AS DOUBLE) + 1000 END AS number FROM orders"""
)
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    shown = (
        F.when(k % 4 == 0, F.format_number(F.round("o_totalprice", 2), 2))
        .when(k % 4 == 1, F.concat(F.lit(" "), (k % 7).cast("string"), F.lit("/"), (k % 3 + 1).cast("string"), F.lit("\n")))
        .when(k % 4 == 2, F.concat((k % 7).cast("string"), F.lit("f")))
        .otherwise(F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0")))
    )
    return A.table(spark, sf_dir, "orders").select("o_orderkey", F.round(T.parse_number(shown), 6).alias("number"))


@query("SELECT o_orderkey, abs(o_totalprice - 1000 * round(o_totalprice / 1000)) <= 50 AS near, abs(o_totalprice - 1000 * round(o_totalprice / 1000)) <= 0.001 * greatest(o_totalprice, 1000 * round(o_totalprice / 1000)) AS share FROM orders")
def numeric_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("o_totalprice"), 1000 * F.round(F.col("o_totalprice") / 1000)
    return A.table(spark, sf_dir, "orders").select("o_orderkey", T.numbers_close(a, b, absolute=F.lit(50.0)).alias("near"), T.numbers_close(a, b, relative=F.lit(0.001)).alias("share"))


@query(r"SELECT p_partkey, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '^-+|-+$', '', 'g'), ''), 'exam') AS slug FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "part").select("p_partkey", T.slugify(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query(
    """SELECT c_custkey, CAST(c_custkey % 50 AS VARCHAR) || CASE WHEN c_custkey % 4 = 3 THEN 'a' ELSE '' END AS key, CAST(c_custkey % 50 AS INT) AS lead,
       CASE WHEN c_custkey % 4 = 1 THEN array_to_string(range(c_custkey % 50, c_custkey % 50 + 4), ',') ELSE CAST(c_custkey % 50 AS VARCHAR) END AS covered FROM customer WHERE c_custkey % 4 <> 1
       UNION ALL SELECT c_custkey, CAST(c_custkey % 50 AS VARCHAR) || '-' || CAST(c_custkey % 50 + 3 AS VARCHAR), CAST(c_custkey % 50 AS INT), array_to_string(range(c_custkey % 50, c_custkey % 50 + 4), ',') FROM customer WHERE c_custkey % 4 = 1"""
)
def printed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    n = (k % 50).cast("string")
    shown = F.when(k % 4 == 0, F.concat(F.lit("第 "), n, F.lit(" 題"))).when(k % 4 == 1, F.concat(n, F.lit("-"), (k % 50 + 3).cast("string"))).when(k % 4 == 2, F.concat(F.lit("Q"), n, F.lit("."))).otherwise(F.concat(n, F.lit(" (A)")))
    return A.table(spark, sf_dir, "customer").select(
        "c_custkey", T.normalize_number(shown).alias("key"), T.leading_int(shown).alias("lead"), F.array_join(F.transform(T.covered_numbers(shown), lambda x: x.cast("string")), ",").alias("covered")
    )


@query(
    r"""SELECT r_regionkey, '| nation | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE '' END || ' |', chr(10) ORDER BY n_nationkey) AS markdown
    FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey"""
)
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.table(spark, sf_dir, "nation")
    row = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.col("n_name"), F.col("n_nationkey").cast("string"))).otherwise(F.array("n_name"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("cells")))), lambda x: x["cells"])
    return n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(rows.alias("rows")).select("r_regionkey", T.markdown_table(F.array(F.lit("nation"), F.lit("key")), F.col("rows")).alias("markdown"))


# --- judges -------------------------------------------------------------------------


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.study(spark, sf_dir)
    return s.groupBy(F.col("sheet").cast("string").alias("run_id"), F.col("qid").cast("string").alias("question_id"), "judge").agg(F.avg("p").alias("total"))


_VERDICTS_SQL = A.STUDY_SQL + ", verdicts AS (SELECT CAST(sheet AS VARCHAR) AS run_id, CAST(qid AS VARCHAR) AS question_id, judge, p AS total FROM cells)"


def _limits(spark: SparkSession) -> DataFrame:
    return spark.range(24).select(F.col("id").cast("string").alias("question_id"), F.lit(1.0).alias("max_points"), F.lit(0.0).alias("min_points"))


@query(
    """WITH e AS (SELECT event_id, value / 100 AS given, event_id % 4 AS q FROM events), l AS (SELECT * FROM (VALUES (0.0), (1.0), (2.0), (4.0)) t(p)),
    near AS (SELECT event_id, given, arg_min(p, (abs(p - given), -p)) AS s FROM e CROSS JOIN l GROUP BY event_id, given)
    SELECT event_id, round(s, 6) AS snapped, round(least(s, 3.0), 6) AS total, s <> given OR least(s, 3.0) <> given AS changed FROM near"""
)
def snap_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One criterion with levels 4, 2, 1, 0; the question has 3 points."""
    e = A.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("run_id"), F.lit("q").alias("question_id"), F.lit("j").alias("judge"), (F.col("value") / 100).alias("total"), "event_id")
    scores = e.select("run_id", "question_id", "judge", F.lit(0).alias("pos"), F.lit("c").alias("criterion_id"), F.col("total").alias("points"))
    rubric = spark.createDataFrame([("q", "c", [4.0, 2.0, 1.0, 0.0])], "question_id string, criterion_id string, levels array<double>")
    limits = spark.createDataFrame([("q", 3.0, 0.0)], "question_id string, max_points double, min_points double")
    out = judging.snap(e.drop("event_id"), scores, rubric, limits).join(e.select("run_id", "event_id"), "run_id")
    levels = F.array(*map(F.lit, (4.0, 2.0, 1.0, 0.0)))
    return out.select("event_id", F.round(S.nearest_level(levels, F.col("raw_total")), 6).alias("snapped"), F.round("total", 6).alias("total"), "changed")


@query(f"WITH {_VERDICTS_SQL} SELECT run_id, question_id, round(avg(total), 6) AS mean, round(median(total), 6) AS median, round(min(total), 6) AS least, round(max(total), 6) AS most FROM verdicts GROUP BY ALL")
def judge_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdicts(spark, sf_dir)
    key = ["run_id", "question_id"]
    out = judging.combine(v).withColumnRenamed("awarded", "mean")
    for how, name in (("median", "median"), ("min", "least"), ("max", "most")):
        out = out.join(judging.combine(v, how).withColumnRenamed("awarded", name), key)
    return out.select(*key, *(F.round(c, 6).alias(c) for c in ("mean", "median", "least", "most")))


@query(
    f"WITH {_VERDICTS_SQL} SELECT run_id, question_id, count(*) AS judge_count, round(max(total) - min(total), 6) AS spread, round(coalesce(stddev_samp(total), 0), 6) AS stdev, round(max(total) - min(total), 6) AS normalized_spread, abs(max(total) - min(total)) <= 1e-9 AS unanimous FROM verdicts GROUP BY ALL"
)
def question_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judging.agreement(_verdicts(spark, sf_dir), _limits(spark))
    return out.withColumns({c: F.round(c, 6) for c in ("spread", "stdev", "normalized_spread")})


@query(
    f"""WITH {_VERDICTS_SQL}, a AS (SELECT run_id, question_id, count(*) AS n, max(total) - min(total) AS s FROM verdicts GROUP BY ALL)
    SELECT run_id, count(*) AS judged_questions, count(*) FILTER (n >= 2) AS multi_judge_questions, count(*) FILTER (n >= 2 AND abs(s) > 1e-9) AS disagreed_questions,
    round(coalesce(avg(s) FILTER (n >= 2), 0), 6) AS mean_spread, round(coalesce(max(s) FILTER (n >= 2), 0), 6) AS max_spread, round(coalesce(avg(s) FILTER (n >= 2), 0), 6) AS mean_normalized_spread FROM a GROUP BY run_id"""
)
def agreement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judging.agreement_summary(judging.agreement(_verdicts(spark, sf_dir), _limits(spark)))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_spread", "max_spread", "mean_normalized_spread")})


@query(f"WITH {_VERDICTS_SQL} SELECT run_id, judge, round(avg(total), 6) AS mean, count(*) AS verdicts FROM verdicts GROUP BY ALL")
def judge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.judge_means(_verdicts(spark, sf_dir)).withColumn("mean", F.round("mean", 6))

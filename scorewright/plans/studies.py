"""Queries: rater reliability, ingestion, structure."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators import ingest, reliability
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


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.cells(A.study(spark, sf_dir))


S = A.STUDY_SQL


@query(f"WITH {S} SELECT qid, sheet, judge, round(p, 6) AS p FROM cells")
def cells_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).withColumn("p", F.round("p", 6))


@query(f"WITH {S}, v AS (SELECT judge, var_pop(p) AS v, max(p) = min(p) AS same FROM study GROUP BY qid, sheet, judge HAVING count(*) > 1) SELECT judge, round(sqrt(avg(v)), 6) AS within_sd, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS identical, count(*) AS cells FROM v GROUP BY judge")
def within_judge_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.within_sd(A.study(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("within_sd", "identical")})


@query(f"WITH {S} SELECT qid, sheet, count(*) AS judges, round(sum(p), 6) AS total FROM cells GROUP BY qid, sheet HAVING count(*) = 5")
def complete_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.complete(_cells(spark, sf_dir), 5).groupBy("qid", "sheet").agg(F.count("*").alias("judges"), F.round(F.sum("p"), 6).alias("total"))


_MS = (
    S
    + """, c5 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY qid, sheet) AS k FROM cells) WHERE k = 5),
    m AS (SELECT *, avg(p) OVER (PARTITION BY qid, sheet) AS rm, avg(p) OVER (PARTITION BY judge) AS cm, avg(p) OVER () AS g FROM c5),
    ss AS (SELECT count(DISTINCT (qid, sheet)) AS n, count(DISTINCT judge) AS k, sum((rm - g) ** 2) AS ssr, sum((cm - g) ** 2) AS ssc, sum((p - g) ** 2) AS sst FROM m),
    ms AS (SELECT n, k, ssr / (n - 1) AS msr, ssc / (k - 1) AS msc, (sst - ssr - ssc) / ((n - 1) * (k - 1)) AS mse FROM ss)"""
)


@query(f"WITH {_MS} SELECT n, k, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc FROM ms")
def icc21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.icc(reliability.complete(_cells(spark, sf_dir), 5)).select("n", "k", F.round("icc", 6).alias("icc"))


#: Upper bounds of the Poisson numbers 0 to 11 of mean 1, as running sums.
_BELOW, _TERM = [math.exp(-1)], math.exp(-1)
for _i in range(1, 12):
    _TERM /= _i
    _BELOW.append(_BELOW[-1] + _TERM)
_DRAWS = f"""{S}, c5 AS (SELECT *, avg(p) OVER (PARTITION BY qid, sheet) AS rm FROM (SELECT *, count(*) OVER (PARTITION BY qid, sheet) AS k FROM cells) WHERE k = 5),
    q AS (SELECT qid, judge, count(*) AS a, sum(p) AS s, sum(p * p) AS p2, sum(rm * rm) AS r2 FROM c5 GROUP BY ALL),
    u AS (SELECT *, CAST('0x' || substr(md5('1/' || d || '/' || qid), 1, 8) AS UBIGINT) / 4294967296.0 AS u FROM q, range(200) t(d)),
    w AS (SELECT *, {" + ".join(f"CAST(u >= {x!r} AS INT)" for x in _BELOW)} AS w FROM u),
    j AS (SELECT d, judge, sum(w * a) AS a, sum(w * s) AS s, sum(w * p2) AS p2, sum(w * r2) AS r2 FROM w WHERE w > 0 GROUP BY ALL),
    t AS (SELECT d, max(a) AS n, count(*) AS k, sum(p2) AS p2, sum(r2) AS r2, sum(s * s / a) AS c2, sum(s) ** 2 / (max(a) * count(*)) AS g FROM j GROUP BY d),
    sq AS (SELECT d, n, k, (r2 - g) / (n - 1) AS msr, (c2 - g) / (k - 1) AS msc, (p2 - r2 - c2 + g) / ((n - 1) * (k - 1)) AS mse FROM t WHERE n >= 2),
    draws AS (SELECT d AS draw, CAST(n AS BIGINT) AS n, (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n) AS icc FROM sq)"""


@query(f"WITH {_DRAWS} SELECT draw, n, round(icc, 6) AS icc FROM draws")
def icc_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ICC of 200 resamples of whole questions."""
    out = reliability.cluster_bootstrap(reliability.complete(_cells(spark, sf_dir), 5), 200, 1)
    return out.select(F.col("draw").cast("bigint").alias("draw"), F.col("n").cast("bigint").alias("n"), F.round("icc", 6).alias("icc"))


@query(f"WITH {_DRAWS} SELECT round(quantile_cont(icc, 0.025), 6) AS low, round(quantile_cont(icc, 0.975), 6) AS high, count(*) AS draws FROM draws")
def icc_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95 % interval of the ICC by the cluster bootstrap."""
    out = reliability.icc_interval(reliability.complete(_cells(spark, sf_dir), 5), 200)
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "draws")


@query(f"WITH {_MS}, v AS (SELECT greatest((msr - mse) / k, 0) AS a, greatest((msc - mse) / n, 0) AS j, mse AS r FROM ms) SELECT round(a / (a + j + r), 6) AS answers_share, round(j / (a + j + r), 6) AS judges_share, round(r / (a + j + r), 6) AS residual_share FROM v")
def variance_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reliability.variance_shares(reliability.complete(_cells(spark, sf_dir), 5))
    return out.select(*(F.round(f"{c}_share", 6).alias(f"{c}_share") for c in ("answers", "judges", "residual")))


@query(f"WITH {S} SELECT a.judge, b.judge AS other, count(*) AS n, round(avg(abs(a.p - b.p)), 6) AS mean_abs, round(corr(a.p, b.p), 6) AS r FROM cells a JOIN cells b USING (qid, sheet) WHERE a.judge < b.judge GROUP BY a.judge, b.judge")
def judge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.judge_pairs(_cells(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_abs", "r")})


@query(
    f"""WITH {S}, j AS (SELECT judge, row_number() OVER (ORDER BY judge) - 1 AS bit FROM (SELECT DISTINCT judge FROM cells)), s AS (SELECT x AS panel FROM range(32) t(x) WHERE bit_count(x) >= 2),
    p AS (SELECT panel, qid, sheet, avg(p) AS p FROM cells JOIN j USING (judge) JOIN s ON (panel >> bit) & 1 = 1 GROUP BY ALL) SELECT CAST(panel AS BIGINT) AS panel, count(*) AS answers, round(avg(p), 6) AS mean FROM p GROUP BY panel"""
)
def panel_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.panels(_cells(spark, sf_dir)).groupBy("panel").agg(F.count("*").alias("answers"), F.round(F.avg("p"), 6).alias("mean"))


@query(
    f"""WITH {S}, v AS (SELECT qid, sheet, avg(p) AS p, avg(len) AS len FROM study GROUP BY ALL), r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY len, sheet) AS x, row_number() OVER (PARTITION BY qid ORDER BY p, sheet) AS y FROM v)
    SELECT qid, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY qid HAVING count(*) >= 4"""
)
def spearman_within_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.study(spark, sf_dir).groupBy("qid", "sheet").agg(F.avg("p").alias("p"), F.avg("len").alias("len"))
    return reliability.spearman_within(v, ["qid"], "len", "p", ["sheet"]).withColumn("rho", F.round("rho", 6))


@query(
    f"""WITH {S}, v AS (SELECT qid, sheet, avg(p) AS p, avg(len) AS len FROM study GROUP BY ALL), r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY len, sheet) AS x, row_number() OVER (PARTITION BY qid ORDER BY p, sheet) AS y FROM v),
    c AS (SELECT qid, corr(x, y) AS rho FROM r GROUP BY qid HAVING count(*) >= 4) SELECT round(median(rho), 6) AS median_rho, count(*) AS groups FROM c WHERE rho IS NOT NULL"""
)
def median_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.study(spark, sf_dir).groupBy("qid", "sheet").agg(F.avg("p").alias("p"), F.avg("len").alias("len"))
    return reliability.median_spearman(v, ["qid"], "len", "p", ["sheet"]).withColumn("median_rho", F.round("median_rho", 6))


@query("SELECT l_suppkey, round(median(l_extendedprice), 6) AS median, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def grouped_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reliability.exact_median(A.table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return out.withColumn("median", F.round("median", 6))


@query(f"WITH {S}, d AS (SELECT judge, abs(p - avg(p) OVER (PARTITION BY qid, sheet)) AS d FROM cells) SELECT judge, round(avg(d), 6) AS mae FROM d GROUP BY judge")
def mae_with_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.leave_one_out(_cells(spark, sf_dir), include_self=True).withColumn("mae", F.round("mae", 6))


@query(f"WITH {S}, d AS (SELECT judge, p - avg(p) OVER (PARTITION BY qid, sheet) AS d FROM cells) SELECT judge, round(avg(d), 6) AS mean_dev, round(avg(abs(d)), 6) AS mean_abs_dev FROM d GROUP BY judge")
def judge_leniency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.leniency(_cells(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_dev", "mean_abs_dev")})


@query(f"WITH {S}, d AS (SELECT judge, abs(p - (sum(p) OVER w - p) / nullif(count(*) OVER w - 1, 0)) AS d FROM cells WINDOW w AS (PARTITION BY qid, sheet)) SELECT judge, round(avg(d), 6) AS mae FROM d GROUP BY judge")
def mae_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.leave_one_out(_cells(spark, sf_dir)).withColumn("mae", F.round("mae", 6))


@query(f"WITH {S}, x AS (SELECT qid, judge, avg(p) FILTER (wfam = '0') AS a, avg(p) FILTER (wfam = '1') AS b FROM study GROUP BY ALL) SELECT count(*) AS n, round(avg(b - a), 6) AS shift, round(avg(abs(b - a)), 6) AS mean_abs, round(max(abs(b - a)), 6) AS max_abs FROM x WHERE a IS NOT NULL AND b IS NOT NULL")
def effort_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reliability.level_shift(A.study(spark, sf_dir), "wfam", "0", "1", ["qid", "judge"])
    return out.withColumns({c: F.round(c, 6) for c in ("shift", "mean_abs", "max_abs")})


@query(f"WITH {S}, x AS (SELECT avg(p) FILTER (judge < 'm') AS a, avg(p) FILTER (judge >= 'm') AS b FROM cells GROUP BY qid, sheet) SELECT count(*) AS n, round(avg(abs(a - b)), 6) AS mean_abs, round(max(abs(a - b)), 6) AS max_abs, round(corr(a, b), 6) AS r FROM x WHERE a IS NOT NULL AND b IS NOT NULL")
def panel_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir)
    names = sorted(r["judge"] for r in c.select("judge").distinct().collect())  # a handful of judges
    out = reliability.panel_swap(c, [n for n in names if n < "m"], [n for n in names if n >= "m"])
    return out.withColumns({k: F.round(k, 6) for k in ("mean_abs", "max_abs", "r")})


@query(f"WITH {S} SELECT count(*) FILTER (sheet = 0) AS empty, count(*) FILTER (sheet = 0 AND p <= 0.1) AS empty_low, count(*) FILTER (sheet = 7 AND qid % 5 <> 0) AS reference, count(*) FILTER (sheet = 7 AND qid % 5 <> 0 AND p >= 0.9) AS reference_high, round(avg(p) FILTER (sheet = 7 AND qid % 5 <> 0), 6) AS reference_mean FROM study")
def anchor_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.range(24).where("id % 5 = 0").select(F.col("id").alias("qid"))
    return reliability.anchor_validity(A.study(spark, sf_dir), 0, 7, none).withColumn("reference_mean", F.round("reference_mean", 6))


@query(f"WITH {S}, m AS (SELECT qid, sheet, avg(p) AS m, max(p) - min(p) AS r FROM cells GROUP BY ALL) SELECT qid, round(stddev_pop(m), 6) AS spread, round(avg(r), 6) AS disagreement FROM m GROUP BY qid")
def answer_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.answer_spread(_cells(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("spread", "disagreement")})


@query(
    f"""WITH {S}, d AS (SELECT *, p + CASE WHEN qid % 3 <> 0 THEN sheet / 8.0 * CASE WHEN wfam = '0' THEN 0.5 ELSE 0.3 END ELSE 0 END AS d FROM study), m AS (SELECT wfam AS condition, qid, sheet, avg(d) AS m FROM d GROUP BY ALL), s AS (SELECT condition, qid, stddev_pop(m) AS spread FROM m GROUP BY ALL)
    SELECT a.condition, count(*) AS questions, round(median(a.spread / nullif(b.spread, 0)), 6) AS median_ratio FROM s a JOIN s b USING (qid) WHERE a.condition = '1' AND b.condition = '0' AND b.spread >= 0.1 GROUP BY a.condition"""
)
def ablation_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions in three tell the sheets apart, less so under the second condition."""
    by_sheet = F.col("sheet") / 8 * F.when(F.col("wfam") == "0", 0.5).otherwise(0.3)
    d = A.study(spark, sf_dir).withColumn("p", F.col("p") + F.when(F.col("qid") % 3 != 0, by_sheet).otherwise(0.0))
    m = d.groupBy(F.col("wfam").alias("condition"), "qid", "sheet").agg(F.avg("p").alias("m"))
    s = m.groupBy("condition", "qid").agg(F.stddev_pop("m").alias("spread"))
    return reliability.retention(s, "0").withColumn("median_ratio", F.round("median_ratio", 6))


@query(f"WITH {S} SELECT jfam, wfam, round(avg(p), 6) AS mean, count(*) AS n FROM study GROUP BY CUBE (jfam, wfam)")
def family_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.family_table(A.study(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {S}, m AS (SELECT stratum, qid, sheet, avg(p) AS m, max(p) - min(p) AS r FROM study GROUP BY ALL) SELECT stratum, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS answer_sd, round(avg(r), 6) AS disagreement FROM m GROUP BY stratum")
def stratum_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.stratum_table(A.study(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean", "answer_sd", "disagreement")})


@query(f"WITH {S} SELECT sheet, judge, CAST(rep AS BIGINT) AS rep, count(DISTINCT qid) AS questions, count(DISTINCT qid) = 24 AS complete FROM study GROUP BY ALL")
def grading_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.passes(A.study(spark, sf_dir), 24).withColumn("rep", F.col("rep").cast("bigint"))


# --- ingestion ------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select((F.col("page_id") % 13).alias("doc"), F.col("page_id").alias("page_index"))


@query(
    """WITH p AS (SELECT page_id % 13 AS doc, page_id AS page_index, row_number() OVER (PARTITION BY page_id % 13 ORDER BY page_id) - 1 AS i, count(*) OVER (PARTITION BY page_id % 13) AS n FROM pages)
    SELECT doc, page_index, CAST(c AS BIGINT) AS chunk FROM p, range(0, 100000) t(c) WHERE c <= greatest(0, ceil((n - 4) / 3.0)) AND 3 * c <= i AND i < 3 * c + 4"""
)
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.page_chunks(_pages(spark, sf_dir)).withColumn("chunk", F.col("chunk").cast("bigint"))


@query("WITH x AS (SELECT o_custkey AS doc, o_orderkey % 9 AS k, min(o_orderkey) AS pos FROM orders GROUP BY ALL) SELECT doc, CAST(k AS VARCHAR) AS number, pos FROM x")
def merge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as extractions of question k, printed in several ways; the first stays."""
    k = F.col("o_orderkey")
    n = (k % 9).cast("string")
    shown = F.when(k % 3 == 0, F.concat(F.lit("Q"), n)).when(k % 3 == 1, F.concat(n, F.lit(")"))).otherwise(F.concat(F.lit("第"), n, F.lit("題")))
    x = A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc"), k.alias("pos"), shown.alias("number")).agg(F.lit(0).alias("chunk"))
    from scorewright.functions.text import normalize_number

    return ingest.merge_first(x, ["doc"]).select("doc", normalize_number(F.col("number")).alias("number"), "pos")


@query(
    f"""WITH {A.NUMBERS_SQL}, span AS (SELECT doc, min(n) AS lo, max(n) AS hi FROM covered WHERE doc IN (SELECT doc FROM numbers GROUP BY doc HAVING count(DISTINCT n) >= 2) GROUP BY doc),
    lost AS (SELECT doc, CAST(x AS INT) AS n FROM span, LATERAL (SELECT unnest(range(lo, hi + 1)) AS x) WHERE (doc, x) NOT IN (SELECT doc, n FROM covered)),
    isl AS (SELECT doc, n, n - row_number() OVER (PARTITION BY doc ORDER BY n) AS g FROM lost) SELECT doc, min(n) AS first, max(n) AS last FROM isl GROUP BY doc, g"""
)
def find_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.find_gaps(A.numbers(spark, sf_dir), ["doc"])


@query(
    f"""WITH {A.NUMBERS_SQL}, rec AS (SELECT doc, n + 1 AS n FROM numbers WHERE n % 4 = 1), b AS (SELECT doc, n, false AS recovered FROM numbers UNION ALL SELECT doc, n, true FROM rec)
    SELECT doc, CAST(n AS INT) AS n, recovered, row_number() OVER (PARTITION BY doc ORDER BY n, recovered) AS place FROM b"""
)
def insert_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.numbers(spark, sf_dir)
    rec = n.where("n % 4 = 1").select("doc", (F.col("n") + 1).alias("n"), (F.col("n") + 1).cast("string").alias("number"), "pos")
    return ingest.insert_recovered(n, rec, ["doc"]).select("doc", "n", "recovered", F.col("place").cast("bigint").alias("place"))


@query(
    """WITH k AS (SELECT DISTINCT o_custkey AS doc, o_orderkey % 12 + 1 AS n FROM orders), x AS (SELECT doc, n, lead(n) OVER (PARTITION BY doc ORDER BY n) AS m FROM k), c AS (SELECT doc, count(*) AS n FROM k GROUP BY doc),
    g AS (SELECT doc FROM x JOIN (SELECT doc, n AS total FROM c) USING (doc) WHERE m > n + 1 GROUP BY doc, total HAVING count(*) <= 5 AND sum(m - n - 1) <= greatest(10, total / 5.0)),
    r AS (SELECT doc, n + 1 AS n, 1 AS round FROM x WHERE m > n + 1 AND doc IN (SELECT doc FROM g) UNION ALL SELECT doc, n + 2, 2 FROM x WHERE m > n + 2 AND doc IN (SELECT doc FROM g)), a AS (SELECT doc, n, 0 AS round FROM k UNION ALL SELECT * FROM r)
    SELECT doc, n, CAST(round AS BIGINT) AS round, row_number() OVER (PARTITION BY doc ORDER BY n) AS place FROM a"""
)
def gap_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as question numbers from 1 to 12, four to a chunk; the seam finds one missing number at a time, and what it was not asked for."""
    n = F.col("o_orderkey") % 12 + 1
    q = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), n.cast("string").alias("number"), n.alias("pos")).distinct()
    chunk = F.floor((F.col("pos") - 1) / 4)
    numbers = q.select("doc", chunk.alias("chunk"), F.col("pos").cast("int").alias("n"))
    pages = q.select("doc", chunk.alias("page_index"), chunk.alias("chunk")).distinct()

    def extract(request: dict) -> list[str]:
        low = request["first"]
        if not request["pages"] or max(request["pages"]) < (request["last"] - 1) // 4 and max(request["pages"]) < (low - 2) // 4:
            raise ValueError("not on these pages")
        return [str(low), str(low - 1), "99"]

    out, _ = ingest.repair_gaps(q, numbers, pages, extract, ["doc"], rounds=2)
    return out.select("doc", F.col("number").cast("bigint").alias("n"), F.col("round").cast("bigint").alias("round"), F.col("pos").cast("bigint").alias("place"))


@query(
    """SELECT o_custkey AS doc, CAST(o_orderkey % 5 AS VARCHAR) AS key, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderkey % 2 = 0) AS a, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 = 0) AS b FROM orders GROUP BY o_custkey, o_orderkey % 5"""
)
def merge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = A.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc"), F.concat(F.lit("Q"), (k % 5).cast("string"), F.lit(".")).alias("question_number"), k.alias("pos"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("a"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("b")
    )
    return ingest.merge_keys(x, ["doc"], ["a", "b"])


@query(
    """WITH b AS (SELECT l_orderkey, least(l_discount, l_tax) * 8 AS x0, greatest(l_discount, l_tax) * 8 AS x1 FROM (SELECT l_orderkey, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY l_orderkey)),
    c AS (SELECT l_orderkey, greatest(0, least(1, x0)) AS a, greatest(0, least(1, x1)) AS c FROM b), w AS (SELECT *, (c - a) * 0.5 < 0.005 OR (c - a) * 0.5 > 0.95 AS whole FROM c)
    SELECT l_orderkey, whole, CASE WHEN whole THEN 0 ELSE CAST(floor(greatest(0, a - 0.02) * 1000) AS INT) END AS left, CASE WHEN whole THEN 1000 ELSE CAST(ceil(least(1, c + 0.02) * 1000) AS INT) END AS right FROM w"""
)
def figure_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    box = ingest.figure_box(F.col("t") * 8, F.lit(0.25), F.col("d") * 8, F.lit(0.75), F.lit(1000), F.lit(100))
    return x.select("l_orderkey", box.alias("b")).select("l_orderkey", "b.whole", "b.left", "b.right")


@query(
    """WITH p AS (SELECT p_partkey, ['single_choice', 'multiple_choice', 'true_false', 'fill_in_blank', 'matching', 'essay'][p_partkey % 6 + 1] AS t, p_size % 2 = 0 AS has FROM part)
    SELECT p_partkey, CASE WHEN NOT has OR t = 'essay' THEN 'judge' WHEN t = 'multiple_choice' AND p_partkey % 5 = 0 THEN 'per_option' WHEN t IN ('single_choice', 'multiple_choice') THEN 'choice' ELSE t END AS kind FROM p"""
)
def rule_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array(*map(F.lit, ("single_choice", "multiple_choice", "true_false", "fill_in_blank", "matching", "essay")))
    has = F.col("p_size") % 2 == 0
    kind = ingest.synthesised_kind(F.get(types, (F.col("p_partkey") % 6).cast("int")), has, has, has, has, has & (F.col("p_partkey") % 5 == 0))
    return A.table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))

"""Readers and writers at the edges: bundle and bench folders, JSON lines, tables, Markdown cards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import render
from scorewright.functions.text import default_entry_id
from scorewright.operators import grading, judging, results, structure
from scorewright.sources import folders

BENCH = (
    "exam_id string, title string, bundle_dir string, effort string, total_points double, judge_models array<string>, started_at timestamp, finished_at timestamp, "
    "rows array<struct<model: string, slug: string, run_index: int, status: string, awarded: double, covered_max: double, covered_percentage: double, max_points: double, solve_secs: double, grade_secs: double, answers_path: string, report_path: string>>"
)
REPORT = (
    "exam_id string, total_awarded double, total_max double, "
    "results map<string, struct<mode: string, max_points: double, awarded: double, detail: string, judge_verdicts: array<struct<total_points: double>>>>"
)
#: Prefix of folders with published results, which are no bundles.
RESULTS = "results-"


def whole_json(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    """Every file called ``name`` below ``path`` as one row; ``folder`` is where it lies.

    A file that is no JSON of this schema stops the job instead of giving nulls.
    """
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .json(path)
        .withColumn("folder", F.regexp_replace(F.input_file_name(), "/[^/]*$", ""))
    )


def json_text(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Files called ``name`` as text: folder, json.  Nested documents keep their shape for ``structure.flatten_exam``."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .text(path, wholetext=True)  # an option of that name would be overridden
        .select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("folder"), F.col("value").alias("json"))
    )


def read_runs(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Rows of all bench.json files below ``path``; ``model`` filters takers before anything is joined."""
    bench = whole_json(spark, path, BENCH, "bench.json")
    of = ["folder", "exam_id", "bundle_dir", "effort", "started_at", "finished_at"]
    rows = bench.select(*of, F.posexplode("rows").alias("pos", "r")).select(*of, "pos", "r.*")
    return rows if model is None else rows.where(F.col("model") == model)


GRADING = (
    "exam_id string, judge struct<models: array<string>, aggregation: string>, "
    "questions map<string, struct<question_id: string, max_points: double, min_points: double, rule: struct<kind: string, correct: string, partial_credit: boolean, "
    "wrong_selection_penalty: double, negative_marking: double, ratio_by_errors: array<double>, blanks: map<string, struct<accepted: array<string>, weight: double>>, "
    "normalization: struct<case_insensitive: boolean, strip: boolean, collapse_whitespace: boolean, unicode_nfkc: boolean, numeric_tolerance: double, numeric_relative: boolean>, "
    "all_or_nothing: boolean, correct_pairs: map<string, string>, wrong_pair_penalty: double, reference_answer: string, reference_assets: array<string>, judge_instructions: string, "
    "rubric: array<struct<id: string, description: string, levels: array<struct<points: double, descriptor: string>>>>>>>"
)
SHEET = (
    "exam_id string, taker string, answers map<string, struct<type: string, selected: string, value: boolean, blanks: map<string, string>, pairs: map<string, string>, "
    "text: string, description: string, image_asset: string>>"
)
MANIFEST = "name string, version string, created_at string"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of all grading.json files below ``path``, with everything that ``grading.grade_sheets`` reads but sections.

    Defaults: floor 0, no penalty, weight 1, all normalisation on, judges' mean.
    """
    return parse_rules(whole_json(spark, path, GRADING, "grading.json"))


def parse_rules(specs: DataFrame) -> DataFrame:
    """Rules of grading documents (folder and the fields of ``GRADING``)."""
    spec = specs.select("folder", "exam_id", "judge", F.explode("questions").alias("question_id", "g"))
    r, n = "g.rule.", "g.rule.normalization."
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    on = lambda c: F.coalesce(F.col(c), F.lit(True))
    text = F.trim(F.col(r + "correct"))
    # the key of a choice is a list, that of a true-false rule a boolean
    correct = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    blanks = F.transform(F.map_entries(r + "blanks"), lambda e: F.struct(e["key"].alias("id"), e["value"]["accepted"].alias("accepted"), F.coalesce(e["value"]["weight"], F.lit(1.0)).alias("weight")))
    return spec.select(
        "folder", "exam_id", "question_id", r + "kind", "g.max_points", F.coalesce("g.min_points", F.lit(0.0)).alias("min_points"), correct.alias("correct"),
        F.when(F.col(r + "kind") == "true_false", F.lower(text).try_cast("boolean")).alias("correct_bool"), off(r + "partial_credit").alias("partial_credit"),
        F.coalesce(r + "wrong_selection_penalty", r + "wrong_pair_penalty", F.lit(0.0)).alias("wrong_penalty"), F.col(r + "negative_marking").alias("negative"),
        F.col(r + "ratio_by_errors").alias("ratios"), blanks.alias("blanks"), F.col(n + "numeric_tolerance").alias("tolerance"), off(n + "numeric_relative").alias("relative"),
        off(r + "all_or_nothing").alias("all_or_nothing"), F.col(r + "correct_pairs").alias("pairs"),
        on(n + "case_insensitive").alias("case_insensitive"), on(n + "strip").alias("trim"), on(n + "collapse_whitespace").alias("collapse"), on(n + "unicode_nfkc").alias("nfkc"),
        F.coalesce("g.question_id", "question_id").alias("key"), F.coalesce(r + "reference_assets", F.array().cast("array<string>")).alias("reference_assets"), r + "reference_answer", r + "judge_instructions", r + "rubric", F.coalesce("judge.models", F.array().cast("array<string>")).alias("judge_models"), F.coalesce("judge.aggregation", F.lit("mean")).alias("aggregation"),
    )


def rubric_levels(rules: DataFrame) -> DataFrame:
    """Criteria of all rubrics: exam_id, question_id, criterion_id, description, levels falling."""
    c = rules.where("size(rubric) > 0").select("exam_id", "question_id", F.explode("rubric").alias("c"))
    levels = F.reverse(F.array_sort(F.transform("c.levels", lambda x: x["points"])))
    return c.select("exam_id", "question_id", F.col("c.id").alias("criterion_id"), "c.description", levels.alias("levels"))


def read_sheets(spark: SparkSession, path: str, name: str = "*-answers.json") -> tuple[DataFrame, DataFrame]:
    """(answers, runs) of all answer sheets below ``path``; a run is named by its file's path from there.

    A single choice becomes a list of one; text of a drawing is its description.
    """
    root = F.lit(path.rstrip("/") + "/")
    run = F.regexp_replace(F.element_at(F.split(F.col("_file"), root), -1), r"[.]json$", "")
    sheets = whole_json(spark, path, SHEET, name).withColumn("_file", F.input_file_name()).withColumn("run_id", run)
    a = sheets.select("run_id", "exam_id", F.explode("answers").alias("question_id", "a"))
    chosen = F.when(F.trim("a.selected").startswith("["), F.from_json("a.selected", "array<string>")).when(F.col("a.selected").isNotNull(), F.array("a.selected"))
    answers = a.select("run_id", "exam_id", "question_id", "a.type", chosen.alias("selected"), "a.value", "a.blanks", "a.pairs", F.coalesce("a.text", "a.description").alias("text"))
    return answers, sheets.select("run_id", "exam_id", "taker")


def read_manifests(spark: SparkSession, path: str, exams: DataFrame) -> DataFrame:
    """The manifest of each exam folder (``exams``: folder, exam_id); a folder without one gets the exam's id and version 1."""
    found = whole_json(spark, path, MANIFEST, "manifest.json")
    return exams.join(found, "folder", "left").select("folder", "exam_id", F.coalesce("name", "exam_id").alias("name"), F.coalesce("version", F.lit("1")).alias("version"), "created_at")


#: Documents that every bundle has.
BUNDLE_FILES = ("exam.json", "grading.json", "answer_schema.json")


def _shown_path() -> Column:
    """A file's path as ``input_file_name`` shows it."""
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:///")


def file_paths(spark: SparkSession, path: str) -> DataFrame:
    """Paths of all files below ``path``, as ``input_file_name`` shows them; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(_shown_path().alias("path"))


def asset_files(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> DataFrame:
    """path, content of all files below ``path`` but JSON documents; files above ``most_bytes`` are not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where((F.col("length") <= most_bytes) & ~F.col("path").endswith(".json")).select(_shown_path().alias("path"), "content")


def question_table(spark: SparkSession, path: str) -> DataFrame:
    """The published table of all bundles below ``path``, with the bytes of its figures."""
    nodes = structure.flatten_exam(json_text(spark, path, "exam.json"), keep=("folder",))
    table = structure.question_table(nodes, read_rules(spark, path), keep=("folder",))
    return structure.with_images(table, asset_files(spark, path))


def check_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Problems of all bundle folders below ``path``: folder, check, subject; valid bundles have none.

    Files that lack or are no JSON documents, other exam ids in a folder's documents, questions, rules, figures and reference figures without a
    file, and an answer schema that does not follow from the exam.  A folder whose exam or rules cannot be read has no further row.
    """
    files = file_paths(spark, path)
    of = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    name = F.element_at(F.split("path", "/"), -1)
    per = files.where(name.isin(*BUNDLE_FILES)).groupBy(of(F.col("path")).alias("folder")).agg(F.collect_set(name).alias("have"))
    lack = per.select("folder", F.explode(F.array_except(F.array(*map(F.lit, BUNDLE_FILES)), "have")).alias("subject"))
    found = lambda rows, check: rows.select("folder", F.lit(check).alias("check"), "subject")
    whole = per.where(F.size("have") == len(BUNDLE_FILES)).select("folder")
    exams, specs, schemas = (json_text(spark, path, n).join(whole, "folder") for n in BUNDLE_FILES)
    unread = None
    for n, rows in zip(BUNDLE_FILES, (exams, specs, schemas), strict=True):
        one = found(rows.where(F.try_parse_json("json").isNull()).withColumn("subject", F.lit(n)), "not readable")
        unread = one if unread is None else unread.unionByName(one)
    good = whole.join(unread.select("folder").distinct(), "folder", "left_anti")
    nodes = structure.flatten_exam(exams.join(good, "folder"), keep=("folder",))
    rules = parse_rules(specs.join(good, "folder").select("folder", F.from_json("json", GRADING).alias("s")).select("folder", "s.*"))
    ids = nodes.select("folder", F.col("exam_id").alias("own")).distinct()
    other = found(ids.join(rules.select("folder", "exam_id").distinct(), "folder").where("exam_id <> own").withColumn("subject", F.col("exam_id")), "other exam id")
    # a folder is one exam here, so that bundles with one id stay apart
    n, r = nodes.drop("exam_id").withColumnRenamed("folder", "exam_id"), rules.drop("exam_id").withColumnRenamed("folder", "exam_id")
    inner = structure.check_nodes(n).unionByName(structure.check_rules(n, r)).withColumnRenamed("exam_id", "folder")
    fresh = render.answer_schema(structure.leaves(nodes), by="folder")
    same = schemas.join(fresh, "folder").withColumn("subject", F.lit(BUNDLE_FILES[2]))
    stale = found(same.where(canonical("json") != canonical("schema")), "stale schema")
    blocks = F.concat(F.coalesce("instructions", F.array().cast(f"array<{structure.BLOCK}>")), structure.shown_blocks())
    shown = nodes.select("folder", F.col("node_id").alias("question_id"), F.explode(F.array_distinct(F.transform(F.filter(blocks, lambda b: b["type"] == "image"), lambda b: b["asset"]))).alias("asset"))
    refs = rules.select("folder", "question_id", F.explode("reference_assets").alias("asset"))
    gone = lambda rows, check: found(
        rows.withColumn("path", F.concat_ws("/", "folder", "asset")).join(files, "path", "left_anti").groupBy("folder", "asset").agg(F.min("question_id").alias("q")).withColumn("subject", F.concat_ws(": ", "q", "asset")), check
    )
    return found(lack, "missing file").unionByName(unread).unionByName(other).unionByName(inner).unionByName(stale).unionByName(gone(shown, "missing asset")).unionByName(gone(refs, "missing reference"))


def canonical(json: str | Column) -> Column:
    """A JSON text with its members in order and without white space between them, to compare documents."""
    return F.to_json(F.try_parse_json(json))


def read_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, rules) of all bundle folders below ``path``; rules have their section, null if the exam lacks the question."""
    nodes = structure.flatten_exam(json_text(spark, path, "exam.json"))
    leaf = structure.leaves(nodes).select("exam_id", F.col("node_id").alias("question_id"), "section_id")
    return nodes, read_rules(spark, path).join(leaf, ["exam_id", "question_id"], "left")


def grade_folder(spark: SparkSession, bundles: str, sheets: str, verdicts: DataFrame | None = None, capabilities: list[str] | None = None) -> DataFrame:
    """From files to results: all sheets below ``sheets`` under the rules of the bundles below ``bundles``.

    verdicts: run_id, question_id, judge, total, combined as each exam's judges say; rules whose question the exam lacks are left out.
    """
    nodes, rules = read_bundles(spark, bundles)
    answers, runs = read_sheets(spark, sheets)
    runs = runs.withColumn("capabilities", F.lit(capabilities).cast("array<string>") if capabilities else F.lit(None).cast("array<string>"))
    judged = None
    if verdicts is not None:
        # own names, as runs and rules are joined again below
        run = runs.select(F.col("run_id").alias("_run"), F.col("exam_id").alias("_exam"))
        rule = rules.select(F.col("exam_id").alias("_exam"), F.col("question_id").alias("_question"), F.col("aggregation").alias("_how"))
        how = run.join(rule, "_exam").select(F.col("_run").alias("run_id"), F.col("_question").alias("question_id"), F.col("_how").alias("aggregation"))
        met = verdicts.join(how, ["run_id", "question_id"])
        ways = [judging.combine(met.where(F.col("aggregation") == w), w) for w in ("mean", "median", "min", "max")]
        judged = ways[0].unionByName(ways[1]).unionByName(ways[2]).unionByName(ways[3])
    needs = structure.modalities(nodes)
    return grading.grade_sheets(rules.where("section_id IS NOT NULL"), answers, runs, needs, judged)


def load_runs(spark: SparkSession, *paths: str, model: str | None = None) -> DataFrame:
    """Rows of the bench files below all ``paths``, each file once, with subset and the questions of the reports of ok rows.

    results is array<struct<question_id, mode, max_points, awarded, detail>>, null for rows that are not ok.  No row at
    all, or an ok row without its report, is an error.
    """
    rows = read_runs(spark, paths[0], model)
    reports = whole_json(spark, paths[0], REPORT, "*-report.json").withColumn("_file", F.input_file_name())
    for p in paths[1:]:
        rows = rows.unionByName(read_runs(spark, p, model))
        reports = reports.unionByName(whole_json(spark, p, REPORT, "*-report.json").withColumn("_file", F.input_file_name()))
    if rows.isEmpty():
        raise ValueError(f"no runs below {', '.join(paths)}" + (f" of {model}" if model else ""))
    entries = F.transform(F.map_entries("results"), lambda e: F.struct(e["key"].alias("question_id"), *(e["value"][c].alias(c) for c in ("mode", "max_points", "awarded", "detail"))))
    graded = reports.dropDuplicates(["_file"]).select("_file", F.array_sort(entries).alias("results"))
    at = F.concat_ws("/", "folder", "report_path")
    out = rows.dropDuplicates(["folder", "pos"]).withColumn("_file", F.when(F.col("status") == "ok", at)).join(graded, "_file", "left")
    lost = out.where("status = 'ok' AND results IS NULL").select("folder", "slug").limit(5).collect()  # a few to name
    if lost:
        raise ValueError("missing grade reports: " + ", ".join(f"{r.folder} {r.slug}" for r in lost))
    return out.withColumn("subset", F.element_at(F.split("bundle_dir", "/"), -1)).drop("_file")


def with_bundles(runs: DataFrame, *candidates: DataFrame, fallback: bool = False) -> DataFrame:
    """``first_bundle`` for every run; subsets without one are an error, or with ``fallback`` are classified by mode."""
    out = first_bundle(runs, *candidates).withColumn("classification", F.when(F.col("bundle").isNull(), "mode-fallback").otherwise("rules"))
    if not fallback:
        lost = out.where("bundle IS NULL").select("subset").distinct().orderBy("subset").limit(50).collect()
        if lost:
            raise ValueError("no bundle for " + ", ".join(r.subset for r in lost))
    return out


def read_reports(spark: SparkSession, path: str, name: str = "*.grade.json") -> DataFrame:
    """One row per question of every grade report."""
    report = whole_json(spark, path, REPORT, name)
    return report.select("folder", "exam_id", F.explode("results").alias("question_id", "r")).select("folder", "exam_id", "question_id", "r.*")


def runs_without_report(runs: DataFrame, reports: DataFrame) -> DataFrame:
    return runs.where("status = 'ok'").join(reports.select("folder").distinct(), "folder", "left_anti")


def first_bundle(runs: DataFrame, *candidates: DataFrame) -> DataFrame:
    """Runs with the first of several bundle listings (subset, folder) that has their subset; null if none."""
    out = runs
    for i, c in enumerate(candidates):
        out = out.join(c.select("subset", F.col("folder").alias(f"_b{i}")), "subset", "left")
    return out.withColumn("bundle", F.coalesce(*(F.col(f"_b{i}") for i in range(len(candidates))))).drop(*(f"_b{i}" for i in range(len(candidates))))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Input files with their digest, in order of path; page numbers come from a renderer behind ``pages_of``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def pages_of(sources: DataFrame, render) -> DataFrame:
    """Pages of source files by ``render(path, content) -> iterable of (page, image bytes)``, a seam for a rasteriser."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(p, n, image) for p, c in zip(f["path"], f["content"], strict=True) for n, image in render(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "page", "image"])

    return sources.select("path", "content").mapInPandas(run, "path string, page int, image binary")


def json_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Lines that are JSON objects of ``schema``; other lines are left out."""
    parsed = lines.where(F.trim(column).startswith("{")).withColumn("_row", F.from_json(column, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("_row IS NOT NULL AND _row._bad IS NULL").select("_row.*").drop("_bad")


def last_result(lines: DataFrame, stream: str = "stream", line: str = "line_no", column: str = "value") -> DataFrame:
    """The last line of type 'result' of each stream."""
    return lines.where(F.get_json_object(F.when(F.trim(column).startswith("{"), F.col(column)), "$.type") == "result").groupBy(stream).agg(F.max_by(column, line).alias("result"))


def failure_detail(text: Column) -> Column:
    """The first non-empty of result, error and message of a JSON text, else its last 2000 characters."""
    field = lambda k: F.nullif(F.trim(F.get_json_object(text, f"$.{k}")), F.lit(""))
    return F.coalesce(field("result"), field("error"), field("message"), F.right(text, F.lit(2000)))


def subsets(files: DataFrame, path: str = "path") -> DataFrame:
    """Bundle folders of a file listing: those with an exam.json, without published results."""
    name = F.regexp_extract(path, r"^([A-Za-z0-9][A-Za-z0-9._-]*)/exam\.json$", 1)
    return files.select(name.alias("subset")).where(f"subset <> '' AND NOT startswith(subset, '{RESULTS}')").distinct()


def select_files(files: DataFrame, pattern: str = "*", path: str = "path") -> DataFrame:
    """Entry files whose entry matches a glob pattern of * and ?."""
    rx = "^" + RESULTS + re.escape(pattern).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "/"
    return files.where(F.col(path).rlike(rx))


def write_questions(rows: DataFrame, path: str, by: str = "entry_id") -> None:
    """Question table as Parquet, one folder per entry; writing an entry again replaces that entry alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_json_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def replace_block(card: str, start: str, end: str, block: str) -> str:
    """``card`` with the text between two markers replaced, or appended with its markers; doing it twice changes nothing."""
    whole = f"{start}\n{block.strip()}\n{end}"
    at = card.find(start)
    stop = card.find(end, at + len(start)) if at >= 0 else -1
    if stop < 0:
        return f"{card.rstrip()}\n\n{whole}\n" if card.strip() else f"{whole}\n"
    return card[:at] + whole + card[stop + len(end) :]


def is_repo_id(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9][A-Za-z0-9._-]*$")


def is_entry_id(text: Column) -> Column:
    """Lower-case words joined by single marks, without the published prefix."""
    return text.rlike(r"^[a-z0-9][a-z0-9._-]*$") & ~text.startswith(RESULTS)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, through the file system of its path."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_bundle(spark: SparkSession, folder: str, exam: dict, grading_spec: dict, schema: dict, manifest: dict | None = None) -> None:
    """The four documents of a bundle as indented JSON; null fields stay as they are given."""
    import json

    documents = {"exam.json": exam, "grading.json": grading_spec, "answer_schema.json": schema, "manifest.json": manifest or {"name": exam.get("exam_id") or exam["id"], "version": "1"}}
    for name, document in documents.items():
        write_text(spark, f"{folder.rstrip('/')}/{name}", json.dumps(document, ensure_ascii=False, indent=2) + "\n")


def entry_documents(entries: DataFrame, papers: DataFrame) -> DataFrame:
    """Files of entries for ``folders.write_folders``: results-<id>/entry.json with the entry's papers in order."""
    per = papers.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("subset", *(c for c in papers.columns if c not in ("subset", "entry_id"))))).alias("papers"))
    whole = entries.join(per, "entry_id", "left").select("entry_id", F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))
    return whole.select(F.concat(F.lit(RESULTS), "entry_id").alias("folder"), F.lit("entry.json").alias("name"), F.encode(F.concat("json", F.lit("\n")), "UTF-8").alias("content"))


def raw_files(spark: SparkSession, runs: DataFrame, path: str) -> DataFrame:
    """Files of entries for ``folders.write_folders``: the bench, sheet and report files of runs below ``path``, byte by byte.

    runs: entry_id, folder, subset, answers_path, report_path.  A paper's files lie in results-<id>/raw/<subset>; a file that a run lacks is left out.
    """
    names = F.array_compact(F.array(F.lit("bench.json"), "answers_path", "report_path"))
    folder = F.regexp_replace(F.regexp_replace("folder", "^file:/+", "/"), "^/", "file:///")
    want = runs.select("entry_id", "subset", F.explode(names).alias("_name"), folder.alias("_folder")).withColumn("path", F.concat_ws("/", "_folder", "_name")).distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(_shown_path().alias("path"), "content")
    name = F.concat_ws("/", F.lit("raw"), "subset", F.element_at(F.split("_name", "/"), -1))
    return want.join(files, "path").select(F.concat(F.lit(RESULTS), "entry_id").alias("folder"), name.alias("name"), "content")


def write_entry_files(entries: DataFrame, papers: DataFrame, index: DataFrame, folder: str, raw: DataFrame | None = None) -> None:
    """results-<id>/entry.json of each entry with its papers, ``raw`` files beside it, then results-index.json; writing again replaces.

    Executors write the entries' files and a commit puts each entry in place whole; the index comes last, so it never
    names an entry that is not there.  The index is a board, one small file.
    """
    files = entry_documents(entries, papers)
    folders.write_folders(files if raw is None else files.unionByName(raw), folder.rstrip("/"))
    write_index(index, folder)


def write_index(index: DataFrame, folder: str) -> None:
    """results-index.json in board order: a row per taker, so one small file, written by the driver."""
    import json

    from scorewright.operators.results import board_key

    rows = [json.loads(r["json"]) for r in index.orderBy(board_key(), "entry_id").select(F.to_json(F.struct("*")).alias("json")).toLocalIterator()]
    write_text(index.sparkSession, f"{folder.rstrip('/')}/results-index.json", json.dumps({"entries": rows}, ensure_ascii=False, indent=2) + "\n")


def publish(spark: SparkSession, paths: list[str], bundles: str, out: str, model: str | None = None, entry: str | None = None, fallback: bool = False) -> DataFrame:
    """From bench folders to published files below ``out``; the index's rows come back.

    Runs become entries by model and effort (or the one ``entry``), their questions fall into the two halves of the score
    by the rules of the bundle named like their subset, or with ``fallback`` by mode where it is absent.  An entry
    published before is replaced in the folder and in the index, others stay.
    """
    name = F.element_at(F.split("folder", "/"), -1)
    rules = read_rules(spark, bundles).select(name.alias("subset"), "question_id", "kind")
    found = json_text(spark, bundles, "exam.json").select(name.alias("subset"), "folder").distinct()
    runs = with_bundles(load_runs(spark, *paths, model=model), found, fallback=fallback)
    taker = default_entry_id(F.col("model"), F.col("effort")) if entry is None else F.lit(entry)
    runs = runs.withColumns({"entry_id": taker, "run_id": F.concat_ws("#", "folder", "pos"), "secs": F.col("solve_secs")})
    asked = runs.where("status = 'ok'").select("run_id", "subset", "classification", F.inline("results")).join(rules, ["subset", "question_id"], "left")
    by = F.when(F.col("classification") == "rules", results.rule_class(F.col("kind"))).otherwise(results.class_from_mode(F.col("mode")))
    papers = results.paper_results(results.classify_points(asked, rule=by), runs)
    head = results.entries(runs).drop("papers")
    new = results.index_entries(papers).join(head.select("entry_id", "model", "effort"), "entry_id")
    shape = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in new.schema)
    old = read_index(spark, out, shape)
    # the index is a board: few rows, kept before its file is replaced
    index = new if old is None else results.upsert(spark.createDataFrame(old.collect(), new.schema), new, "entry_id")
    write_entry_files(head, papers, index, out, raw_files(spark, runs, paths[0]) if len(paths) == 1 else None)
    return read_index(spark, out, shape)


def reindex(spark: SparkSession, folder: str) -> DataFrame:
    """Rebuild results-index.json from the entry files below ``folder``."""
    index = results.reindex(read_entries(spark, folder))
    write_index(index, folder)
    return index


PAPER = (
    "subset: string, ok_runs: int, deterministic_awarded: double, deterministic_covered_max: double, judge_awarded: double, judge_covered_max: double, solve_secs: double"
)


def read_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Papers of all entry files below ``folder`` with the path they come from, as ``results.reindex`` takes them."""
    found = whole_json(spark, folder, f"entry_id string, papers array<struct<{PAPER}>>", "entry.json")
    return found.select("entry_id", F.col("folder").alias("path"), F.inline("papers"))


def read_index(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """Rows of results-index.json, None if there is no such file; one that cannot be read stops the job and is not reset."""
    path = f"{folder.rstrip('/')}/results-index.json"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    found = spark.read.schema(f"entries array<struct<{schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return found.select(F.inline("entries"))

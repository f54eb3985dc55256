"""Sources, sinks and streaming."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from scorewright.operators import grading
from scorewright.sources import io
from scorewright.streaming import board


def test_bench_folder(spark, tmp_path):
    row = {"model": "m", "slug": "m", "run_index": 1, "status": "ok", "awarded": 4.0}
    for name, rows in (("a", [row, row | {"model": "n", "status": "solve_error"}]), ("b/c", [row])):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "bench.json").write_text(json.dumps({"exam_id": name, "rows": rows}, indent=2))
    (tmp_path / "a" / "m.grade.json").write_text(json.dumps({"exam_id": "a", "results": {"q1": {"mode": "judge", "max_points": 2, "awarded": 1}}}, indent=1))
    runs = io.read_runs(spark, str(tmp_path))
    assert sorted((r.exam_id, r.pos, r.model) for r in runs.collect()) == [("a", 0, "m"), ("a", 1, "n"), ("b/c", 0, "m")]
    assert io.read_runs(spark, str(tmp_path), "n").count() == 1
    reports = io.read_reports(spark, str(tmp_path))
    assert [(r.question_id, r.mode) for r in reports.collect()] == [("q1", "judge")]
    assert [r.exam_id for r in io.runs_without_report(runs, reports).collect()] == ["b/c"]
    (tmp_path / "a" / "bench.json").write_text("{ no json")
    with pytest.raises(Exception, match="(?i)malformed|parse|FAILFAST"):
        io.read_runs(spark, str(tmp_path)).collect()


def test_lines(spark):
    lines = spark.createDataFrame([("s", 0, '{"type": "x", "n": 1}'), ("s", 1, "noise"), ("s", 2, '{"type": "result", "n": 2}'), ("s", 3, '{"type": "result", "n": 3}'), ("s", 4, '{"broken')], "stream string, line_no int, value string")
    assert sorted(r.n for r in io.json_lines(lines, "type string, n int").collect()) == [1, 2, 3]
    assert json.loads(io.last_result(lines).collect()[0].result)["n"] == 3
    d = spark.createDataFrame([('{"error": "e"}',), ('{"result": "", "message": "m"}',)], "t string").select(io.failure_detail(F.col("t")).alias("d")).collect()
    assert [r.d for r in d] == ["e", "m"]


def test_listing(spark):
    files = spark.createDataFrame([("a-115-x/exam.json",), ("results-e/exam.json",), ("results-e1/entry.json",), ("b/other.json",)], "path string")
    assert [r.subset for r in io.subsets(files).collect()] == ["a-115-x"]
    assert [r.path for r in io.select_files(files, "e?").collect()] == ["results-e1/entry.json"]
    ok = spark.createDataFrame([("a/b",), ("a",), ("-a/b",)], "t string").select(io.is_repo_id(F.col("t")).alias("x")).collect()
    assert [r.x for r in ok] == [True, False, False]


def test_blocks():
    card = io.replace_block("# Title", "<!-- a -->", "<!-- /a -->", "one")
    assert card == "# Title\n\n<!-- a -->\none\n<!-- /a -->\n"
    again = io.replace_block(card + "tail", "<!-- a -->", "<!-- /a -->", "two")
    assert again == "# Title\n\n<!-- a -->\ntwo\n<!-- /a -->\ntail"
    assert io.replace_block(again, "<!-- a -->", "<!-- /a -->", "two") == again


def test_question_table_replaces_one_entry(spark, tmp_path):
    rows = lambda e, x: spark.createDataFrame([(e, x)], "entry_id string, x int")
    at = str(tmp_path / "t")
    for e, x in (("a", 1), ("b", 2), ("a", 3)):
        io.write_questions(rows(e, x), at)
    assert sorted((r.entry_id, r.x) for r in spark.read.parquet(at).collect()) == [("a", 3), ("b", 2)]


def test_pages_and_sources(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"abc")
    s = io.read_sources(spark, str(tmp_path))
    assert s.collect()[0].sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    pages = io.pages_of(s, lambda path, content: [(i, content[i : i + 1]) for i in range(len(content))]).collect()
    assert [(r.page, bytes(r.image)) for r in pages] == [(0, b"a"), (1, b"b"), (2, b"c")]


def test_stream(spark, tmp_path):
    source, table, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = lambda *xs: spark.createDataFrame([("e", "p", 1, q, "deterministic", 2.0, a, dt.datetime(2026, 1, 1, h)) for q, a, h in xs], board.QUESTION)
    rows(("q1", 1.0, 1), ("q1", 1.0, 1), ("q2", 2.0, 1)).write.mode("append").json(source)
    board.start(board.reports(spark, source), table, mark).awaitTermination()
    rows(("q1", 9.0, 2), ("q3", 2.0, 2)).write.mode("append").json(source)
    board.start(board.reports(spark, source), table, mark).awaitTermination()
    now = board.current(spark.read.parquet(table))
    assert {(r.question_id, r.awarded) for r in now.collect()} == {("q1", 1.0), ("q2", 2.0), ("q3", 2.0)}
    assert board.board(now).collect()[0].awarded == 5
    assert {(r.start.hour, r.questions) for r in board.windowed_progress(now).collect()} == {(1, 2), (2, 1)}


def test_command_line(spark, tmp_path, capsys):
    from scorewright import __main__ as cli
    from tests.test_bundles import bundle as whole_bundle
    from tests.test_bundles import grading

    good, bad = tmp_path / "bundles" / "tiny", tmp_path / "bad" / "tiny"
    whole_bundle(spark, good)
    assert cli.main(["validate", str(tmp_path / "bundles")]) == 0
    spec = grading()
    spec["questions"]["q1"]["rule"]["correct"] = ["Z"]
    del spec["questions"]["q7"]
    whole_bundle(spark, bad, **{"grading.json": spec})
    assert cli.main(["validate", str(tmp_path / "bad")]) == 1
    assert set(capsys.readouterr().out.split("\n")) >= {"tiny: no rule: q7", "tiny: unknown option: q1: Z"}
    row = {"model": "lab:m", "slug": "m", "run_index": 1, "status": "ok", "awarded": 4.0, "covered_max": 8.0}
    (tmp_path / "bench.json").write_text(json.dumps({"exam_id": "tiny", "effort": "low", "rows": [row]}))
    assert cli.main(["board", str(tmp_path)]) == 0 and cli.main(["runs", str(tmp_path)]) == 0
    out = capsys.readouterr().out
    assert "lab-m-low" in out and "50.0" in out


def test_from_files_to_published_results(spark, tmp_path, capsys):
    """Grade a sheet, publish bench folders twice, rebuild the index."""
    from scorewright import __main__ as cli
    from tests.test_bundles import bundle as whole_bundle

    bundles, sheets, out = tmp_path / "bundles", tmp_path / "sheets", tmp_path / "out"
    whole_bundle(spark, bundles / "tiny")
    sheets.mkdir()
    answers = {"q1": {"type": "single_choice", "selected": "B"}, "q3": {"type": "true_false", "value": False}, "q4": {"type": "fill_in_blank", "blanks": {"b1": " PARIS", "b2": "pi"}}}
    (sheets / "m-answers.json").write_text(json.dumps({"exam_id": "tiny", "taker": "m", "answers": answers}))
    assert cli.main(["grade", str(bundles), str(sheets), "--out", str(tmp_path / "graded")]) == 0
    t = grading.report_totals(spark.read.parquet(str(tmp_path / "graded"))).first()
    assert (t.awarded, t.total_points, t.unanswered) == (4, 17, 5)
    assert cli.main(["grade", str(bundles), str(sheets), "--text-only", "--out", str(tmp_path / "text")]) == 0
    assert grading.report_totals(spark.read.parquet(str(tmp_path / "text"))).first().skipped == 5  # the section shows a figure

    def run(at, model, effort, *points):
        at.mkdir(parents=True)
        rows = []
        for i, (q1, q7) in enumerate(points, 1):
            name = f"{model}-{i}-report.json"
            results = {"q1": {"mode": "deterministic", "max_points": 2, "awarded": q1}, "q7": {"mode": "judge", "max_points": 2, "awarded": q7}}
            (at / name).write_text(json.dumps({"exam_id": "tiny", "results": results}))
            rows.append({"model": f"lab:{model}", "slug": model, "run_index": i, "status": "ok", "report_path": name, "solve_secs": 2.0})
        (at / "bench.json").write_text(json.dumps({"exam_id": "tiny", "bundle_dir": "/elsewhere/tiny", "effort": effort, "rows": rows}))

    run(tmp_path / "runs" / "a", "a", "low", (2, 1), (0, 1))
    assert cli.main(["publish", str(tmp_path / "runs"), "--bundles", str(bundles), "--out", str(out)]) == 0
    run(tmp_path / "more" / "b", "b", "high", (2, 2))
    assert cli.main(["publish", str(tmp_path / "more"), "--bundles", str(bundles), "--out", str(out)]) == 0
    index = json.loads((out / "results-index.json").read_text())["entries"]
    assert [(e["entry_id"], e["awarded"], e["covered_max"], e["percentage"], e["det_awarded"]) for e in index] == [("lab-b-high", 4, 4, 100, 2), ("lab-a-low", 2, 4, 50, 1)]
    paper = json.loads((out / "results-lab-a-low" / "entry.json").read_text())["papers"][0]
    assert (paper["subset"], paper["ok_runs"], paper["judge_awarded"], paper["awarded_samples"]) == ("tiny", 2, 1, [3, 1])
    assert (out / "results-lab-a-low" / "raw" / "tiny" / "a-1-report.json").read_text() == (tmp_path / "runs" / "a" / "a-1-report.json").read_text()
    (out / "results-index.json").unlink()
    assert cli.main(["reindex", str(out)]) == 0
    assert [e["percentage"] for e in json.loads((out / "results-index.json").read_text())["entries"]] == [100, 50]
    with pytest.raises(ValueError, match="no bundle for tiny"):
        cli.main(["publish", str(tmp_path / "runs"), "--bundles", str(tmp_path / "sheets"), "--out", str(out)])
    assert cli.main(["publish", str(tmp_path / "runs"), "--bundles", str(sheets), "--out", str(out), "--mode-fallback"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["grade", "one"])
    assert "lab-a-low" in capsys.readouterr().out


def test_every_judge_gives_a_verdict(spark):
    from scorewright.operators import seams

    tasks = spark.createDataFrame([("r", "q", "{}")], "run_id string, question_id string, task string")
    judges = spark.range(1200).selectExpr("cast(id % 1100 as string) AS judge")
    got = seams.judge(tasks, judges, lambda judge, task: {"total": 1.0}).collect()
    assert len(got) == 1100 and {r.judge for r in got} == {str(i) for i in range(1100)} and all(r.status == "ok" for r in got)


def bundle(folder):
    """The tiny exam and its whole rules as files."""
    from tests import fixtures as X

    rule = lambda kind, **more: {"kind": kind} | more
    rules = {
        "q1": (2, rule("choice", correct=["B"])),
        "q2": (3, rule("choice", correct=["A", "C"], partial_credit=True, wrong_selection_penalty=0.5)),
        "q3": (1, rule("true_false", correct=True, negative_marking=-0.5)),
        "q4": (2, rule("fill_in_blank", blanks={"b1": {"accepted": ["Oslo"], "weight": 3}, "b2": {"accepted": ["2.72"]}}, normalization={"numeric_tolerance": 0.01, "case_insensitive": False})),
        "q5": (2, rule("matching", correct_pairs={"L1": "R2", "L2": "R1"}, wrong_pair_penalty=0.25)),
        "q6.a": (2, rule("judge", reference_answer="x")),
        "q6.b": (3, rule("judge", rubric=[{"id": "c", "description": "?", "levels": [{"points": 0, "descriptor": "none"}, {"points": 3, "descriptor": "all"}]}])),
        "q7": (2, rule("judge")),
    }
    spec = {"exam_id": "tiny", "judge": {"models": ["a", "b"], "aggregation": "median"}, "questions": {q: {"question_id": q, "max_points": p, "min_points": -1 if q == "q3" else 0, "rule": r} for q, (p, r) in rules.items()}}
    return json.loads(X.exam()), spec


def test_bundle_files_to_report(spark, tmp_path):
    from scorewright.operators import grading

    at = str(tmp_path / "bundles" / "one")
    exam, spec = bundle(at)
    io.write_bundle(spark, at, exam, spec, {"type": "object"})
    answers = {
        "q1": {"type": "single_choice", "selected": "B"}, "q2": {"type": "multiple_choice", "selected": ["A", "D"]}, "q3": {"type": "true_false", "value": False},
        "q4": {"type": "fill_in_blank", "blanks": {"b1": "oslo", "b2": "２．７２"}}, "q5": {"type": "matching", "pairs": {"L1": "R2", "L2": "R3"}},
        "q6.a": {"type": "text", "text": "?"}, "q7": {"type": "drawing", "description": "a line"},
    }
    (tmp_path / "sheets" / "x").mkdir(parents=True)
    (tmp_path / "sheets" / "x" / "m-answers.json").write_text(json.dumps({"exam_id": "tiny", "taker": "m", "answers": answers}, indent=1))
    sheets, runs = io.read_sheets(spark, str(tmp_path / "sheets"))
    assert [(r.run_id, r.taker) for r in runs.collect()] == [("x/m-answers", "m")]
    assert {r.question_id: r.selected for r in sheets.where("selected IS NOT NULL").collect()} == {"q1": ["B"], "q2": ["A", "D"]}
    verdicts = spark.createDataFrame([("x/m-answers", "q6.a", j, p) for j, p in (("a", 1.0), ("b", 2.0), ("c", 0.0))], "run_id string, question_id string, judge string, total double")
    got = {r.question_id: (r["mode"], r.awarded) for r in io.grade_folder(spark, str(tmp_path / "bundles"), str(tmp_path / "sheets"), verdicts).collect()}
    want = {"q1": 2.0, "q2": 1.0, "q3": -0.5, "q4": 0.5, "q5": 0.75}
    assert got == {q: ("deterministic", p) for q, p in want.items()} | {"q6.a": ("judge", 1.0), "q6.b": ("unanswered", 0.0), "q7": ("error", 0.0)}
    nodes, rules = io.read_bundles(spark, str(tmp_path / "bundles"))
    assert {r.section_id for r in rules.collect()} == {"s1"} and rules.where("aggregation = 'median'").count() == 8
    assert [(r.criterion_id, r.levels) for r in io.rubric_levels(rules).collect()] == [("c", [3.0, 0.0])]
    none = io.read_manifests(spark, str(tmp_path / "bundles"), rules.select("folder", "exam_id").distinct()).collect()[0]
    assert (none.name, none.version) == ("tiny", "1")
    assert grading.missing_rules(nodes.where("type <> 'composite'").withColumnRenamed("node_id", "question_id"), rules).count() == 0


def test_load_runs(spark, tmp_path):
    row = {"model": "m", "slug": "m", "run_index": 1, "status": "ok", "report_path": "m-report.json"}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "bench.json").write_text(json.dumps({"exam_id": "t", "bundle_dir": "/x/y/paper-1", "rows": [row, {"model": "n", "slug": "n", "run_index": 1, "status": "solve_error"}]}))
    with pytest.raises(ValueError, match="missing grade reports"):
        io.load_runs(spark, str(tmp_path))
    (tmp_path / "a" / "m-report.json").write_text(json.dumps({"exam_id": "t", "results": {"q1": {"mode": "judge", "max_points": 2, "awarded": 1}}}))
    got = {r.model: r for r in io.load_runs(spark, str(tmp_path), str(tmp_path / "a")).collect()}
    assert len(got) == 2 and got["m"].subset == "paper-1" and [(x.question_id, x.awarded) for x in got["m"].results] == [("q1", 1.0)] and got["n"].results is None
    assert io.load_runs(spark, str(tmp_path), str(tmp_path / "a")).count() == 2 and io.load_runs(spark, str(tmp_path), model="n").count() == 1
    with pytest.raises(ValueError, match="no runs"):
        io.load_runs(spark, str(tmp_path), model="other")
    runs = io.load_runs(spark, str(tmp_path)).select("subset", "model")
    some = spark.createDataFrame([("paper-2", "/b")], "subset string, folder string")
    with pytest.raises(ValueError, match="paper-1"):
        io.with_bundles(runs, some)
    assert {r.classification for r in io.with_bundles(runs, some, fallback=True).collect()} == {"mode-fallback"}


def test_entry_files_and_reindex(spark, tmp_path):
    from scorewright.operators import results

    papers = spark.createDataFrame([(e, s, 1, 3.0 + i, 8.0, 1.0, 2.0, 5.0) for i, e in enumerate("ab") for s in ("p1", "p2")], "entry_id string, subset string, ok_runs int, deterministic_awarded double, deterministic_covered_max double, judge_awarded double, judge_covered_max double, solve_secs double")
    entries = spark.createDataFrame([("a", "m", "low"), ("b", "n", None)], "entry_id string, model string, effort string")
    at, index = str(tmp_path / "out"), results.index_entries(papers)
    schema = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in index.schema)
    assert io.read_index(spark, at, schema) is None
    for _ in range(2):
        io.write_entry_files(entries, papers, index, at)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["results-a", "results-b", "results-index.json"]
    again = results.reindex(io.read_entries(spark, at))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, index.collect()))
    read = io.read_index(spark, at, schema).collect()
    assert [r.entry_id for r in read] == ["b", "a"] and read[0].awarded == 10
    (tmp_path / "out" / "results-index.json").write_text("{ broken")
    (tmp_path / "out" / ".results-index.json.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="(?i)malformed|parse|FAILFAST"):
        io.read_index(spark, at, schema).collect()

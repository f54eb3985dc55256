"""Bundle folders: nesting, figures, answer schemas, checks of files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scorewright.functions import render
from scorewright.operators import structure
from scorewright.sources import io
from tests import fixtures as X


def chain(depth, last=20):
    if depth == last:
        return {"id": f"n{depth}", "type": "essay", "points": 1.0, "prompt": X.text("leaf")}
    return {"id": f"n{depth}", "type": "composite", "points": 1.0, "prompt": X.text(f"level {depth}"), "children": [chain(depth + 1, last)]}


def test_any_depth_in_one_pass(spark):
    docs = [json.dumps({"exam_id": "deep", "sections": [{"id": "s", "questions": [chain(0), {"id": "z", "type": "essay"}]}]}), X.exam(), '{"exam_id": "bare", "sections": []}', "no json"]
    exams = spark.createDataFrame([(d, i) for i, d in enumerate(docs)], "json string, n int")
    nodes = structure.flatten_exam(exams, keep=("n",))
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan  # one narrow pass
    rows = {r.node_id: r for r in nodes.where("exam_id = 'deep'").collect()}
    assert len(rows) == 22 and rows["n20"].depth == 20 and rows["n20"].parent_id == "n19" and rows["n20"].path == [f"n{i}" for i in range(21)]
    assert rows["n20"].place == [0, 0, *[0] * 20] and rows["z"].place == [0, 1] and rows["z"].parent_id is None
    context = structure.question_table(nodes.where("exam_id = 'deep'"), spark.createDataFrame(X.RULES, X.RULE)).where("question_id = 'n20'").first().context
    assert context == "\n\n".join(f"level {i}" for i in range(20))
    assert {(r.n, r.exam_id) for r in nodes.select("n", "exam_id").distinct().collect()} == {(0, "deep"), (1, "tiny")}


def grading():
    rules = {
        "q1": {"kind": "choice", "correct": ["B"]},
        "q2": {"kind": "choice", "correct": ["A", "C"], "partial_credit": True},
        "q3": {"kind": "true_false", "correct": True},
        "q4": {"kind": "fill_in_blank", "blanks": {"b1": {"accepted": ["Paris"]}, "b2": {"accepted": ["3.14", "pi"]}}},
        "q5": {"kind": "matching", "correct_pairs": {"L1": "R2", "L2": "R1"}},
        "q6.a": {"kind": "judge"},
        "q6.b": {"kind": "judge", "reference_assets": ["assets/key.png"]},
        "q7": {"kind": "judge"},
    }
    points = {"q1": 2, "q2": 3, "q3": 1, "q4": 2, "q5": 2, "q6.a": 2, "q6.b": 3, "q7": 2}
    return {"exam_id": "tiny", "questions": {q: {"question_id": q, "max_points": points[q], "rule": r} for q, r in rules.items()}}


def schema_of(spark, exam):
    nodes = structure.flatten_exam(spark.createDataFrame([(exam,)], "json string"))
    return json.loads(render.answer_schema(structure.leaves(nodes)).first().schema)


def write(folder, name, value):
    at = folder / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(value) if isinstance(value, bytes) else at.write_text(value if isinstance(value, str) else json.dumps(value, indent=3))


def bundle(spark, folder, **changed):
    exam = X.exam(stimulus_image=True, section_image=True)
    files = {"exam.json": exam, "grading.json": grading(), "answer_schema.json": schema_of(spark, exam)}
    files |= {f"assets/{n}.png": f"bytes of {n}".encode() for n in ("q1-fig1", "s", "i", "key")}
    for name, value in (files | changed).items():
        if value is not None:
            write(folder, name, value)


def test_answer_schema_is_complete(spark):
    s = schema_of(spark, X.exam())
    assert s["required"] == ["exam_id", "answers"] and s["additionalProperties"] is False and s["title"] == "Answer sheet for Tiny"
    assert s["properties"]["exam_id"] == {"const": "tiny"} and s["properties"]["taker"] == {"type": ["string", "null"]}
    answers = s["properties"]["answers"]
    assert answers["required"] == ["q1", "q2", "q3", "q4", "q5", "q6.a", "q6.b", "q7"] == list(answers["properties"])
    p = answers["properties"]
    assert p["q1"] == {"type": "object", "additionalProperties": False, "properties": {"type": {"const": "single_choice"}, "selected": {"enum": list("ABCD")}}, "required": ["type", "selected"]}
    assert p["q2"]["properties"]["selected"] == {"type": "array", "uniqueItems": True, "items": {"enum": list("ABCD")}}
    assert p["q4"]["properties"]["blanks"]["required"] == ["b1", "b2"]
    assert p["q5"]["properties"]["pairs"]["properties"] == {"L1": {"enum": ["R1", "R2", "R3"]}, "L2": {"enum": ["R1", "R2", "R3"]}}
    assert p["q6.a"]["properties"]["type"] == {"const": "text"} and p["q7"]["properties"]["image_asset"] == {"type": ["string", "null"]}
    assert p["q7"]["required"] == ["type", "description"]


def test_table_with_bytes_of_figures(spark, tmp_path):
    bundle(spark, tmp_path / "a b", **{"assets/q1-fig1.png": None})
    bundle(spark, tmp_path / "other", **{"assets/huge.png": b"x" * 5000})
    rows = io.question_table(spark, str(tmp_path)).collect()
    table = io.question_table(spark, str(tmp_path))
    assert table.columns == ["exam_id", "question_id", "number", "section_id", "section_title", "type", "points", "context", "prompt", "options", "blanks", "matching", "grading", "images", "image_alts"]
    assert dict(table.dtypes)["images"] == "array<binary>"
    of = {}
    for r in rows:
        of.setdefault(r.question_id, []).append([None if x is None else bytes(x) for x in r.images])
    assert sorted(of["q1"], key=str) == [[None], [b"bytes of q1-fig1"]]  # one folder has no such file
    assert of["q6.a"] == [[b"bytes of s"], [b"bytes of s"]] and of["q7"] == [[], []]
    assert b"bytes of key" not in [x for v in of.values() for images in v for x in images]  # a key's figure is in no row
    assert {r.grading for r in rows if r.question_id == "q5"} == {"matching"} and {r.prompt for r in rows if r.question_id == "q1"} == {"Look:\n\n[Figure: figure]"}


def found(spark, path):
    return {(r.folder.rsplit("/", 1)[-1], r.check, r.subject) for r in io.check_bundles(spark, str(path)).collect()}


def test_checks_of_folders(spark, tmp_path):
    bundle(spark, tmp_path / "good")
    bundle(spark, tmp_path / "no-rules", **{"grading.json": None})
    bundle(spark, tmp_path / "broken", **{"exam.json": "{"})
    bundle(spark, tmp_path / "foreign", **{"grading.json": grading() | {"exam_id": "else"}})
    bundle(spark, tmp_path / "stale", **{"answer_schema.json": {"type": "object"}})
    bundle(spark, tmp_path / "bare", **{"assets/i.png": None, "assets/key.png": None})
    g = grading()
    g["questions"]["q5"]["rule"]["correct_pairs"] = {"L9": "R2", "L2": "R9"}
    g["questions"]["q3"]["question_id"] = "q0"
    del g["questions"]["q7"]
    bundle(spark, tmp_path / "rules", **{"grading.json": g})
    assert found(spark, tmp_path) == {
        ("no-rules", "missing file", "grading.json"),
        ("broken", "not readable", "exam.json"),
        ("foreign", "other exam id", "else"),
        ("stale", "stale schema", "answer_schema.json"),
        ("bare", "missing asset", "q1: assets/i.png"),
        ("bare", "missing reference", "q6.b: assets/key.png"),
        ("rules", "unknown left item", "q5: L9"),
        ("rules", "unknown right item", "q5: R9"),
        ("rules", "other key", "q3"),
        ("rules", "no rule", "q7"),
    }


def test_sheets_that_may_lack_answers(spark):
    nodes = structure.flatten_exam(spark.createDataFrame([(X.exam(),)], "json string"))
    answers = spark.createDataFrame(X.ANSWERS, X.ANSWER).where("run_id = 'imperfect'")
    runs = spark.createDataFrame([("imperfect", "tiny")], "run_id string, exam_id string")
    lack = spark.createDataFrame([("imperfect", "q6.a"), ("imperfect", "q7")], "run_id string, question_id string")
    got = structure.sheet_problems(nodes, answers, runs, lack).collect()
    assert [(r.check, r.subject) for r in got] == [("no answer", "/answers/q6.b")]
    twice = answers.withColumn("selected", F.when(F.col("question_id") == "q2", F.array(*map(F.lit, "AAB"))).otherwise(F.col("selected")))
    assert {(r.check, r.subject) for r in structure.sheet_problems(nodes, twice, runs, lack).collect()} == {("no answer", "/answers/q6.b"), ("repeated option", "/answers/q2: A")}


@pytest.mark.parametrize("path,bad", [("a.png", False), ("../a.png", True), ("/a.png", True), ("a/..b.png", False), ("a\\..\\b.png", True)])
def test_paths_out_of_a_bundle(spark, path, bad):
    assert spark.range(1).select(structure.is_unsafe(F.lit(path))).first()[0] == bad

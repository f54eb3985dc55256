"""Golden prompts, judges' tasks, verdicts by position, medians, gap repair."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from scorewright.operators import ingest, judging, prompts, reliability, structure
from tests import fixtures as X


@pytest.fixture(scope="module")
def nodes(spark):
    exam = X.exam(section_image=True, stimulus_image=True)
    return structure.flatten_exam(spark.createDataFrame([(exam,)], "json string")).withColumn("exam_subject", F.lit("Maths")).cache()


def shown(parts):
    return [p.text if p.text is not None else f"<{p.asset}>" for p in parts]


def test_golden_prompts(nodes):
    p = {r.question_id: shown(r.parts) for r in prompts.prompts(nodes).collect()}
    top = ["# Tiny (Maths)", "Read carefully.", "[Figure 1: figure]", "<assets/i.png>"]
    assert p["q1"] == [*top, "### Question 1. (2 points)", "Look:", "[Figure 1: figure]", "<assets/q1-fig1.png>", "Options:", "(A)", "A", "(B)", "B", "(C)", "C", "(D)", "D", prompts.NOTES["single_choice"]]
    assert p["q4"][-1] == "Fill every blank. Blanks: b1 (i), b2 (ii)."
    assert p["q6.b"] == [*top, "### Context for question 6.", "Stimulus", "[Figure 1: figure]", "<assets/s.png>", "### Question (b) (3 points)", "?", prompts.OPEN_NOTE]
    assert p["q5"][-7:] == ["Left items:", "[L1]", "[L2]", "Right items:", "[R1]", "[R2]", "[R3]", prompts.NOTES["matching"]][-7:] and p["q7"][-1] == prompts.NOTES["drawing"]


def test_golden_judge_task(spark, nodes):
    rubric = "array<struct<id: string, description: string, levels: array<struct<points: double, descriptor: string>>>>"
    rules = spark.createDataFrame(
        [("tiny", "q6.b", "judge", 3.0, "Be fair.", [("c", "content", [(0.0, "none"), (2.5, "all")])], "Because.", ["assets/key.png"], False), ("tiny", "q6.a", "judge", 2.0, None, None, None, None, None), ("tiny", "q1", "choice", 2.0, *[None] * 5)],
        f"exam_id string, question_id string, kind string, max_points double, judge_instructions string, rubric {rubric}, reference_answer string, reference_assets array<string>, include_images boolean",
    )
    answers = spark.createDataFrame([("r", "tiny", q, "text", None, None, None, None, t) for q, t in (("q6.b", "my essay"), ("q6.a", "é"), ("q1", "x"))], X.ANSWER)
    tasks = prompts.judge_tasks(nodes, rules, answers)
    got = {r.question_id: shown(r.parts) for r in tasks.collect()}
    assert set(got) == {"q6.a", "q6.b"}
    at = got["q6.b"].index(prompts.OPEN_NOTE)
    assert not [p for p in got["q6.b"][:at] if p.startswith("<")]  # no figures of the question
    assert got["q6.b"][at + 1 :] == ["Most points for this question: 3.", "Instructions for marking:\nBe fair.", "Rubric (give each criterion the points of one of its levels):\n- Criterion 'c': content\n    - 2.5 points: all\n    - 0 points: none", "Reference answer:\nBecause.", "[Reference figure]", "<assets/key.png>", "--- Answer ---", "my essay"]
    assert got["q6.a"][-3:] == ["Most points for this question: 2.", "--- Answer ---", "é"] and "<assets/s.png>" in got["q6.a"]
    files = spark.createDataFrame([("b/assets/s.png", b"12345"), ("b/assets/i.png", b"123"), ("b/assets/other.png", b"0")], "path string, content binary")
    sized = {r.question_id: r for r in prompts.with_bytes(tasks.withColumn("folder", F.lit("b")), files, ["run_id", "exam_id", "question_id"]).collect()}
    a = sized["q6.a"]
    assert [bytes(p.image) for p in a.parts if p.image is not None] == [b"123", b"12345"] and a.bytes == sum(len((p.text or "").encode()) for p in a.parts) + 8
    assert all(p.image is None for p in sized["q6.b"].parts)  # the key's figure has no file here


def test_takers_who_cannot_see(spark, nodes):
    takers = spark.createDataFrame([("blind", "tiny", ["text"]), ("all", "tiny", None)], "run_id string, exam_id string, capabilities array<string>")
    rows = {(r.run_id, r.question_id): r.missing for r in prompts.within(prompts.prompts(nodes), structure.modalities(nodes), takers).collect()}
    assert rows["blind", "q1"] == ["image"] and rows["all", "q1"] == [] and len(rows) == 16


def test_broken_verdicts_cost_only_themselves(spark):
    good = '{"total_points": 2, "rationale": "r", "criteria": [{"id": "a", "points": 1}]}'
    rows = spark.createDataFrame(
        [("r", "q1", ["x", "y", "z"], [good, "{", '{"total_points": "NaN"}']), ("r", "q2", ["x", "y"], [good]), ("r", "q3", ["x"], [good, good]), ("r", "q4", [], []), ("r", "q5", None, None), ("r", "q6", ["x"], ['{"total_points": 1, "criteria": [{"id": "a"}, {"points": 2}, {"id": "b", "points": 0}]}']), ("r", "q7", ["x"], [None])],
        "run_id string, question_id string, judge_models array<string>, judge_verdicts array<string>",
    )
    got = {(r.question_id, r.pos): r for r in judging.zipped_verdicts(rows).collect()}
    assert set(got) == {("q1", 0), ("q1", 1), ("q1", 2), ("q2", 0), ("q3", 0), ("q6", 0), ("q7", 0)}
    assert [got["q1", i].problem for i in range(3)] == [None, "not readable", "no total"] and got["q1", 0].judge == "x" and got["q1", 0].rationale == "r"
    assert got["q6", 0].problem == "bad criteria" and [tuple(s) for s in got["q6", 0].scores] == [("b", 0.0)] and got["q7", 0].problem == "not readable"
    assert {r.judge: (r["mean"], r.verdicts) for r in judging.judge_means_by_position(rows).collect()}["x"] == (pytest.approx(7 / 4), 4)


@pytest.mark.parametrize("parts", [1, 3, 1024])
def test_medians_without_gathering(spark, monkeypatch, parts):
    monkeypatch.setattr(reliability, "PARTS", parts)
    rng = random.Random(2)
    groups = {"even": [rng.gauss(0, 5) for _ in range(100)], "odd": [rng.randrange(4) for _ in range(51)], "one": [7.0], "two": [1.0, 2.0], "same": [3.0] * 9, "wide": [-1e12, 0.0, 1e-9, 2e-9, 1e12], "ties": [1.0] * 50 + [2.0] * 50}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: (r["median"], r.n) for r in reliability.exact_median(df, ["g"], "x").collect()}
    assert got == {g: (pytest.approx(statistics.median(xs), abs=1e-12), len(xs)) for g, xs in groups.items()}
    flat = [x for _, x in rows if x is not None]
    assert reliability.exact_median(df, [], "x").first()["median"] == pytest.approx(statistics.median(flat)) and reliability.exact_median(df.where("x IS NULL"), [], "x").count() == 0


def test_gap_repair_rounds(spark):
    """One round asks for what is missing on the right pages only; a second for what the first left; absurd gaps are not asked for."""
    numbers = {"a": [1, 2, 5, 6, 9], "b": [1, 2, 90], "c": [1, 2, 3], "d": [1, 4]}
    q = spark.createDataFrame([(d, f"{n}.", 10 * i, f"text {n}") for d, ns in numbers.items() for i, n in enumerate(ns)], "doc string, number string, pos int, text string")
    chunks = spark.createDataFrame([(d, (n - 1) // 2, n) for d, ns in numbers.items() for n in ns], "doc string, chunk int, n int")
    pages = spark.createDataFrame([(d, p, p) for d in numbers for p in range(5)], "doc string, page_index int, chunk int")
    gaps = ingest.find_gaps(q, ["doc"])
    asked = {(r.doc, r.first, r.last): r.pages for r in ingest.gap_pages(gaps, chunks, pages, ["doc"]).collect()}
    assert asked["a", 3, 4] == [0, 2] and asked["a", 7, 8] == [2, 4] and asked["b", 3, 89] == [0, 1, 2, 3, 4] and asked["d", 2, 3] == [0, 1]

    def extract(request):
        assert request["doc"] in "ad" and request["label"]
        if request["doc"] == "d":
            raise RuntimeError("the model is away")
        return [str(request["first"]), "1", "99"]  # one of two, one that is there, one not asked for

    out, left = ingest.repair_gaps(q, chunks, pages, extract, ["doc"], rounds=2)
    got = {}
    for r in out.orderBy("doc", "pos").collect():
        got.setdefault(r.doc, []).append((r.number, r.round, r.text))
    assert [(n.rstrip("."), i) for n, i, _ in got["a"]] == [("1", 0), ("2", 0), ("3", 1), ("4", 2), ("5", 0), ("6", 0), ("7", 1), ("8", 2), ("9", 0)]
    assert all((t is None) == (i > 0) for _, i, t in got["a"]) and [len(got[d]) for d in "bcd"] == [3, 3, 2]
    assert {(r.doc, r.first, r.last) for r in left.collect()} == {("b", 3, 89), ("d", 2, 3)}
    once, rest = ingest.repair_gaps(q, chunks, pages, extract, ["doc"], rounds=1)
    assert {(r.doc, r.first, r.last) for r in rest.collect()} == {("a", 4, 4), ("a", 8, 8), ("b", 3, 89), ("d", 2, 3)}
    assert {r.doc: r.warning for r in ingest.gap_warnings(left, out, ["doc"]).collect()} == {"b": "87 question number(s) missing across 1 run(s); too many to repair", "d": "question(s) 2-3 still missing after re-extraction"}
    tail = q.where("doc = 'c'").withColumn("last_number", F.lit(5))
    asked = ingest.gap_pages(ingest.find_gaps(tail, ["doc"], expected="last_number"), chunks, pages, ["doc"]).collect()
    assert [(r.first, r.last, r.pages) for r in asked] == [(4, 5, [1, 2, 3, 4])]


def test_index_lines(spark):
    rows = spark.createDataFrame([("q1", "1.", "single_choice", 2.5, ["A", "B"], None, None, None), ("q2", None, "fill_in_blank", 3.0, None, [("b1", "i"), ("b2", None)], None, None), ("q3", "3", "matching", 10.0, None, None, ["L1"], ["R1", "R2"]), ("q4", "4", "essay", 0.0, None, None, None, None)],
                                 "question_id string, number string, type string, points double, options array<string>, blanks array<struct<id: string, label: string>>, left array<string>, right array<string>")
    assert [r.line for r in ingest.index_lines(rows).orderBy("question_id").collect()] == [
        "- number: '1.' | type: single_choice | points: 2.5 | options: A,B",
        "- number: 'q2' | type: fill_in_blank | points: 3 | blanks: b1(i),b2",
        "- number: '3' | type: matching | points: 10 | left: L1 | right: R1,R2",
        "- number: '4' | type: essay | points: 0",
    ]

"""The tiny exam of 17 points as JSON documents and relations."""

from __future__ import annotations

import json


def text(t="?"):
    return [{"type": "text", "markdown": t}]


def image(path):
    return {"type": "image", "asset": path, "alt": "figure"}


def options(*ids):
    return [{"id": i, "content": text(i)} for i in ids]


def exam(section_image=False, stimulus_image=False):
    questions = [
        {"id": "q1", "number": "1.", "type": "single_choice", "points": 2, "prompt": [*text("Look:"), image("assets/q1-fig1.png")], "options": options(*"ABCD")},
        {"id": "q2", "number": "2.", "type": "multiple_choice", "points": 3, "prompt": text(), "options": options(*"ABCD")},
        {"id": "q3", "number": "3.", "type": "true_false", "points": 1, "prompt": text()},
        {"id": "q4", "number": "4.", "type": "fill_in_blank", "points": 2, "prompt": text(), "blanks": [{"id": "b1", "label": "(i)"}, {"id": "b2", "label": "(ii)"}]},
        {"id": "q5", "number": "5.", "type": "matching", "points": 2, "prompt": text(), "matching": {"left": [{"id": "L1"}, {"id": "L2"}], "right": [{"id": "R1"}, {"id": "R2"}, {"id": "R3"}]}},
        {
            "id": "q6", "number": "6.", "type": "composite", "points": 5, "prompt": [*text("Stimulus"), *([image("assets/s.png")] if stimulus_image else [])],
            "children": [{"id": "q6.a", "number": "(a)", "type": "short_answer", "points": 2, "prompt": text()}, {"id": "q6.b", "number": "(b)", "type": "essay", "points": 3, "prompt": text()}],
        },
        {"id": "q7", "type": "drawing", "points": 2, "prompt": text()},
    ]
    instructions = [*text("Read carefully."), *([image("assets/i.png")] if section_image else [])]
    return json.dumps({"id": "tiny", "title": "Tiny", "total_points": 17, "sections": [{"id": "s1", "instructions": instructions, "questions": questions}]})


RULE = (
    "exam_id string, section_id string, question_id string, kind string, max_points double, min_points double, correct array<string>, correct_bool boolean, partial_credit boolean, "
    "wrong_penalty double, negative double, ratios array<double>, blanks array<struct<id: string, accepted: array<string>, weight: double>>, tolerance double, relative boolean, all_or_nothing boolean, pairs map<string,string>"
)
ANSWER = "run_id string, exam_id string, question_id string, type string, selected array<string>, value boolean, blanks map<string,string>, pairs map<string,string>, text string"


def rule(q, kind, points, **more):
    names = [c.strip().split(" ")[0] for c in ("exam_id s, section_id s, question_id s, kind s, max_points d, min_points d, correct a, correct_bool b, partial_credit b, wrong_penalty d, negative d, ratios a, blanks a, tolerance d, relative b, all_or_nothing b, pairs m").split(",")]
    row = {"exam_id": "tiny", "section_id": "s1", "question_id": q, "kind": kind, "max_points": float(points), "min_points": 0.0} | more
    return tuple(row.get(n) for n in names)


RULES = [
    rule("q1", "choice", 2, correct=["B"]),
    rule("q2", "choice", 3, correct=["A", "C"], partial_credit=True),
    rule("q3", "true_false", 1, correct_bool=True),
    rule("q4", "fill_in_blank", 2, blanks=[("b1", ["Paris"], 1.0), ("b2", ["3.14", "pi"], 1.0)], tolerance=0.01),
    rule("q5", "matching", 2, pairs={"L1": "R2", "L2": "R1"}),
    rule("q6.a", "judge", 2),
    rule("q6.b", "judge", 3),
    rule("q7", "judge", 2),
]


def answer(run, q, kind, **more):
    return (run, "tiny", q, kind, more.get("selected"), more.get("value"), more.get("blanks"), more.get("pairs"), more.get("text"))


ANSWERS = [
    answer("perfect", "q1", "single_choice", selected=["B"]),
    answer("perfect", "q2", "multiple_choice", selected=["A", "C"]),
    answer("perfect", "q3", "true_false", value=True),
    answer("perfect", "q4", "fill_in_blank", blanks={"b1": "  PARIS ", "b2": "3.1416"}),
    answer("perfect", "q5", "matching", pairs={"L1": "R2", "L2": "R1"}),
    answer("perfect", "q6.a", "short_answer", text="x"),
    answer("perfect", "q6.b", "essay", text="y"),
    answer("perfect", "q7", "drawing", text="z"),
    answer("imperfect", "q1", "single_choice", selected=["C"]),
    answer("imperfect", "q2", "multiple_choice", selected=["A"]),
    answer("imperfect", "q3", "true_false", value=False),
    answer("imperfect", "q4", "fill_in_blank", blanks={"b1": "Paris", "b2": "3.16"}),
    answer("imperfect", "q5", "matching", pairs={"L1": "R2", "L2": "R3"}),
]

"""Seams for models: callables applied to rows in batches, with retry and isolation of failures."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWERED = "run_id string, question_id string, status string, answer string, error string"
JUDGED = "run_id string, question_id string, judge string, status string, total double, rationale string, error string"


def solve(questions: DataFrame, solver: Callable[[dict], dict], problems: Callable[[dict, dict], list[str]] | None = None) -> DataFrame:
    """Answers of ``solver(question)`` as JSON; questions: run_id, question_id, question (JSON).

    An answer with problems is asked for once more, with the problems in the question; what fails then is
    a row of status 'error', not a failed task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                question, answer, wrong = json.loads(r.question), None, []
                for _ in range(2):
                    try:
                        answer = solver(question | ({"problems": wrong} if wrong else {}))
                        wrong = problems(question, answer) if problems else []
                    except Exception as e:
                        answer, wrong = None, [f"{type(e).__name__}: {e}"]
                    if not wrong:
                        break
                ok = answer is not None and not wrong
                out.append((r.run_id, r.question_id, "ok" if ok else "error", json.dumps(answer, ensure_ascii=False, sort_keys=True) if ok else None, "; ".join(wrong) or None))
            yield pd.DataFrame(out, columns=["run_id", "question_id", "status", "answer", "error"])

    return questions.select("run_id", "question_id", "question").mapInPandas(run, ANSWERED)


def judge(tasks: DataFrame, judges: DataFrame, ask: Callable[[str, dict], dict]) -> DataFrame:
    """Verdicts of every judge (judges.judge, any number) on every task (run_id, question_id, task JSON)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                try:
                    v = ask(r.judge, json.loads(r.task))
                    out.append((r.run_id, r.question_id, r.judge, "ok", float(v["total"]), v.get("rationale"), None))
                except Exception as e:
                    out.append((r.run_id, r.question_id, r.judge, "error", None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["run_id", "question_id", "judge", "status", "total", "rationale", "error"])

    every = tasks.select("run_id", "question_id", "task").crossJoin(judges.select("judge").distinct())
    return every.mapInPandas(run, JUDGED)


def matrix_status(answered: DataFrame, graded: DataFrame) -> DataFrame:
    """Status of each run: ok, solve_error if nothing was answered, grade_error if nothing was graded."""
    a = answered.groupBy("run_id").agg(F.count_if(F.col("status") == "ok").alias("answers"))
    g = graded.groupBy("run_id").agg(F.count_if(F.col("mode").isin("judge", "deterministic")).alias("grades"))
    return a.join(g, "run_id", "left").select(
        "run_id", F.when(F.col("answers") == 0, "solve_error").when(F.coalesce("grades", F.lit(0)) == 0, "grade_error").otherwise("ok").alias("status")
    )

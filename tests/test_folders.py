"""The bench source with pushed filters, and folders written whole."""

from __future__ import annotations

import json
import threading

import pytest
from pyspark.sql import functions as F

from scorewright.sources import folders, io


def bench(folder, subset, rows, reports=()):
    folder.mkdir(parents=True, exist_ok=True)
    document = {"exam_id": f"x-{subset}", "bundle_dir": f"/data/{subset}", "effort": "high", "rows": rows}
    (folder / "bench.json").write_text(json.dumps(document, indent=2))
    for name, text in reports:
        (folder / name).write_text(text)


def run(model, i=0, status="ok", report=None):
    return {"model": model, "slug": f"{model}-{i}", "run_index": i, "status": status, "awarded": 3, "covered_max": 4.5, "report_path": report or f"{model}-{i}-report.json"}


REPORT = json.dumps({"results": {"q2": {"mode": "judge", "max_points": 3, "awarded": 2.5, "detail": {"n": 1}}, "q1": {"mode": "deterministic", "max_points": 1, "awarded": 1}}})


@pytest.fixture
def tree(tmp_path):
    """Model a has its reports; those of b and of another subset cannot be read."""
    bench(tmp_path / "one", "physics", [run("a"), run("a", 1, "failed"), run("b")], [("a-0-report.json", REPORT), ("b-0-report.json", "{ broken")])
    bench(tmp_path / "deep" / "two", "law", [run("a"), run("c")], [("a-0-report.json", "{ broken"), ("c-0-report.json", REPORT)])
    return tmp_path


def test_filters_keep_reports_closed(spark, tree):
    runs = folders.read_runs(spark, str(tree))
    mine = runs.where("model = 'a' AND subset IN ('physics', 'music') AND run_index >= 0")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(mine._jdf.queryExecution(), "formatted")
    assert "EqualTo(model,a)" in plan and "In(subset" in plan
    rows = {r.run_index: r for r in mine.collect()}  # broken reports of others would stop the job
    assert set(rows) == {0, 1} and rows[1].results is None and rows[0].awarded == 3.0
    assert [tuple(q) for q in rows[0].results] == [("q1", "deterministic", 1.0, 1.0, None), ("q2", "judge", 3.0, 2.5, '{"n": 1}')]
    with pytest.raises(Exception, match="JSONDecodeError|Expecting property name"):
        runs.where("subset = 'law'").collect()
    assert folders.read_runs(spark, str(tree), reports=False).count() == 5
    assert runs.where("model = 'c' AND model = 'a'").count() == 0


def test_lost_reports_and_empty_folders(spark, tmp_path):
    with pytest.raises(Exception, match="no bench.json"):
        folders.read_runs(spark, str(tmp_path)).collect()
    bench(tmp_path / "x", "law", [run("a")])
    with pytest.raises(Exception, match="missing grade report"):
        folders.read_runs(spark, str(tmp_path)).collect()


def files_of(path):
    return {str(p.relative_to(path)): p.read_text() for p in path.rglob("*") if p.is_file() and not p.name.startswith(".")}


def rows_for(spark, version, entries=6, names=5):
    return spark.range(entries * names).repartition(4).select(
        F.concat(F.lit("results-e"), (F.col("id") % entries).cast("string")).alias("folder"),
        F.concat(F.lit("raw/f"), F.floor(F.col("id") / entries).cast("string")).alias("name"),
        F.encode(F.concat_ws(" ", F.lit(version), "id"), "UTF-8").alias("content"),
    )


def test_folders_are_replaced_whole(spark, tmp_path):
    folders.write_folders(rows_for(spark, "first", names=7), str(tmp_path))
    folders.write_folders(rows_for(spark, "second", entries=3, names=2), str(tmp_path))
    got = files_of(tmp_path)
    assert {k for k in got if k.startswith("results-e0/")} == {"results-e0/raw/f0", "results-e0/raw/f1"}  # old files went with the folder
    assert sum(v.startswith("first") for v in got.values()) == 3 * 7 and sum(v.startswith("second") for v in got.values()) == 6
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".")]


@pytest.mark.parametrize("bad", ["../out", "/abs"])
def test_failed_jobs_leave_what_was_there(spark, tmp_path, bad):
    folders.write_folders(rows_for(spark, "first"), str(tmp_path))
    before = files_of(tmp_path)
    last = rows_for(spark, "second").withColumn("name", F.when(F.col("name") == "raw/f4", F.lit(bad)).otherwise(F.col("name")))
    with pytest.raises(Exception, match="not a path inside"):
        folders.write_folders(last, str(tmp_path))
    assert files_of(tmp_path) == before
    twice = rows_for(spark, "third").unionByName(rows_for(spark, "fourth"))
    with pytest.raises(Exception, match="two rows for"):
        folders.write_folders(twice, str(tmp_path))
    assert {k: v for k, v in files_of(tmp_path).items() if not k.startswith(".staging")} == before


def test_two_writers_end_with_one_whole_state(spark, tmp_path):
    def job(version):
        # a thread of its own has no active session, by which Spark finds Python sources
        type(spark)._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)
        folders.write_folders(rows_for(spark, version, entries=2, names=20), str(tmp_path))

    jobs = [threading.Thread(target=job, args=(v,)) for v in ("left", "right")]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    got = files_of(tmp_path)
    for e in ("results-e0", "results-e1"):
        mine = [v.split(" ")[0] for k, v in got.items() if k.startswith(e)]
        assert len(mine) == 20 and len(set(mine)) == 1


def test_entries_with_raw_copies(spark, tree, tmp_path_factory):
    out = tmp_path_factory.mktemp("published")
    runs = folders.read_runs(spark, str(tree), reports=False).where("status = 'ok' AND model <> 'b'").withColumn("entry_id", F.concat(F.lit("e-"), "model"))
    entries = runs.select("entry_id", "model").distinct()
    papers = runs.select("entry_id", "subset", "awarded")
    index = papers.groupBy("entry_id").agg(F.sum("awarded").alias("percentage"))
    io.write_entry_files(entries, papers, index, str(out), io.raw_files(spark, runs, str(tree)))
    got = files_of(out)
    assert set(got) == {"results-index.json", "results-e-a/entry.json", "results-e-c/entry.json", "results-e-a/raw/physics/bench.json", "results-e-a/raw/physics/a-0-report.json",
                        "results-e-a/raw/law/bench.json", "results-e-a/raw/law/a-0-report.json", "results-e-c/raw/law/bench.json", "results-e-c/raw/law/c-0-report.json"}
    assert got["results-e-c/raw/law/c-0-report.json"] == REPORT
    assert json.loads(got["results-e-a/entry.json"]) == {"entry_id": "e-a", "model": "a", "papers": [{"subset": "law", "awarded": 3.0}, {"subset": "physics", "awarded": 3.0}]}

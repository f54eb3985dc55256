"""Python data sources: bench folders with pushed filters, and folders that are written whole or not at all.

``spark.read.format("benchruns").load(path)`` gives the runs below ``path``.  Filters on model, subset, exam, effort and status
reach the reader, so reports of other runs are never opened.
``rows.write.format("folders").mode("append").save(path)`` writes rows (folder, name, content) as files; each folder
is replaced as a whole when the job commits.

Files are opened by ``pyarrow.fs``, so the path's scheme must be one that it knows.  Replacing relies on a
rename that refuses a folder with files in it, as local and mounted file systems have.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

RESULTS = "array<struct<question_id: string, mode: string, max_points: double, awarded: double, detail: string>>"
RUN_FIELDS = {
    "model": "string", "slug": "string", "run_index": "int", "status": "string", "awarded": "double", "covered_max": "double", "covered_percentage": "double",
    "max_points": "double", "solve_secs": "double", "grade_secs": "double", "answers_path": "string", "report_path": "string",
}
RUNS = "folder string, subset string, exam_id string, title string, bundle_dir string, effort string, pos int, " + ", ".join(f"{k} {v}" for k, v in RUN_FIELDS.items()) + f", results {RESULTS}"
#: Columns whose filters the reader applies: those of a whole bench file, and those of its rows.
FILE_COLUMNS, ROW_COLUMNS = ("subset", "exam_id", "effort"), ("model", "status", "slug")


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Files(InputPartition):
    paths: list[str]


class RunsReader(DataSourceReader):
    def __init__(self, options: dict):
        self._path = options["path"]
        self._per = int(options.get("filesperpartition", 16))
        self._reports = str(options.get("reports", "true")).lower() == "true"
        self._only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in (*FILE_COLUMNS, *ROW_COLUMNS) and isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self._only[name] = self._only.get(name, some) & some
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = file_system(self._path)
        found = sorted(i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.base_name == "bench.json")
        if not found:
            raise ValueError(f"no bench.json below {self._path}")
        return [Files(found[i : i + self._per]) for i in range(0, len(found), self._per)]

    def _wanted(self, names: tuple[str, ...], values: dict) -> bool:
        return all(values[n] in self._only[n] for n in names if n in self._only)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = file_system(self._path)

        def document(path: str) -> dict:
            with system.open_input_file(path) as f:
                return json.loads(f.read())

        for path in partition.paths:
            bench, folder = document(path), path.rsplit("/", 1)[0]
            of = {k: bench.get(k) for k in ("exam_id", "title", "bundle_dir", "effort")}
            of["subset"] = (of["bundle_dir"] or "").rstrip("/").rsplit("/", 1)[-1]
            if not self._wanted(FILE_COLUMNS, of):
                continue
            for pos, row in enumerate(bench.get("rows") or ()):
                values = {k: row.get(k) for k in RUN_FIELDS}
                if not self._wanted(ROW_COLUMNS, values):
                    continue
                results = None
                if values["status"] == "ok" and self._reports:
                    if not values["report_path"]:
                        raise ValueError(f"{path}: run {values['slug']} has no report path")
                    try:
                        report = document(f"{folder}/{values['report_path']}")
                    except FileNotFoundError as e:
                        raise ValueError(f"missing grade report: {folder}/{values['report_path']}") from e
                    results = [
                        (q, r.get("mode"), _number(r.get("max_points")), _number(r.get("awarded")), None if r.get("detail") is None else json.dumps(r["detail"], ensure_ascii=False))
                        for q, r in sorted(report["results"].items())
                    ]
                typed = [_number(v) if RUN_FIELDS[k] == "double" else v for k, v in values.items()]
                yield (folder, of["subset"], of["exam_id"], of["title"], of["bundle_dir"], of["effort"], pos, *typed, results)


def _number(x) -> float | None:
    return None if x is None else float(x)


class BenchRuns(DataSource):
    """Rows of all bench.json files below a path with the questions of their reports; columns: ``RUNS``."""

    @classmethod
    def name(cls) -> str:
        return "benchruns"

    def schema(self) -> str:
        return RUNS

    def reader(self, schema) -> RunsReader:
        return RunsReader(dict(self.options))


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task wrote: where, and (folder, name) of each."""

    at: str
    files: list[tuple[str, str]]


class FolderWriter(DataSourceWriter):
    """Tasks write below a folder of their own attempt; the commit moves what finished tasks wrote.

    So nothing of a lost, repeated or failed task is seen, and of two writers of one folder the later one's files stay, all of them.
    """

    def __init__(self, path: str):
        self._path, self._stage = path.rstrip("/"), f".staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> Staged:
        from pyspark import TaskContext

        system, root = file_system(self._path)
        at, files = f"{root}/{self._stage}/attempt-{TaskContext.get().taskAttemptId()}", []
        for row in iterator:
            for part in (row.folder, row.name):
                if not part or part.startswith("/") or ".." in part.split("/"):
                    raise ValueError(f"not a path inside the target: {part!r}")
            file = f"{at}/{row.folder}/{row.name}"
            system.create_dir(file.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(file) as out:
                out.write(bytes(row.content))
            files.append((row.folder, row.name))
        return Staged(at, files)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = file_system(self._path)
        stage, seen = f"{root}/{self._stage}", set()
        for m in messages:
            for folder, name in m.files if m else ():
                if (folder, name) in seen:
                    raise ValueError(f"two rows for {folder}/{name}")
                seen.add((folder, name))
        for m in messages:
            for folder, name in m.files if m else ():
                to = f"{stage}/whole/{folder}/{name}"
                system.create_dir(to.rsplit("/", 1)[0], recursive=True)
                system.move(f"{m.at}/{folder}/{name}", to)
        for i, folder in enumerate(sorted({f for f, _ in seen})):
            self._replace(system, f"{stage}/whole/{folder}", f"{root}/{folder}", f"{stage}/old-{i}")
        self._clear(system, stage)

    def _replace(self, system, new: str, target: str, old: str, tries: int = 100) -> None:
        """Two renames: the old folder goes, the new one comes; between them there is none.  Another writer may come between, then again."""
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        for i in range(tries):
            if system.get_file_info(target).type.name != "NotFound":
                try:
                    system.move(target, f"{old}-{i}")
                except FileNotFoundError:
                    pass
            try:
                system.move(new, target)
                return
            except OSError:
                if i + 1 == tries:
                    raise

    def _clear(self, system, stage: str) -> None:
        if system.get_file_info(stage).type.name != "NotFound":
            system.delete_dir(stage)

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = file_system(self._path)
        self._clear(system, f"{root}/{self._stage}")


class Folders(DataSource):
    """Sink of rows (folder, name, content): files, each folder replaced whole."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return "folder string, name string, content binary"

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        if overwrite:
            raise ValueError("folders are replaced one by one: use mode append")
        return FolderWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make both sources known to a session and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BenchRuns)
    spark.dataSource.register(Folders)


def read_runs(spark: SparkSession, path: str, reports: bool = True) -> DataFrame:
    """Runs below ``path``; without ``reports`` none is opened and results are null."""
    register(spark)
    return spark.read.format("benchruns").option("reports", str(reports).lower()).load(path)


def write_folders(files: DataFrame, path: str) -> None:
    """Write rows (folder, name, content) below ``path``; a folder that is there already is replaced."""
    register(files.sparkSession)
    files.select("folder", "name", "content").write.format("folders").mode("append").save(path)

"""Small helpers the operators share: bounded Arrow slices and shared-folder tables."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a vectorised operator works on at once.
SLICE_BYTES = 4 << 20


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES, max_rows: int = 4096
) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``max_bytes`` (one row may exceed it)."""
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        lo, held = 0, 0
        for i, n in enumerate(lens):
            if i > lo and (held + n > max_bytes or i - lo >= max_rows):
                yield batch.slice(lo, i - lo)
                lo, held = i, 0
            held += n
        if lo < batch.num_rows:
            yield batch.slice(lo)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; on a cluster, whose executors
    would not see such a folder, it must be set.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not at:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        at = tempfile.mkdtemp(prefix="scorewright-")
        sc.setCheckpointDir(at)
    return at if "://" in at or at.startswith("file:") else f"file://{at}"


#: Paths made inside each open ``scratch``.
_open: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes with the ``scratch`` around it, else when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    if _open:
        _open[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, what was written inside it: for steps whose result is written before."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: With this, Spark deletes an execution's shuffle files at its end; else they stay until the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Writes inside it delete their shuffle files when they end; the session's setting is as before afterwards."""
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, was)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder, or at ``path``, and read it again; its shuffles are dropped."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def text_tag(column: str = "text"):
    """A digest of a whole text, null as the empty text; with doc_id it tells rows apart."""
    return F.unhex(F.sha2(empty_text(column), 256))


def take_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``keep`` names, with all their columns.

    ``keep``: doc_id, tag (``text_tag``), n.  Of rows with the same doc_id and text one is taken
    where n is over 1, in which case partial aggregation leaves one in each task.
    """
    names = docs.columns
    tagged = docs.withColumns({"_doc_id": F.col("doc_id").cast("long"), "_tag": text_tag()})
    met = F.col("_doc_id").eqNullSafe(F.col("doc_id_kept")) & (F.col("_tag") == F.col("tag_kept"))
    keep = keep.select(F.col("doc_id").alias("doc_id_kept"), F.col("tag").alias("tag_kept"), "n").distinct()
    out = tagged.join(keep.where("n = 1"), met, "left_semi").select(*names)
    repeated = keep.where("n > 1")
    if repeated.isEmpty():
        return out
    same = tagged.join(repeated, met, "left_semi").groupBy("_doc_id", "_tag").agg(F.first(F.struct(*names)).alias("_row"))
    return out.unionByName(same.select("_row.*"))

"""Command line: python -m scorewright COMMAND FOLDER...

validate FOLDER                     bundle folders: problems as lines, exit code 1 if there are any
grade BUNDLES SHEETS                answer sheets under the bundles' rules: totals of each sheet; --text-only for takers without images
runs FOLDER                         bench folders: summaries of each model
board FOLDER                        bench folders: entries in board order
publish FOLDER... --bundles --out   bench folders to entry files and index below --out (no network)
reindex FOLDER                      the index anew from the entry files below FOLDER
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.functions.text import default_entry_id
from scorewright.operators import grading, results, structure
from scorewright.session import session
from scorewright.sources import io


def board(spark, path: str) -> DataFrame:
    runs = io.read_runs(spark, path).withColumn("entry_id", default_entry_id(F.col("model"), F.col("effort")))
    ok = runs.where("status = 'ok'").groupBy("entry_id", "exam_id").agg(F.avg("awarded").alias("awarded"), F.avg("covered_max").alias("covered_max"))
    per = ok.groupBy("entry_id").agg(F.count("*").alias("papers"), F.round(F.sum("awarded"), 6).alias("awarded"), F.round(F.sum("covered_max"), 6).alias("covered_max"))
    pct = F.round(F.when(F.col("covered_max") > 0, F.try_divide(100.0 * F.col("awarded"), F.col("covered_max"))), 4)
    return per.withColumn("percentage", pct).orderBy(results.board_key(), "entry_id")


def validate(spark, path: str, most: int) -> int:
    problems = io.check_bundles(spark, path).cache()
    n = problems.count()
    for r in problems.orderBy("folder", "check", "subject").limit(most).collect():
        print(f"{r['folder'].rsplit('/', 1)[-1]}: {r['check']}: {r['subject']}")
    if n > most:
        print(f"and {n - most} more")
    return int(n > 0)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scorewright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["validate", "grade", "runs", "board", "publish", "reindex"])
    parser.add_argument("folders", nargs="+")
    parser.add_argument("--most", type=int, default=50, help="rows to print")
    parser.add_argument("--text-only", action="store_true", help="grade: takers see no images")
    parser.add_argument("--bundles", help="publish: where the bundles lie")
    parser.add_argument("--out", help="publish: where to write; grade: Parquet of all results")
    parser.add_argument("--model", help="publish: only runs of this model")
    parser.add_argument("--entry", help="publish: name of the entry")
    parser.add_argument("--mode-fallback", action="store_true", help="publish: subsets without a bundle are split by mode")
    args = parser.parse_args(argv)
    if args.command == "grade" and len(args.folders) != 2:
        parser.error("grade takes the bundles' and the sheets' folder")
    if args.command == "publish" and not (args.bundles and args.out):
        parser.error("publish needs --bundles and --out")
    if args.command not in ("grade", "publish") and len(args.folders) != 1:
        parser.error(f"{args.command} takes one folder")
    spark, first = session(), args.folders[0]
    if args.command == "validate":
        return validate(spark, first, args.most)
    if args.command == "grade":
        graded = io.grade_folder(spark, first, args.folders[1], capabilities=structure.capabilities(True) if args.text_only else None)
        if args.out:
            graded.write.parquet(args.out)
            graded = spark.read.parquet(args.out)
        found = grading.report_totals(graded).orderBy("run_id")
    elif args.command == "publish":
        found = io.publish(spark, args.folders, args.bundles, args.out, args.model, args.entry, args.mode_fallback).select("entry_id", "papers", "awarded", "covered_max", "percentage")
    elif args.command == "reindex":
        found = io.reindex(spark, first).orderBy(results.board_key(), "entry_id").select("entry_id", "papers", "awarded", "covered_max", "percentage")
    else:
        found = results.summarize_models(io.read_runs(spark, first)) if args.command == "runs" else board(spark, first)
    found.show(args.most, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())

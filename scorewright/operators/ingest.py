"""Extraction post-processing: page windows, merging, numbering gaps, keys, figure geometry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.functions.text import covered_numbers, leading_int, normalize_number, run_label
from scorewright.session import written

PAGES, OVERLAP = 4, 1


def page_chunks(pages: DataFrame, doc: str = "doc", order: str = "page_index", size: int = PAGES, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``size`` pages that share ``overlap`` pages; the last window ends with the last page."""
    step, w = size - overlap, Window.partitionBy(doc)
    i = F.row_number().over(w.orderBy(order)) - 1
    at = pages.withColumn("_i", i).withColumn("_n", F.count("*").over(w))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step)).cast("int")
    low = F.greatest(F.lit(0), F.floor((F.col("_i") - size) / step).cast("int") + 1)
    high = F.least(last, F.floor(F.col("_i") / step).cast("int"))
    return at.withColumn("chunk", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")))).drop("_i", "_n")


def merge_first(extracted: DataFrame, by: list[str], number: str = "number") -> DataFrame:
    """The first extraction of each printed number, in order of chunk and position."""
    key = normalize_number(F.col(number))
    nth = F.row_number().over(Window.partitionBy(*by, "_key").orderBy("chunk", "pos"))
    return extracted.withColumn("_key", key).withColumn("_nth", nth).where("_nth = 1").drop("_key", "_nth")


def numbering(questions: DataFrame, by: list[str], number: str = "number", pos: str = "pos") -> DataFrame:
    """Per document: distinct leading numbers, whether they rise strictly, and the range they cover."""
    lead = questions.select(*by, pos, leading_int(F.col(number)).alias("lead"), covered_numbers(F.col(number)).alias("covered"))
    back = F.lag("lead").over(Window.partitionBy(*by).orderBy(pos))
    falls = lead.where("lead IS NOT NULL").withColumn("fall", F.coalesce(back >= F.col("lead"), F.lit(False)))
    rising = falls.groupBy(*by).agg(F.count_distinct("lead").alias("leads"), (~F.bool_or("fall")).alias("rising"))
    spans = lead.groupBy(*by).agg(F.min(F.array_min("covered")).alias("low"), F.max(F.array_max("covered")).alias("high"))
    return rising.join(spans, by)


def find_gaps(questions: DataFrame, by: list[str], number: str = "number", pos: str = "pos", expected: str | None = None) -> DataFrame:
    """Runs (first, last) of missing numbers of documents whose numbering rises; ``expected`` names a column
    of the last number, used if it is at most 50 past the largest seen.  Gaps lie between neighbours,
    so a misread number costs no more than a row."""
    span = numbering(questions, by, number, pos).where("rising AND leads >= 2").select(*by, "high")
    have = questions.select(*by, F.explode(covered_numbers(F.col(number))).alias("n")).distinct().join(span, by, "left_semi")
    nxt = F.lead("n").over(Window.partitionBy(*by).orderBy("n"))
    out = have.withColumn("_next", nxt).where("_next > n + 1").select(*by, (F.col("n") + 1).alias("first"), (F.col("_next") - 1).alias("last"))
    if not expected:
        return out
    want = questions.groupBy(*by).agg(F.max(expected).alias("last"))
    tail = span.join(want, by).where((F.col("high") < F.col("last")) & (F.col("last") <= F.col("high") + 50))
    return out.unionByName(tail.select(*by, (F.col("high") + 1).alias("first"), "last"))


def gap_chunks(gaps: DataFrame, chunk_numbers: DataFrame, by: list[str]) -> DataFrame:
    """Chunks that hold the number before or after a gap.  chunk_numbers: by, chunk, n."""
    sides = gaps.select(*by, "first", "last", F.explode(F.array(F.col("first") - 1, F.col("last") + 1)).alias("n"))
    return sides.join(chunk_numbers, [*by, "n"]).select(*by, "first", "last", "chunk").distinct()


def repair_allowed(gaps: DataFrame, questions: DataFrame, by: list[str]) -> DataFrame:
    """Documents few enough of whose numbers are missing: at most 5 runs and max(10, a fifth) numbers."""
    n = questions.groupBy(*by).agg(F.count("*").alias("n"))
    per = gaps.groupBy(*by).agg(F.count("*").alias("runs"), F.sum(F.col("last") - F.col("first") + 1).alias("missing"))
    return per.join(n, by).where((F.col("runs") <= 5) & (F.col("missing") <= F.greatest(F.lit(10.0), F.col("n") / 5)))


def insert_recovered(merged: DataFrame, recovered: DataFrame, by: list[str], number: str = "number", pos: str = "pos") -> DataFrame:
    """Both, in order: a recovered question follows the last one with a smaller number; unnumbered ones stay with their predecessor."""
    both = merged.withColumn("recovered", F.lit(False)).unionByName(recovered.withColumn("recovered", F.lit(True)), allowMissingColumns=True)
    both = both.withColumn("_lead", leading_int(F.col(number)))
    order = Window.partitionBy(*by, "recovered").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_key", F.when(F.col("recovered"), F.col("_lead")).otherwise(F.coalesce(F.max("_lead").over(order), F.lit(-1))))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_key", "recovered", pos))
    return near.withColumn("place", place).drop("_lead", "_key")


def merge_keys(entries: DataFrame, by: list[str], fields: list[str], number: str = "question_number", pos: str = "pos") -> DataFrame:
    """Key entries of one number, the first non-null value of every field in order of ``pos``."""
    key = entries.withColumn("_key", normalize_number(F.col(number)))
    first = [F.min_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(pos))).alias(f) for f in fields]
    return key.groupBy(*by, F.col("_key").alias("key")).agg(*first)


def match_keys(leaves: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Leaves with the key of the first of their ``candidates`` (array<string>) that has one."""
    tries = leaves.select(*by, "question_id", F.posexplode(F.transform("candidates", normalize_number)).alias("_try", "key"))
    hit = tries.join(keys, [*by, "key"])
    best = hit.groupBy(*by, "question_id").agg(F.min_by("key", "_try").alias("key"))
    return leaves.join(best, [*by, "question_id"], "left").join(keys, [*by, "key"], "left")


def match_blanks(blanks: DataFrame, answers: DataFrame, by: list[str]) -> DataFrame:
    """Accepted values of each blank by id or label, else by position if both counts agree.

    blanks: by, pos, blank_id, label; answers: by, pos, key, values.
    """
    norm = lambda c: F.lower(F.trim(c))
    n_b = blanks.groupBy(*by).agg(F.count("*").alias("_nb"))
    n_a = answers.groupBy(*by).agg(F.count("*").alias("_na"))
    b = blanks.join(n_b, by).join(n_a, by, "left").alias("b")
    on = lambda left, right: F.expr(" AND ".join(f"{left}.{c} = {right}.{c}" for c in by))
    named = answers.groupBy(*by, norm(F.col("key")).alias("_k")).agg(F.min_by("values", "pos").alias("values"))
    x, y, p = named.alias("x"), named.alias("y"), answers.alias("p")
    out = (
        b.join(x, on("b", "x") & (norm(F.col("b.blank_id")) == F.col("x._k")), "left")
        .join(y, on("b", "y") & (norm(F.col("b.label")) == F.col("y._k")), "left")
        .join(p, on("b", "p") & (F.col("b.pos") == F.col("p.pos")) & (F.col("b._nb") == F.col("b._na")), "left")
    )
    return out.select(*(F.col(f"b.{c}") for c in by), "b.blank_id", F.coalesce("x.values", "y.values", "p.values").alias("values"))


# Question types that a bad extraction turns into another, and shares of a page.
MIN_AREA, MAX_AREA, PADDING = 0.005, 0.95, 0.02


def figure_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """struct<left, top, right, bottom, whole>: pixel box of a figure, clamped, ordered and padded; tiny and huge boxes give the page."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    a, c = F.least(unit(x0), unit(x1)), F.greatest(unit(x0), unit(x1))
    b, d = F.least(unit(y0), unit(y1)), F.greatest(unit(y0), unit(y1))
    area = (c - a) * (d - b)
    whole = (area < MIN_AREA) | (area > MAX_AREA)
    px = lambda v, size: F.when(whole, 0).otherwise(F.floor(unit(v - PADDING) * size)).cast("int")
    to = lambda v, size: F.when(whole, size).otherwise(F.ceil(unit(v + PADDING) * size)).cast("int")
    return F.struct(px(a, width).alias("left"), px(b, height).alias("top"), to(c, width).alias("right"), to(d, height).alias("bottom"), whole.alias("whole"))


def coerced_type(kind: Column, options: Column, pairs: Column, children: Column) -> Column:
    """A choice without two options, a matching without pairs or a composite without children is a short answer."""
    bad = (kind.isin("single_choice", "multiple_choice") & (options < 2)) | ((kind == "matching") & (pairs < 1)) | ((kind == "composite") & (children < 1))
    return F.when(bad, "short_answer").otherwise(kind)


def default_points(points: Column) -> Column:
    return F.when(points > 0, points).otherwise(1.0)


def route_pages(pages: DataFrame, roles: DataFrame, by: str = "doc") -> DataFrame:
    """Pages with their role, 'questions' if unclassified; a document without question pages has all of them."""
    got = pages.join(roles, [by, "page_index"], "left").withColumn("role", F.coalesce("role", F.lit("questions")))
    some = F.bool_or(F.col("role") == "questions").over(Window.partitionBy(by))
    return got.withColumn("is_question_page", (F.col("role") == "questions") | ~some)


def synthesised_kind(question_type: Column, has_options: Column, has_bool: Column, has_blanks: Column, has_pairs: Column, has_ratios: Column) -> Column:
    """The rule that a key allows for a question; anything else goes to judges."""
    choice = question_type.isin("single_choice", "multiple_choice") & has_options
    return (
        F.when(choice & (question_type == "multiple_choice") & has_ratios, "per_option")
        .when(choice, "choice")
        .when((question_type == "true_false") & has_bool, "true_false")
        .when((question_type == "fill_in_blank") & has_blanks, "fill_in_blank")
        .when((question_type == "matching") & has_pairs, "matching")
        .otherwise("judge")
    )


def question_ids(questions: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Ids q1, q2, ... of top questions in order, and q1.<suffix> of their children (parent_pos, suffix)."""
    tops = questions.where("parent_pos IS NULL")
    named = tops.withColumn("question_id", F.concat(F.lit("q"), F.row_number().over(Window.partitionBy(*by).orderBy(pos)).cast("string")))
    parents = named.select(*by, F.col(pos).alias("parent_pos"), F.col("question_id").alias("_parent"))
    kids = questions.where("parent_pos IS NOT NULL").join(parents, [*by, "parent_pos"])
    nth = F.row_number().over(Window.partitionBy(*by, "parent_pos").orderBy(pos)).cast("string")
    kids = kids.withColumn("question_id", F.concat_ws(".", "_parent", F.coalesce("suffix", nth))).drop("_parent")
    return named.unionByName(kids)


def index_lines(questions: DataFrame) -> DataFrame:
    """A printed line for each question: number (id without one), type, points and the ids that its answer names.

    questions: question_id, number, type, points, options, and if they have them blanks (array<struct<id, label>>), left, right (arrays of ids).
    """
    has = lambda c: c in questions.columns
    listed = lambda name, ids: F.when(F.size(ids) > 0, F.concat(F.lit(f" | {name}: "), F.array_join(ids, ",")))
    label = lambda b: F.when(F.coalesce(b["label"], F.lit("")) != "", F.concat(F.lit("("), b["label"], F.lit(")"))).otherwise(F.lit(""))
    parts = [listed("options", F.col("options"))]
    if has("blanks"):
        parts.append(listed("blanks", F.transform("blanks", lambda b: F.concat(b["id"], label(b)))))
    if has("left") and has("right"):
        parts.append(F.concat(listed("left", F.col("left")), listed("right", F.col("right"))))
    points = F.regexp_replace(F.format_string("%.6f", F.col("points").cast("double")), r"\.?0+$", "")
    line = F.concat(F.lit("- number: '"), F.coalesce("number", "question_id"), F.lit("' | type: "), "type", F.lit(" | points: "), points, F.coalesce(*parts, F.lit("")))
    return questions.withColumn("line", line)


def valid_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Pairs (by, l, r) of a matching key whose ends both exist; left: by, id; right: by, id."""
    out = pairs.join(left.select(*by, F.col("id").alias("l")).distinct(), [*by, "l"], "left_semi")
    return out.join(right.select(*by, F.col("id").alias("r")).distinct(), [*by, "r"], "left_semi")


def dropped_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """How many pairs of each question name an end that does not exist."""
    kept = valid_pairs(pairs, left, right, by).groupBy(*by).agg(F.count("*").alias("kept"))
    return pairs.groupBy(*by).agg(F.count("*").alias("n")).join(kept, by, "left").select(*by, (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped")).where("dropped > 0")


def answer_values(entries: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Maps from lists of keys and values; of a repeated key the last value counts."""
    last = entries.groupBy(*by, "key").agg(F.max_by("value", pos).alias("value"))
    return last.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("values"))


def repaired(questions: DataFrame, recovered: DataFrame, by: list[str], number: str = "number", pos: str = "pos", expected: str | None = None, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Questions with those recovered for their gaps put in place, and the gaps that stay.

    Only documents that ``repair_allowed`` lets through; of what a second pass found, only questions that
    cover a missing number and whose printed number is not there already, each once.  ``allowed``: gaps that may be
    repaired, if they are known.
    """
    if allowed is None:
        gaps = find_gaps(questions, by, number, pos, expected)
        allowed = gaps.join(repair_allowed(gaps, questions, by).select(*by), by, "left_semi")
    key = normalize_number(F.col(number))
    seen = questions.select(*by, key.alias("_key")).distinct()
    fresh = recovered.withColumn("_key", key).join(seen, [*by, "_key"], "left_anti")
    fresh = fresh.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_key").orderBy(pos))).where("_nth = 1").drop("_nth")
    numbers = fresh.select(*by, "_key", F.explode(covered_numbers(F.col(number))).alias("n"))
    on = [numbers[c] == allowed[c] for c in by] + [numbers["n"].between(allowed["first"], allowed["last"])]
    useful = numbers.join(allowed, on, "left_semi").select(*by, "_key").distinct()
    add = fresh.join(useful, [*by, "_key"], "left_semi").drop("_key")
    extra = [c for c in questions.columns if c not in add.columns]
    add = add.withColumns({c: F.lit(None).cast(questions.schema[c].dataType) for c in extra})
    out = insert_recovered(questions, add, by, number, pos)
    left = find_gaps(out.drop(pos).withColumnRenamed("place", pos), by, number, pos, expected)
    return out, left


def gap_pages(gaps: DataFrame, chunk_numbers: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """Pages on which each gap's questions must be: by, first, last, pages (rising).

    Those of every chunk that holds a number next to the gap; behind the last number found, all from its chunk on;
    all pages if no chunk holds either.  chunk_numbers: by, chunk, n; pages: by, page_index, chunk.
    """
    gap = [*by, "first", "last"]
    side = lambda n, name: gaps.withColumn("n", n).join(chunk_numbers, [*by, "n"]).select(*gap, "chunk", F.lit(name).alias("side"))
    near = side(F.col("first") - 1, "below").unionByName(side(F.col("last") + 1, "above")).distinct()
    own = near.join(pages, [*by, "chunk"]).select(*gap, "side", "page_index")
    met = own.groupBy(*gap).agg(F.bool_or(F.col("side") == "below").alias("_below"), F.bool_or(F.col("side") == "above").alias("_above"), F.min("page_index").alias("_from"))
    open_ = gaps.select(*gap).join(met, gap, "left").where("_below IS NULL OR (_below AND NOT _above)")
    rest = open_.join(pages.select(*by, "page_index").distinct(), by).where("_from IS NULL OR page_index >= _from").select(*gap, "page_index")
    every = own.select(*gap, "page_index").unionByName(rest).distinct()
    return gaps.select(*gap).join(every.groupBy(*gap).agg(F.sort_array(F.collect_list("page_index")).alias("pages")), gap, "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<long>")))


def ask_for_gaps(requests: DataFrame, extract: Callable[[dict], list[str]], by: list[str]) -> DataFrame:
    """by, number, pos of what ``extract`` finds for each gap; a request has by, first, last, label and pages.

    ``extract`` is a seam: printed numbers of the questions it finds, in order.  A call that fails finds nothing.
    """
    import pandas as pd

    schema = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in by) + ", number string, pos long"
    columns = [*by, "first", "last", "label", "pages"]

    def run(frames: Iterator) -> Iterator:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                request = dict(zip(columns, row, strict=True)) | {"pages": [int(p) for p in row[-1]]}
                try:
                    found = extract(request)
                except Exception:  # a seam's failure is no failed task: the gap stays
                    found = []
                out += [(*row[: len(by)], str(n), int(request["first"]) * 1000 + i) for i, n in enumerate(found)]
            yield pd.DataFrame(out, columns=[*by, "number", "pos"])

    return requests.withColumn("label", run_label(F.col("first"), F.col("last"))).select(*columns).mapInPandas(run, schema)


def repair_gaps(
    questions: DataFrame, chunk_numbers: DataFrame, pages: DataFrame, extract: Callable[[dict], list[str]], by: list[str], expected: str | None = None, rounds: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Questions with those recovered for their gaps in place (column ``round``: 0 if extracted at first), and the gaps that stay.

    A round finds gaps, asks for the pages of these alone and puts in place what fits (``repaired``).  It is the last if
    nothing fitted, no gap is left that may be repaired, or ``rounds`` are over.  Each round is written, so plans do not grow.
    questions: by, number, pos; further columns are kept, null for recovered ones.
    """
    now = written(questions.withColumn("round", F.lit(0)), "questions")
    for i in range(1, rounds + 1):
        gaps = find_gaps(now, by, expected=expected)
        todo = written(gaps.join(repair_allowed(gaps, now, by).select(*by), by, "left_semi"), "gaps")
        if todo.isEmpty():
            break
        found = written(ask_for_gaps(gap_pages(todo, chunk_numbers, pages, by), extract, by), "found").withColumn("round", F.lit(i))
        out, _ = repaired(now, found, by, expected=expected, allowed=todo)
        now = written(out.drop("pos", "recovered").withColumnRenamed("place", "pos").select(*questions.columns, "round"), "questions")
        if now.where(F.col("round") == i).isEmpty():
            break
    return now, find_gaps(now, by, expected=expected)


def gap_warnings(gaps: DataFrame, questions: DataFrame, by: list[str]) -> DataFrame:
    """by, warning: a line for each gap that stays, or one for a document with too many to repair."""
    allowed = repair_allowed(gaps, questions, by).select(*by)
    label = run_label(F.col("first"), F.col("last"))
    still = gaps.join(allowed, by, "left_semi").select(*by, F.concat(F.lit("question(s) "), label, F.lit(" still missing after re-extraction")).alias("warning"))
    many = gaps.join(allowed, by, "left_anti").groupBy(*by).agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"), F.count("*").alias("runs"))
    text = F.concat(F.col("n").cast("string"), F.lit(" question number(s) missing across "), F.col("runs").cast("string"), F.lit(" run(s); too many to repair"))
    return still.unionByName(many.select(*by, text.alias("warning")))

"""What takers and judges are shown: ordered parts, texts and figures, sized before a model sees them.

A part is struct<text, asset>, one of which is null.  Parts are built from a question's row alone; only bytes of
figures come by a join (``with_bytes``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.render import answer_text
from scorewright.functions.text import markdown_table
from scorewright.operators.structure import BLOCK, ITEMS, is_unsafe, leaves

PART = "struct<text: string, asset: string>"
PARTS = f"array<{PART}>"

#: What the answer to a question of each type has to be.
NOTES = {
    "single_choice": "Choose one option by its id.",
    "multiple_choice": "Choose every right option by its id.",
    "true_false": "Answer true or false.",
    "matching": "Give each left item the id of one right item.",
    "drawing": "Describe the drawing so exactly that it could be redone: shapes, labels, axes and where they stand.",
}
OPEN_NOTE = "Answer in Markdown with formulas in LaTeX, and show the steps if the task asks for them."


def say(text: Column) -> Column:
    """Parts of one text; none if it is null."""
    one = F.array(F.struct(text.cast("string").alias("text"), F.lit(None).cast("string").alias("asset"))).cast(PARTS)
    return F.when(text.isNotNull(), one).otherwise(F.array().cast(PARTS))


def block_parts(blocks: Column) -> Column:
    """Parts of content blocks: a figure is its label, numbered among these blocks, and itself."""
    blocks = F.coalesce(blocks, F.array().cast(f"array<{BLOCK}>"))

    def one(b: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(blocks, F.lit(1), i + 1), lambda x: x["type"] == "image")).cast("string")
        caption = F.when(F.coalesce(b["caption"], F.lit("")) != "", F.concat(F.lit(" ("), b["caption"], F.lit(")"))).otherwise(F.lit(""))
        label = F.concat(F.lit("[Figure "), nth, F.lit(": "), F.coalesce(b["alt"], F.lit("")), F.lit("]"), caption)
        figure = F.array(F.struct(F.lit(None).cast("string").alias("text"), b["asset"].alias("asset"))).cast(PARTS)
        table = markdown_table(F.coalesce(b["header"], F.array().cast("array<string>")), F.coalesce(b["rows"], F.array().cast("array<array<string>>")))
        return F.when(b["type"] == "image", F.concat(say(label), figure)).when(b["type"] == "table", say(table)).otherwise(say(F.coalesce(b["markdown"], F.lit(""))))

    return F.flatten(F.transform(blocks, one))


def _item_parts(head: str, items: Column, left: str, right: str) -> Column:
    """A heading and, for each item, its id and content; none without items."""
    each = F.transform(F.coalesce(items, F.array().cast(ITEMS)), lambda x: F.concat(say(F.concat(F.lit(left), x["id"], F.lit(right))), block_parts(x["content"])))
    return F.when(F.size(items) > 0, F.concat(say(F.lit(head)), F.flatten(each))).otherwise(F.array().cast(PARTS))


def plain_number(x: Column) -> Column:
    """A number without zeros behind the point."""
    return F.regexp_replace(F.format_string("%.6f", x.cast("double")), r"\.?0+$", "")


def answer_note() -> Column:
    """What the answer has to be, by the question's type."""
    ids = F.array_join(F.transform("blanks", lambda b: F.concat_ws(" ", b["id"], F.nullif(b["label"], F.lit("")))), ", ")
    out = F.when(F.col("type") == "fill_in_blank", F.concat(F.lit("Fill every blank. Blanks: "), ids, F.lit(".")))
    for kind, note in NOTES.items():
        out = out.when(F.col("type") == kind, note)
    return out.otherwise(OPEN_NOTE)


def question_header() -> Column:
    return F.concat(F.lit("### Question "), F.coalesce("number", "node_id"), F.lit(" ("), plain_number(F.col("points")), F.lit(" points)"))


def question_parts() -> Column:
    """Parts of a leaf of ``structure.flatten_exam``: exam, section, ancestors from the outside in, question, what it offers, what is asked."""
    subject = F.when(F.coalesce("exam_subject", F.lit("")) != "", F.concat(F.lit(" ("), "exam_subject", F.lit(")"))).otherwise(F.lit(""))
    context = F.transform("above", lambda b, i: F.concat(say(F.concat(F.lit("### Context for question "), F.get("above_labels", i))), block_parts(b)))
    return F.concat(
        say(F.concat(F.lit("# "), "exam_title", subject)),
        say(F.concat(F.lit("## "), F.nullif("section_title", F.lit("")))),
        block_parts(F.col("instructions")),
        F.flatten(context),
        say(question_header()),
        block_parts(F.col("prompt")),
        _item_parts("Options:", F.col("options"), "(", ")"),
        _item_parts("Left items:", F.col("matching.left"), "[", "]"),
        _item_parts("Right items:", F.col("matching.right"), "[", "]"),
        say(answer_note()),
    )


def prompts(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """exam_id, question_id, place, parts of every leaf."""
    return leaves(nodes).select(*keep, "exam_id", F.col("node_id").alias("question_id"), "place", question_parts().alias("parts"))


def within(prompts: DataFrame, needs: DataFrame, takers: DataFrame) -> DataFrame:
    """Prompts of each taker (run_id, exam_id, capabilities; null: all) with ``missing``, the modalities it cannot take in.

    A row with missing modalities is not to be asked.  needs: exam_id, question_id, modalities.
    """
    met = takers.join(prompts, "exam_id").join(needs.select("exam_id", "question_id", "modalities"), ["exam_id", "question_id"], "left")
    lack = F.when(F.col("capabilities").isNotNull(), F.array_sort(F.array_except("modalities", "capabilities")))
    return met.withColumn("missing", F.coalesce(lack, F.array().cast("array<string>"))).drop("modalities", "capabilities")


def rubric_lines(rubric: Column) -> Column:
    """A rubric's criteria with their levels from high to low."""
    falling = lambda a: F.array_sort(a, lambda x, y: F.when(x["points"] > y["points"], -1).when(x["points"] < y["points"], 1).otherwise(0))
    level = lambda v: F.concat(F.lit("    - "), plain_number(v["points"]), F.lit(" points: "), v["descriptor"])
    one = lambda c: F.concat(F.lit("- Criterion '"), c["id"], F.lit("': "), c["description"], F.lit("\n"), F.array_join(F.transform(falling(c["levels"]), level), "\n"))
    return F.concat(F.lit("Rubric (give each criterion the points of one of its levels):\n"), F.array_join(F.transform(rubric, one), "\n"))


def judge_tasks(nodes: DataFrame, rules: DataFrame, answers: DataFrame) -> DataFrame:
    """run_id, exam_id, question_id, parts of every answer that a judge marks.

    The question as takers see it (without figures where include_images is false), the most points, instructions, rubric, reference and its
    figures, then the answer.  rules: exam_id, question_id, kind, max_points and if there judge_instructions, rubric, reference_answer,
    reference_assets, include_images; answers: run_id, exam_id, question_id, type, selected, value, blanks, pairs, text.
    """
    has = lambda c, kind: F.col(f"r.{c}") if c in rules.columns else F.lit(None).cast(kind)
    q = prompts(nodes).alias("q")
    r, a = rules.where("kind = 'judge'").alias("r"), answers.alias("a")
    met = a.join(r, ["exam_id", "question_id"]).join(q, ["exam_id", "question_id"])
    text = lambda head, c: say(F.concat(F.lit(head), F.nullif(c, F.lit(""))))
    asked = F.when(F.coalesce(has("include_images", "boolean"), F.lit(True)), F.col("q.parts")).otherwise(F.filter("q.parts", lambda p: p["asset"].isNull()))
    none = F.array().cast(PARTS)
    figures = F.coalesce(has("reference_assets", "array<string>"), F.array().cast("array<string>"))
    shown = F.flatten(F.transform(figures, lambda f: F.concat(say(F.lit("[Reference figure]")), F.array(F.struct(F.lit(None).cast("string").alias("text"), f.alias("asset"))).cast(PARTS))))
    rubric = F.when(F.size("r.rubric") > 0, say(rubric_lines(F.col("r.rubric")))).otherwise(none) if "rubric" in rules.columns else none
    given = answer_text(F.col("a.type"), F.col("a.selected"), F.col("a.value"), F.col("a.blanks"), F.col("a.pairs"), F.col("a.text"))
    parts = F.concat(
        asked,
        say(F.concat(F.lit("Most points for this question: "), plain_number(F.col("r.max_points")), F.lit("."))),
        text("Instructions for marking:\n", has("judge_instructions", "string")),
        rubric,
        text("Reference answer:\n", has("reference_answer", "string")),
        shown,
        say(F.lit("--- Answer ---")),
        say(given),
    )
    return met.select("a.run_id", "exam_id", "question_id", parts.alias("parts"))


def with_bytes(rows: DataFrame, files: DataFrame, keys: list[str], at: str = "folder") -> DataFrame:
    """``rows`` with figures' bytes: parts become array<struct<text, image>>, and ``bytes`` is the size of all texts and figures.

    A figure without a file, or with a path out of its bundle, leaves its label only.  files: path, content; a figure lies at ``at``/asset.
    """
    ref = rows.select(*keys, at, F.posexplode("parts").alias("_i", "_p")).where(F.col("_p.asset").isNotNull() & ~is_unsafe(F.col("_p.asset")))
    found = ref.withColumn("path", F.concat_ws("/", at, "_p.asset")).join(files.select("path", "content"), "path")
    held = found.groupBy(*keys, at).agg(F.map_from_entries(F.collect_list(F.struct("_i", "content"))).alias("_bytes"))
    out = rows.join(held, [*keys, at], "left")
    whole = F.transform("parts", lambda p, i: F.struct(p["text"].alias("text"), F.try_element_at("_bytes", i).alias("image")))
    out = out.withColumn("parts", F.filter(whole, lambda p: p["text"].isNotNull() | p["image"].isNotNull())).drop("_bytes")
    size = lambda p: F.coalesce(F.octet_length(p["text"]), F.lit(0)) + F.coalesce(F.octet_length(p["image"]), F.lit(0))
    return out.withColumn("bytes", F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + size(p)))

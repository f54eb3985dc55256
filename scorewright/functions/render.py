"""Texts for takers, judges and readers, and small look-ups around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def answer_text(kind: Column, selected: Column, value: Column, blanks: Column, pairs: Column, text: Column) -> Column:
    """An answer as one text, by its type; maps in order of their keys."""
    listed = lambda m, sep: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(sep), e["value"])), "\n")
    return (
        F.when(kind.isin("single_choice", "multiple_choice"), F.array_join(F.array_sort(selected), ", "))
        .when(kind == "true_false", F.when(value, "true").otherwise("false"))
        .when(kind == "fill_in_blank", listed(blanks, ": "))
        .when(kind == "matching", listed(pairs, " -> "))
        .otherwise(F.coalesce(text, F.lit("")))
    )


def rubric_text(rubric: Column) -> Column:
    """Lines of array<struct<id, description, levels array<struct<points, descriptor>>>>, levels from high to low."""
    level = lambda v: F.concat(F.lit("  - "), F.regexp_replace(F.format_string("%.6f", v["points"]), r"\.?0+$", ""), F.lit(": "), v["descriptor"])
    falling = lambda a: F.array_sort(a, lambda x, y: F.when(x["points"] > y["points"], -1).when(x["points"] < y["points"], 1).otherwise(0))
    one = lambda c: F.concat(F.lit("- "), c["id"], F.lit(": "), c["description"], F.lit("\n"), F.array_join(F.transform(falling(c["levels"]), level), "\n"))
    return F.array_join(F.transform(rubric, one), "\n")


def answer_length(text: Column, description: Column) -> Column:
    """Characters of an answer without white space around."""
    return F.length(F.regexp_replace(F.coalesce(text, description, F.lit("")), r"(?U)^\s+|\s+$", ""))


def problem_list(problems: DataFrame, by: str, text: str, order: str, most: int = 50) -> DataFrame:
    """The first ``most`` problems of each group as lines, and how many more there are."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    n = F.count("*").over(Window.partitionBy(by))
    top = problems.withColumn("_nth", nth).withColumn("_n", n).where(F.col("_nth") <= most)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", text))), lambda x: F.concat(F.lit("- "), x[text])), "\n")
    more = F.max("_n") - most
    return top.groupBy(by).agg(F.concat(lines, F.when(more > 0, F.concat(F.lit("\nand "), more.cast("string"), F.lit(" more"))).otherwise("")).alias("lines"))


def parse_selection(choice: Column, meta: DataFrame, spark) -> DataFrame:
    """Papers of a selection text: 'all', exam names and paper names, comma-separated.  ``choice`` is a literal."""
    wanted = spark.range(1).select(F.explode(F.split(choice, r"\s*,\s*")).alias("_w"))
    hit = (F.col("_w") == "all") | (F.col("_w") == F.col("subset")) | (F.col("_w") == F.col("exam"))
    return meta.join(F.broadcast(wanted), hit, "left_semi")


def last_entries(entries: Column) -> Column:
    """Map of array<struct<key, value>>; the last of repeated keys counts."""
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(kept)


def derive_ablation(rules: DataFrame, strata: DataFrame, keep: list[str], bare: bool = False) -> DataFrame:
    """Rules of kept strata without rubric and instructions and, if ``bare``, without the reference answer."""
    kept = rules.join(strata.where(F.col("stratum").isin(keep)), "question_id", "left_semi")
    out = kept.withColumns({"rubric": F.lit(None).cast(kept.schema["rubric"].dataType), "instructions": F.lit(None).cast("string")})
    return out.withColumn("reference_answer", F.lit(None).cast("string")) if bare else out


def first_given(*values: Column) -> Column:
    """The first value that reads as a number above zero: explicit, environment, default."""
    return F.coalesce(*(F.when(v.cast("string").try_cast("double") > 0, v.cast("string").try_cast("double")) for v in values))


def series_style(i: Column, n: int = 4) -> Column:
    """struct<line, symbol> of a series: lines turn first, then symbols."""
    return F.struct(F.pmod(i, F.lit(n)).alias("line"), F.pmod(F.floor(i / n), F.lit(n)).alias("symbol"))


def cost_digits(cost: Column) -> Column:
    """Decimals that a column of costs needs by its maximum."""
    top = F.max(cost).over(Window.partitionBy(F.lit(1)))
    return F.when(top >= 100, 0).when(top >= 10, 1).otherwise(2)


def _text(x: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)


def _object(names: Column, values: Column) -> Column:
    """A JSON object of names and JSON texts."""
    return F.concat(F.lit("{"), F.array_join(F.zip_with(names, values, lambda k, v: F.concat(_text(k), F.lit(": "), v)), ", "), F.lit("}"))


def _strict(names: Column, values: Column, required: Column | None = None) -> Column:
    """The JSON Schema of an object with these members and no other."""
    return F.concat(F.lit('{"type": "object", "additionalProperties": false, "properties": '), _object(names, values), F.lit(', "required": '), F.to_json(names if required is None else required), F.lit("}"))


def answer_schema(leaves: DataFrame, by: str = "exam_id") -> DataFrame:
    """``by``, schema: a strict JSON Schema of each exam's answer sheets, every leaf required, ids as enums.

    leaves as ``structure.flatten_exam`` gives them; ``by`` tells documents apart.
    """
    ids = lambda c: F.coalesce(F.transform(c, lambda o: o["id"]), F.array().cast("array<string>"))
    enum = lambda a: F.concat(F.lit('{"enum": '), F.to_json(a), F.lit("}"))
    each = lambda keys, value: F.transform(keys, lambda _: value)
    string, kind, left = F.lit('{"type": "string"}'), F.col("type"), ids("matching.left")

    def answer(of: str, required: tuple[str, ...], **members: Column) -> Column:
        names, values = F.array(F.lit("type"), *map(F.lit, members)), F.array(F.lit(f'{{"const": "{of}"}}'), *members.values())
        return _strict(names, values, F.array(F.lit("type"), *map(F.lit, required)))

    value = (
        F.when(kind == "single_choice", answer("single_choice", ("selected",), selected=enum(ids("options"))))
        .when(kind == "multiple_choice", answer("multiple_choice", ("selected",), selected=F.concat(F.lit('{"type": "array", "uniqueItems": true, "items": '), enum(ids("options")), F.lit("}"))))
        .when(kind == "true_false", answer("true_false", ("value",), value=F.lit('{"type": "boolean"}')))
        .when(kind == "fill_in_blank", answer("fill_in_blank", ("blanks",), blanks=_strict(ids("blanks"), each(ids("blanks"), string))))
        .when(kind == "matching", answer("matching", ("pairs",), pairs=_strict(left, each(left, enum(ids("matching.right"))))))
        .when(kind == "drawing", answer("drawing", ("description",), description=string, image_asset=F.lit('{"type": ["string", "null"]}')))
        .otherwise(answer("text", ("text",), text=string))
    )
    title = F.concat(F.lit("Answer sheet for "), F.coalesce("exam_title", F.lit("None")))
    rows = leaves.select(F.col(by).alias("_by"), F.col("exam_id").alias("_id"), title.alias("_title"), "place", "node_id", value.alias("v"))
    per = rows.groupBy("_by").agg(F.first("_id").alias("_id"), F.first("_title").alias("_title"), F.array_sort(F.collect_list(F.struct("place", "node_id", "v"))).alias("q"))
    answers = _strict(F.transform("q", lambda x: x["node_id"]), F.transform("q", lambda x: x["v"]))
    top = _strict(
        F.array(*map(F.lit, ("exam_id", "taker", "usage", "answers"))),
        F.array(F.concat(F.lit('{"const": '), _text(F.col("_id")), F.lit("}")), F.lit('{"type": ["string", "null"]}'), F.lit('{"type": ["object", "null"]}'), answers),
        F.array(F.lit("exam_id"), F.lit("answers")),
    )
    head = F.concat(F.lit('{"$schema": "https://json-schema.org/draft/2020-12/schema", "title": '), _text(F.col("_title")), F.lit(", "))
    return per.select(F.col("_by").alias(by), F.concat(head, F.substr(top, F.lit(2))).alias("schema"))

"""Small texts and settings of runs: usage, efforts, declarations, dates, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.text import EFFORTS, effort_rank, floor5, split_model

# The lowest and the highest effort that a provider or harness knows; others are drawn to the nearer of them.
EFFORT_RANGE = {"openai": ("minimal", "max"), "google": ("minimal", "high"), "google-cloud": ("minimal", "high"), "codex": ("minimal", "xhigh"), "claude": ("low", "max")}


def grouped(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def usage_line(requests: Column, tokens_in: Column, tokens_out: Column, reasoning: Column, cache_read: Column, cache_write: Column) -> Column:
    """Tokens of a run in one line; kinds that did not occur are left out."""
    extra = lambda name, n: F.when(n > 0, F.concat(F.lit(name + " "), grouped(n)))
    extras = F.concat_ws(", ", extra("reasoning", reasoning), extra("cache read", cache_read), extra("cache write", cache_write))
    shown = F.when(extras != "", F.concat(F.lit(" ("), extras, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("Tokens: "), grouped(tokens_in), F.lit(" in / "), grouped(tokens_out), F.lit(" out"), shown, F.lit(" over "), requests.cast("string"), F.lit(" request(s)"))


def judge_delta(disagreed: Column, comparable: Column) -> Column:
    """Questions on which judges differ, of those that several judged; a dash if there are none."""
    return F.when(F.coalesce(comparable, F.lit(0)) > 0, F.concat_ws("/", disagreed.cast("string"), comparable.cast("string"))).otherwise("–")


def effort_setting(model: Column, effort: Column) -> Column:
    """The effort that a model's provider is given: the wanted one within the provider's range; null without a wish or a known provider."""
    provider, out = split_model(model)["harness"], F.lit(None).cast("string")
    dial = F.array(*map(F.lit, EFFORTS))
    for name, (low, high) in EFFORT_RANGE.items():
        rank = F.least(F.greatest(effort_rank(effort), F.lit(EFFORTS.index(low))), F.lit(EFFORTS.index(high)))
        out = F.when((provider == name) & F.array_contains(dial, effort), F.get(dial, rank)).otherwise(out)
    return out


def is_harness(model: Column, harnesses: list[str]) -> Column:
    """Whether a model is run by one of these harnesses, by its prefix."""
    hit = F.lit(False)
    for h in harnesses:
        hit = hit | model.startswith(f"{h}:")
    return hit


def text_only(declared: DataFrame, models: DataFrame, harnesses: list[str]) -> DataFrame:
    """model, effect of each declaration: 'applies', 'no such model', or 'opens files' for harnesses, which it does not bind."""
    met = declared.select("model").distinct().join(models.select("model").distinct().withColumn("_there", F.lit(True)), "model", "left")
    effect = F.when(F.col("_there").isNull(), "no such model").when(is_harness(F.col("model"), harnesses), "opens files").otherwise("applies")
    return met.select("model", effect.alias("effect"))


def distinct_models(models: Column) -> Column:
    """A list of models, each at its first place."""
    return F.array_distinct(models)


def named_like(rows: DataFrame, part: str, column: str = "subset") -> DataFrame:
    """Rows whose name holds a text, whatever its case; all rows for an empty text."""
    return rows.where(F.contains(F.lower(column), F.lower(F.lit(part))))


def card_date(at: Column) -> Column:
    """The day of a time, as cards show it."""
    return F.date_format(at, "yyyy-MM-dd")


def radar_floor(least: Column, from_zero: bool = False) -> Column:
    """Where the axes of a radar begin: the five below the least percentage (null counts 100), at most 80; or 0."""
    return F.lit(0.0) if from_zero else F.least(floor5(F.least(F.lit(100.0), F.coalesce(least, F.lit(100.0)))), F.lit(80.0))

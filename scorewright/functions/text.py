"""Text and number expressions: normalisation, printed numbers, tolerance, Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_SPACE = r"[\t\n\x0b\f\r\x1c-\x1f ]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{ASCII_SPACE}+|{ASCII_SPACE}+$", "")


def normalize_ascii(text: Column, case_insensitive: bool = True, trim: bool = True, collapse: bool = True) -> Column:
    """Normalised text; exact for ASCII texts."""
    out = strip(text) if trim else text
    out = F.regexp_replace(out, rf"{ASCII_SPACE}+", " ") if collapse else out
    return F.lower(out) if case_insensitive else out


def nfkc_form(text: Column) -> Column:
    """NFKC form by the ICU library that Spark ships."""
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def folded(text: Column) -> Column:
    """Full case folding by the ICU library that Spark ships; ``lower`` differs for some letters."""
    return F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


#: White space of any script and the four ASCII separators.
ANY_SPACE = r"(?U)[\s\x1c-\x1f]"
ASCII_ONLY = r"\A[\x00-\x7f]*\z"


def normalize_text(text: Column, case_insensitive: Column | bool = True, trim: Column | bool = True, collapse: Column | bool = True, nfkc: Column | bool = True) -> Column:
    """Text of any script after NFKC, strip, collapse of white space and case folding, in this order; each can be switched off.

    Switches are constants or columns.  ASCII texts take plain expressions only; nothing leaves the JVM.
    """

    def step(on: Column | bool, value: Column, changed: Column) -> Column:
        return (changed if on else value) if isinstance(on, bool) else F.when(on, changed).otherwise(value)

    def steps(t: Column, space: str, fold) -> Column:
        t = step(trim, t, F.regexp_replace(t, rf"\A{space}+|{space}+\z", ""))
        t = step(collapse, t, F.regexp_replace(t, rf"{space}+", " "))
        return step(case_insensitive, t, fold(t))

    plain = steps(text, ASCII_SPACE, F.lower)
    return F.when(text.rlike(ASCII_ONLY), plain).otherwise(steps(step(nfkc, text, nfkc_form(text)), ANY_SPACE, folded))


# The zeros of scripts whose decimal digits follow one another.
ZEROS = "٠۰߀०০੦૦୦௦౦೦൦๐໐༠၀០᠐０"
_DIGITS = ("".join(chr(ord(z) + i) for z in ZEROS for i in range(10)), "0123456789" * len(ZEROS))


def parse_number(text: Column) -> Column:
    """Number of a text: thousands commas, fractions a/b, words for infinities and digits of other scripts are read; else null."""
    t = F.replace(F.regexp_replace(text, rf"\A{ANY_SPACE}+|{ANY_SPACE}+\z", ""), F.lit(","), F.lit(""))
    t = F.when(t.rlike(ASCII_ONLY), t).otherwise(F.translate(t, *_DIGITS))
    over, under = F.split_part(t, F.lit("/"), F.lit(1)), F.split_part(t, F.lit("/"), F.lit(2))
    plain = F.replace(t, F.lit("_"), F.lit(""))
    return (
        F.when(t.rlike(r"^[+-]?\d+(\.\d+)?/\d+(\.\d+)?$"), F.try_divide(over.cast("double"), under.cast("double")))
        .when(t.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"), plain.try_cast("double"))
        .when(F.lower(t).rlike(r"^[+]?inf(inity)?$"), F.lit(float("inf")))
        .when(F.lower(t).rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
        .when(F.lower(t).rlike(r"^[+-]?nan$"), F.lit(float("nan")))
    )


def numbers_close(a: Column, b: Column, absolute: Column | None = None, relative: Column | None = None) -> Column:
    """Equal, or within max(relative x larger, absolute); the relative part is 1e-9 unless given."""
    larger = F.greatest(F.abs(a), F.abs(b))
    room = (F.lit(1e-9) if relative is None else relative) * larger
    room = room if absolute is None else F.greatest(room, absolute)
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return ~F.isnan(a) & ~F.isnan(b) & ((a == b) | (finite & (F.abs(a - b) <= room)))


def texts_match(given: Column, accepted: Column, tolerance: Column | None = None, relative: bool = False, normal=normalize_text) -> Column:
    """Normalised texts are equal, or both are numbers within the tolerance."""
    same = normal(F.coalesce(given, F.lit(""))) == normal(accepted)
    if tolerance is None:
        return same
    a, b = parse_number(given), parse_number(accepted)
    close = numbers_close(a, b, relative=tolerance) if relative else numbers_close(a, b, absolute=tolerance)
    return same | F.coalesce(close & tolerance.isNotNull(), F.lit(False))


def slugify(text: Column, most: int = 48, default: str = "exam") -> Column:
    """Lower-case words joined by '-', at most ``most`` characters."""
    s = F.regexp_replace(F.lower(text), r"(?U)[^\w]+", "-")
    s = F.regexp_replace(F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(most)), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def normalize_number(printed: Column) -> Column:
    """A printed question number without marks: '1.' = '1)' = 'Q1' = '第1題'."""
    low = F.lower(strip(printed))
    t = F.regexp_replace(low, r"^(question|q|第)\s*", "")
    t = F.regexp_replace(t, r"[\s.。()（）\[\]]+", "")
    t = F.regexp_replace(t, r"(題|题|问|問)$", "")
    return F.when(t == "", low).otherwise(t)


def leading_int(printed: Column) -> Column:
    """The integer a printed number begins with, or null."""
    return F.nullif(F.regexp_extract(normalize_number(printed), r"^\d+", 0), F.lit("")).try_cast("int")


RANGE = r"(\d+)\s*[-–~～至到]\s*(\d+)"


def covered_numbers(printed: Column) -> Column:
    """Every integer a printed number stands for: ranges of at most 100 and the leading integer, sorted."""
    low = F.regexp_extract_all(printed, F.lit(RANGE), F.lit(1))
    high = F.regexp_extract_all(printed, F.lit(RANGE), F.lit(2))
    spans = F.zip_with(low, high, lambda a, b: F.struct(a.try_cast("int").alias("a"), b.try_cast("int").alias("b")))
    spans = F.filter(spans, lambda s: (s["a"] <= s["b"]) & (s["b"] <= s["a"] + 100))
    runs = F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"])))
    lead = leading_int(printed)
    return F.array_sort(F.array_distinct(F.when(lead.isNull(), runs).otherwise(F.array_append(runs, lead))))


def run_label(first: Column, last: Column) -> Column:
    """'5' or '2-3'."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def markdown_table(header: Column, rows: Column) -> Column:
    """Markdown of array<string> header and array<array<string>> rows; ragged rows are padded; '' without columns."""
    width = F.greatest(F.size(header), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))

    def line(cells: Column) -> Column:
        padded = F.concat(cells, F.array_repeat(F.lit(""), width - F.size(cells)))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(rows, line)
    return F.when(width > 0, F.array_join(F.concat(F.array(line(header), rule), body), "\n")).otherwise(F.lit(""))


def mean_and_spread(mean: Column, std: Column, suffix: str = "") -> Column:
    """'12.5 ± 0.7', without the spread if there is none, '-' without a mean."""
    shown = F.format_string("%.1f", mean)
    return F.when(mean.isNull(), F.lit("-")).when(std.isNull(), F.concat(shown, F.lit(suffix))).otherwise(
        F.concat(shown, F.lit(" ± "), F.format_string("%.1f", std), F.lit(suffix))
    )


def display_number(x: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")


def split_model(model: Column) -> Column:
    """struct<harness, name> of 'harness:name'; without a colon the harness is null."""
    at = F.instr(model, ":")
    return F.struct(
        F.when(at > 0, F.substr(model, F.lit(1), at - 1)).alias("harness"), F.substr(model, at + 1, F.length(model)).alias("name")
    )


def short_subject(subset: Column) -> Column:
    """The parts of a paper's name after exam and year; the whole name if there are no more than two parts."""
    parts = F.split(subset, "-")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(1))), "-")).otherwise(subset)


# The effort dial, in order.
EFFORTS = ["minimal", "low", "medium", "high", "xhigh", "max"]


def effort_rank(effort: Column) -> Column:
    """Place on the effort dial from 0; null and unknown efforts are -1."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, EFFORTS)), effort) - 1, F.lit(-1)).cast("int")


def floor5(x: Column) -> Column:
    """The multiple of five below, not under 0."""
    return F.greatest(F.lit(0.0), F.floor(x / 5) * 5.0)


def default_entry_id(model: Column, effort: Column) -> Column:
    """Slug of model and effort; without an effort it is 'default'."""
    return slugify(F.concat_ws("-", model, F.coalesce(effort, F.lit("default"))))

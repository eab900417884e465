"""Scalar functions on cell texts, as column expressions: they stay in the JVM and in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number, an integer on its own, a grouped number, a plain number, a judge's score.
NUMBER = r"[-+]?[0-9]*\.?[0-9]+"
INTEGER = r"(?<![0-9.])([0-9]+)(?![0-9.]| *[%％])"
GROUPED = r"^[-+]?[0-9]{0,3}(,[0-9]{3})*(\.[0-9]+)?$"
PLAIN = r"^[+-]?[0-9]+(\.[0-9]+)?$"
SCORE = r"\[\[([0-9]+(\.[0-9]+)?)\]\]"
TITLE_CHARS = 50
MISSING = "N/A"


def first_number(text: Column) -> Column:
    """The first number in a text, null if there is none."""
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")


def all_numbers(text: Column) -> Column:
    """All numbers in a text, in order; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.when(F.size(found) > 0, F.transform(found, lambda x: x.cast("double")))


def pure_integers(text: Column) -> Column:
    """Distinct integers that are neither part of a decimal nor a percentage, without 0, in ascending order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(INTEGER), F.lit(1)), lambda x: x.cast("long"))
    return F.sort_array(F.array_except(F.array_distinct(found), F.array(F.lit(0).cast("long"))))


def ungrouped_number(text: Column) -> Column:
    """Thousands commas removed from a text that is one number; leading commas stay. The rest is only trimmed.

    A text of commas and a number is peeled from the left, so commas before the number, with blanks around them, stay.
    """
    trimmed = F.trim(text)
    lead = F.regexp_extract(trimmed, r"^(?:,\s*)*", 0)
    body = F.substring(trimmed, F.char_length(lead) + 1, F.char_length(trimmed))
    plain = F.when(body.rlike(GROUPED), F.replace(body, F.lit(","), F.lit(""))).otherwise(body)
    return F.concat(F.regexp_replace(lead, r"\s", ""), plain)


def without_commas(text: Column, replacement: str = " ") -> Column:
    return F.replace(text, F.lit(","), F.lit(replacement))


def plain_spaces(text: Column) -> Column:
    """Thin and no-break spaces as spaces."""
    return F.replace(F.replace(text, F.lit(" "), F.lit(" ")), F.lit(" "), F.lit(" "))


def without_references(text: Column) -> Column:
    """What stands before the last mention of references, in any case; all of it if there is none."""
    word = "references"
    back = F.instr(F.reverse(F.lower(text)), word[::-1])
    return F.when(back > 0, F.substring(text, F.lit(1), F.char_length(text) - back - len(word) + 1)).otherwise(text)


def escaped_markdown(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("#"), F.lit("\\#")), F.lit("*"), F.lit("\\*"))


def escaped_braces(text: Column) -> Column:
    """Single braces doubled; those that are doubled already stay."""
    closed = F.regexp_replace(text, r"(?<!\})\}(?!\})", "}}")
    return F.regexp_replace(closed, r"(?<!\{)\{(?!\{)", "{{")


def short_title(caption: Column) -> Column:
    """A caption of under 50 characters as it is, else its first 48 and an ellipsis; null if it is empty."""
    c = F.trim(caption)
    cut = F.concat(F.substring(c, 1, TITLE_CHARS - 2), F.lit(" ..."))
    return F.when(F.char_length(caption) > 0, F.when(F.char_length(c) < TITLE_CHARS, c).otherwise(cut))


def without_fences(text: Column) -> Column:
    """A payload without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json|csv)?\s*", ""), r"\s*```$", ""))


def payload_format(text: Column) -> Column:
    """``json`` or ``csv``, by how a payload begins."""
    return F.when(F.ltrim(text).rlike(r"^[\[{]"), "json").otherwise("csv")


def quoted_property_names(text: Column) -> Column:
    """Bare JSON property names in quotes."""
    return F.regexp_replace(text, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)(\s*:)", r'$1"$2"$3')


def without_empty_fields(text: Column) -> Column:
    """JSON objects without the empty strings that stand where a field should."""
    inner = F.regexp_replace(text, r',\s*""\s*(?=[,}])', "")
    return F.regexp_replace(inner, r'\{\s*""\s*,', "{")


def without_cut_object(text: Column) -> Column:
    """A JSON list up to its last object that begins after a whole one: what a cut-off answer has for certain."""
    found = F.regexp_extract(text, r"(?s)^(.*\} *, *)\{", 1)
    return F.when(found != "", found).otherwise(text)


def joined_answers(parts: Column) -> Column:
    """An answer that came in several parts (an array) as one JSON text.

    Missing parts and code fences go. A part that begins a list anew ends the one before at its last whole object and goes
    on in its list. What still isn't JSON is cut at its last whole object and closed.
    """
    plain = F.transform(F.filter(parts, lambda p: p.isNotNull()), lambda p: F.regexp_replace(F.trim(F.regexp_replace(F.trim(p), r"^```json", "")), r"```$", ""))

    def step(state: Column, part: Column) -> Column:
        anew = part.startswith("[{") & state["begun"]
        done = F.concat(state["done"], F.when(anew, without_cut_object(state["last"])).otherwise(state["last"]))
        return F.struct(done.alias("done"), F.when(anew, F.substring(part, F.lit(2), F.char_length(part))).otherwise(part).alias("last"), F.lit(True).alias("begun"))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"), F.lit(False).alias("begun"))
    text = F.aggregate(plain, start, step, lambda s: F.concat(s["done"], s["last"]))
    closed = F.concat(F.regexp_replace(F.trim(without_cut_object(text)), r",$", ""), F.lit("]"))
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(closed).isNotNull(), closed).otherwise(text)


def is_plain_number(text: Column) -> Column:
    return F.coalesce(text.rlike(PLAIN), F.lit(False))


def parsed(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def judge_score(text: Column) -> Column:
    """The number in double brackets, null if there is none."""
    return F.regexp_extract(text, SCORE, 1).try_cast("double")


def has_digit(text: Column) -> Column:
    return F.coalesce(text.rlike("[0-9]"), F.lit(False))


def blank_to_missing(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*$"), MISSING).otherwise(text)


def dotted_decimals(text: Column) -> Column:
    """Middle dots as decimal points, trimmed."""
    return F.translate(F.trim(text), "·∙•", "...")


def without_pipes(text: Column) -> Column:
    """A cell that would break a Markdown row, with dashes for its pipes and a note."""
    return F.when(text.contains("|"), F.concat(F.lit("Content from Table: "), F.translate(text, "|", "-"))).otherwise(text)


def after_thinking(text: Column) -> Column:
    """An answer without the reasoning before it; then from the first JSON bracket on if that lies in the first half."""
    body = F.trim(F.when(text.contains("</think>"), F.substring_index(text, "</think>", -1)).otherwise(text))
    at = F.regexp_instr(body, F.lit(r"[\[{]"))
    return F.when((at > 0) & (at <= F.char_length(body) / 2), F.substring(body, at, F.char_length(body))).otherwise(body)


def joined_sections(sections: Column) -> Column:
    """``array<struct<section, content>>`` as a text."""
    return F.array_join(F.transform(sections, lambda s: F.concat_ws("\n", s["section"], s["content"])), "\n")


def table_prompt(index: Column, caption: Column, table: Column, footnote: Column) -> Column:
    """A table with its caption and footnote as a text; what is empty is left out."""
    part = lambda name, c: F.when(F.char_length(F.coalesce(c, F.lit(""))) > 0, F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", F.concat(F.lit("Table "), index.cast("string")), part("caption", caption), part("table", table), part("footnote", footnote))


def column_definitions(names: Column, definitions: Column) -> Column:
    """Two arrays as lines ``name: definition``."""
    return F.array_join(F.zip_with(names, definitions, lambda n, d: F.concat_ws(": ", n, d)), "\n")

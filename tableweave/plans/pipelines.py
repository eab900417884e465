"""The ten curation pipelines: what their output looks like, and how it is put together from decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableweave.operators import cleanup
from tableweave.operators.positional import ROW, exploded, gathered, replicated, zipped
from tableweave.plans.inputs import dealt_out

MISSING = "N/A"
_WHO = ["Population", "Pregnancy stage", "Pediatric/Gestational age"]
_BOUNDS = ["Variation type", "Variation value", "Interval type", "Lower bound", "Upper bound"]
#: Output columns, all texts.
OUTPUTS = {
    "pk_summary": ["Drug name", "Analyte", "Specimen", *_WHO, "Subject N", "Parameter type", "Parameter unit", "Parameter statistic", "Parameter value", *_BOUNDS, "P value", "Time value", "Time unit"],
    "pk_individual": ["Patient ID", "Drug name", "Analyte", "Specimen", *_WHO, "Parameter type", "Parameter unit", "Parameter value", "Time value", "Time unit"],
    "pk_specimen_summary": ["Specimen", "Sample N", *_WHO, "Subject N", "Sample time", "Time unit", "Note"],
    "pk_specimen_individual": ["Patient ID", "Specimen", "Sample N", *_WHO, "Sample time", "Time unit", "Note"],
    "pk_drug_summary": ["Drug/Metabolite name", "Dose amount", "Dose unit", "Dose frequency", "Dose schedule", "Dose route", *_WHO, "Subject N", "Note"],
    "pk_drug_individual": ["Patient ID", "Drug/Metabolite name", "Dose amount", "Dose unit", "Dose frequency", "Dose schedule", "Dose route", *_WHO, "Note"],
    "pk_population_summary": ["Characteristic", "Characteristic subcategory", "Characteristic unit", "Characteristic value", "Statistics type", *_BOUNDS, *_WHO, "Subject N", "Note"],
    "pk_population_individual": ["Patient ID", "Characteristic", "Characteristic subcategory", "Characteristic unit", "Characteristic value", *_WHO, "Note"],
    "pe_study_info": ["Study type", "Population", "Study design", "Pregnancy stage", "Drug name", "Data source", "Inclusion criteria", "Exclusion criteria", "Outcomes", "Subject N"],
    "pe_study_outcome": ["Characteristic", "Exposure", "Outcome", "Parameter unit", "Parameter statistic", "Parameter value", *_BOUNDS, "P value"],
}


def decision(decisions: DataFrame, keys: list[str], step: str, schema: str) -> DataFrame:
    """``keys, d``: the answers to one step, recorded as JSON in ``keys, step, payload``. They stand for a language model."""
    return decisions.filter(F.col("step") == step).select(*keys, F.from_json("payload", schema).alias("d"))


def decided_table(decisions: DataFrame, keys: list[str], step: str, columns: list[str]) -> DataFrame:
    """A step's answer of lists of cells as rows."""
    return exploded(decision(decisions, keys, step, "array<array<string>>").withColumnRenamed("d", "values"), keys, columns)


def matched(decisions: DataFrame, lookup: DataFrame, keys: list[str], step: str, columns: list[str], rows: DataFrame) -> DataFrame:
    """A lookup's rows at the rows of ``rows``: by the step's match vector, or, for tables whose lookup has one row, that one."""
    single = lookup.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    one = lookup.join(single.filter("__n = 1").select(*keys), keys, "left_semi")
    auto = replicated(rows.select(*keys, ROW), one, keys).select(*keys, ROW, *[F.col(f"`{c}`") for c in columns])
    vector = decision(decisions, keys, step, "array<int>").withColumnRenamed("d", "match").join(single.filter("__n > 1").select(*keys), keys, "left_semi")
    return auto.unionByName(gathered(vector, lookup, keys, columns))


def assemble(pipeline: str, parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Parts with ``keys, row_idx`` side by side under the pipeline's output columns; what no part has is N/A."""
    wide = zipped(parts, keys)
    have = set(wide.columns)
    return wide.select(*keys, ROW, *[(F.coalesce(F.col(f"`{c}`"), F.lit(MISSING)) if c in have else F.lit(MISSING)).alias(c) for c in OUTPUTS[pipeline]])


_DRUG, _WHO_N = ["Drug name", "Analyte", "Specimen"], [*_WHO, "Subject N"]
_VALUES = ["Parameter unit", "Parameter statistic", "Parameter value", *_BOUNDS]
_CHARACTERISTIC = ["Characteristic", "Characteristic subcategory", "Characteristic unit", "Characteristic value"]
_DOSE = ["Drug/Metabolite name", "Dose amount", "Dose unit", "Dose frequency", "Dose schedule", "Dose route"]
#: For each pipeline the steps whose answers are rows, and those whose answers are a lookup with a match vector.
STEPS: dict[str, tuple[dict[str, list[str]], dict[str, tuple[str, list[str]]]]] = {
    "pk_summary": (
        {"param_value": ["Parameter value", "Parameter statistic", *_BOUNDS, "P value"], "param_type_unit": ["Parameter type", "Parameter unit"], "time_unit": ["Time value", "Time unit"]},
        {"drug_info": ("drug_match", _DRUG), "patient_info": ("patient_match", _WHO_N)},
    ),
    "pk_individual": (
        {"param_value": ["Parameter value"], "param_type_unit": ["Parameter type", "Parameter unit"], "time_unit": ["Time value", "Time unit"]},
        {"drug_info": ("drug_match", _DRUG), "patient_info": ("patient_match", ["Patient ID", *_WHO])},
    ),
    "pk_specimen_summary": ({"specimen_info": ["Specimen", "Sample N", "Note"], "patient_info": _WHO_N, "time_unit": ["Sample time", "Time unit"]}, {}),
    "pk_specimen_individual": ({"specimen_info": ["Specimen", "Sample N", "Note"], "patient_info": ["Patient ID", *_WHO], "time_unit": ["Sample time", "Time unit"]}, {}),
    "pk_drug_summary": ({"drug_info": [*_DOSE, "Note"], "patient_info": _WHO_N}, {}),
    "pk_drug_individual": ({"drug_info": [*_DOSE, "Note"], "patient_info": ["Patient ID", *_WHO]}, {}),
    "pk_population_summary": ({"characteristic_info": [*_CHARACTERISTIC, "Statistics type", *_BOUNDS, "Note"], "patient_info": _WHO_N}, {}),
    "pk_population_individual": ({"characteristic_info": [*_CHARACTERISTIC, "Note"], "patient_info": ["Patient ID", *_WHO]}, {}),
    "pe_study_info": ({"design_info": OUTPUTS["pe_study_info"]}, {}),
    "pe_study_outcome": ({"mapping": ["Characteristic", "Exposure", "Outcome", "P value"], "param_value": _VALUES}, {}),
}
#: What a summary row is about.
IDENTITY = [*_DRUG, *_WHO_N, "Parameter type", "Parameter unit"]
_SUMMARY = cleanup.Names(
    "Parameter value", "Parameter statistic", "Variation value", "Variation type", "Interval type", "Lower bound", "Upper bound", "Subject N", IDENTITY,
)


def assembled_rows(pipeline: str, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """A pipeline's rows from recorded answers (one a step): lists of rows side by side, lookups at the rows of the first list.

    One pass over the answers: a table's come together in one row by partial maxima, lists are put side by side as arrays,
    and matches look up places of an array. There is no join; what was matched and isn't there is ERROR, what is missing N/A.
    """
    direct, lookups = STEPS[pipeline]
    steps = [*direct, *lookups, *[match for match, _ in lookups.values()]]
    # so many parts that none is large: answers are small as shuffled, but not as rows
    packed = dealt_out(decisions.filter(F.col("step").isin(steps)), keys).groupBy(*keys).agg(*[F.max(F.when(F.col("step") == s, F.col("payload"))).alias(f"__{s}") for s in steps])
    rows, none = "array<array<string>>", F.array().cast("array<array<string>>")
    listed = lambda s: F.coalesce(F.from_json(f"__{s}", rows), none)
    told = packed.select(*keys, *[listed(s).alias(s) for s in (*direct, *lookups)], *[F.from_json(f"__{m}", "array<int>").alias(m) for m, _ in lookups.values()])
    first, parts = next(iter(direct)), {s: (F.col(s), columns) for s, columns in direct.items()}

    def looked_up(lookup: str, match: str, width: int) -> Column:
        return F.transform(match, lambda k: F.coalesce(F.get(lookup, k), F.array_repeat(F.lit(cleanup.ERROR), width)))

    for s, (match, columns) in lookups.items():
        many = F.coalesce(looked_up(s, match, len(columns)), none)
        parts[s] = F.when(F.size(s) == 1, F.array_repeat(F.get(s, F.lit(0)), F.size(first))).when(F.size(s) > 1, many).otherwise(none), columns

    def row(x: Column, place: Column) -> Column:
        cells = {c: F.when(F.size(x[s]) == len(columns), F.get(x[s], F.lit(k))) for s, (_, columns) in parts.items() for k, c in enumerate(columns)}
        return F.struct(place.alias(ROW), *[F.coalesce(cells[c], F.lit(MISSING)).alias(c) if c in cells else F.lit(MISSING).alias(c) for c in OUTPUTS[pipeline]])

    # cells are made within the generator, so that rules on them don't hold these expressions again and again
    return told.select(*keys, F.inline(F.transform(F.arrays_zip(*[p.alias(s) for s, (p, _) in parts.items()]), row)))


def cleaned_rows(pipeline: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last step of a pipeline. Outcomes of studies are cleaned as summaries are, but with no row merged or left out for
    another. Specimen rows lose the one that sums up the others. Drugs, populations and designs of studies have no rules."""
    columns = OUTPUTS[pipeline]
    if pipeline == "pk_summary":
        return cleanup.clean_summary(rows, keys, _SUMMARY, columns)
    if pipeline == "pk_individual":
        return cleanup.clean_individual(rows, keys, columns, "Time value", "Time unit", "Parameter value", "Parameter type", "Parameter unit")
    if pipeline in ("pk_specimen_summary", "pk_specimen_individual"):
        return cleanup.clean_specimen(rows, keys, columns)
    if pipeline == "pe_study_outcome":
        told = cleanup.normalized(cleanup.rewritten(rows, cleanup.value_rules(_SUMMARY)), columns)
        return cleanup.with_numbers(told, ["Parameter value", "Variation type", "Lower bound", "Upper bound"])
    return cleanup.with_numbers(rows, ["Characteristic value"]) if pipeline == "pk_population_individual" else rows


def curated(pipeline: str, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """A pipeline from recorded answers to its clean output."""
    if pipeline not in OUTPUTS:
        raise ValueError(f"no pipeline {pipeline}")
    return cleaned_rows(pipeline, assembled_rows(pipeline, decisions, keys), keys).select(*keys, ROW, *[F.col(f"`{c}`") for c in OUTPUTS[pipeline]])


def curated_all(decisions: DataFrame, keys: list[str], pipelines: list[str] | None = None) -> DataFrame:
    """Several pipelines over one table of answers (``pipeline, keys, step, payload``), each row a map of its columns."""
    parts = []
    for name in pipelines or list(OUTPUTS):
        rows = curated(name, decisions.filter(F.col("pipeline") == name).drop("pipeline"), keys)
        cells = F.map_from_arrays(F.array(*[F.lit(c) for c in OUTPUTS[name]]), F.array(*[F.col(f"`{c}`") for c in OUTPUTS[name]]))
        parts.append(rows.select(F.lit(name).alias("pipeline"), *keys, ROW, cells.alias("cells")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def summary_rows(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """PK summary rows of many tables from recorded answers, before their cleanup."""
    return assembled_rows("pk_summary", decisions, keys)

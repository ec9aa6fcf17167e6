"""Structured values out of free text and JSON. Everything stays inside the row: no line is
shuffled, so one huge document costs no more than its own text."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from firn import schemas as K
from firn.functions.scalars import fixed_text


def strip(c) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# ---- scenario text -------------------------------------------------------------------------

# Patterns and default strengths of the scenario words.
TEMPERATURE = r"([+-]?\d+(?:\.\d+)?)\s*°?[cf]\s*(warmer|colder)"
RAIN = r"(\d+(?:\.\d+)?)%\s*(more|less|increase|decrease)\s*(?:precipitation|rain|snow)"
PHASE_ONI = 1.5
KEYWORD_DEGREES = 1.0
KEYWORD_WET, KEYWORD_DRY = 1.2, 0.8


def parse_scenarios(df: DataFrame, text="text") -> DataFrame:
    """Name, parameters, phase and category of every scenario text.

    An explicit number wins over a keyword; the last group found names the category.
    """
    low = F.lower(text)
    has = lambda word: low.contains(word)
    degrees = F.regexp_extract(low, TEMPERATURE, 1).try_cast("double")
    percent = F.regexp_extract(low, RAIN, 1).try_cast("double")
    colder = F.regexp_extract(low, TEMPERATURE, 2) == "colder"
    less = F.regexp_extract(low, RAIN, 2).isin("less", "decrease")
    found = df.withColumns({
        "__phase": F.when(has("el niño"), "El Niño").when(has("la niña"), "La Niña"),
        "__degrees": F.when(colder, -degrees).otherwise(degrees),
        "__percent": F.when(less, -percent).otherwise(percent),
        "__word_t": F.when(has("warm"), KEYWORD_DEGREES).when(has("cold"), -KEYWORD_DEGREES),
        "__word_p": F.when(has("wet"), KEYWORD_WET).when(has("dry"), KEYWORD_DRY),
    })
    t = F.coalesce("__degrees", "__word_t")
    p = F.coalesce(1 + F.col("__percent") / 100, "__word_p")
    oni = F.when(F.col("__phase") == "El Niño", PHASE_ONI).when(
        F.col("__phase") == "La Niña", -PHASE_ONI)
    used_t = F.col("__degrees").isNull() & F.col("__word_t").isNotNull()
    used_p = F.col("__percent").isNull() & F.col("__word_p").isNotNull()
    category = (
        F.when(used_p, "weather").when(used_t, "climate")
        .when(F.col("__percent").isNotNull(), "weather")
        .when(F.col("__degrees").isNotNull(), "climate")
        .when(F.col("__phase").isNotNull(), "enso").otherwise("custom"))
    found = found.withColumns({"__t": t, "__p": p, "__oni": oni, "category": category})
    change = (F.col("__p") - 1) * 100
    name = F.concat_ws(
        " ", "__phase",
        F.concat(F.abs("__t").cast("string"), F.lit("°"),
                 F.when(F.abs("__t") < 10, "C").otherwise("F"), F.lit(" "),
                 F.when(F.col("__t") > 0, "warmer").otherwise("colder")),
        F.concat(fixed_text(F.abs(change), 0), F.lit("% "),
                 F.when(change > 0, "more").otherwise("less"), F.lit(" precipitation")))
    parameters = F.map_filter(
        F.create_map(
            F.lit("oni"), F.col("__oni"), F.lit("temperature_adjustment"), F.col("__t"),
            F.lit("precipitation_multiplier"), F.col("__p")),
        lambda k, v: v.isNotNull())
    return found.select(
        *df.columns, F.when(name == "", "Custom Scenario").otherwise(name).alias("name"),
        F.lower(text).alias("description"), parameters.alias("parameters"),
        F.col("__phase").alias("phase"), "category")


# ---- JSON inside text ----------------------------------------------------------------------

def outer_json(text) -> Column:
    """From the first opening to the last closing brace, NULL unless that is valid JSON."""
    cut = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(cut).isNotNull(), cut)


def extract_json(df: DataFrame, text="text", schema=None, name="json") -> DataFrame:
    """The JSON text, or with a schema the parsed struct."""
    found = outer_json(text)
    return df.withColumn(name, F.from_json(found, schema) if schema is not None else found)


def key_values(text, pair=",", sep="=") -> Column:
    """`k=v, k=v` as a map; parts without the sign are dropped, a repeated key keeps its last value."""
    parts = F.filter(F.split(text, pair), lambda x: F.instr(x, sep) > 0)
    both = F.transform(parts, lambda x: F.struct(
        strip(F.substring_index(x, sep, 1)).alias("k"),
        strip(F.substr(x, F.instr(x, sep) + 1)).alias("v")))
    keys = F.array_distinct(F.transform(both, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(
        F.filter(both, lambda e: e["k"] == k), -1)["v"]))


def parameters_of(text) -> Column:
    """A JSON object as a map of texts, or `k=v` pairs where it is no JSON."""
    parsed = F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, "map<string,string>"))
    return F.coalesce(parsed, key_values(text))


# ---- labelled sections ---------------------------------------------------------------------

def _starts(line, label):
    return line.startswith(f"{label}:") | line.startswith(f"{label.upper()}:")


def _with_label(label):
    """A one-argument test, because array functions read a second argument as the index."""
    return lambda x: _starts(F.regexp_replace(x, r"^\s+", ""), label)


def _any_of(line, labels):
    return reduce(lambda a, b: a | b, [_starts(line, x) for x in labels], F.lit(False))


def _value(line):
    return strip(F.substr(line, F.instr(line, ":") + 1))


def labelled_fields(df: DataFrame, text="text", fields=(), sections=(), lower=()) -> DataFrame:
    """`Label: value` lines as columns and the lines below a section label as arrays.

    A repeated field keeps its last value; a field line does not end the section around it.
    """
    name = lambda label: label.lower().replace(" ", "_")
    lines = F.transform(F.split(text, "\n"), strip)
    out = {}
    for label in fields:
        hits = F.filter(lines, _with_label(label))
        value = _value(F.try_element_at(hits, F.lit(-1)))
        out[name(label)] = F.lower(value) if label in lower else value
    if sections:
        marks = "|".join(f"{s}|{s.upper()}" for s in sections)
        blocks = F.split(text, rf"(?md)^\s*(?=(?:{marks}):)")
        labels = [*fields, *sections]
        for label in sections:
            own = F.filter(blocks, _with_label(label))
            body = F.flatten(F.transform(own, lambda b: F.transform(
                F.slice(F.split(b, "\n"), F.lit(2), F.size(F.split(b, "\n"))), strip)))
            out[name(label)] = F.filter(
                body, lambda x: (x != "") & ~x.startswith(":") & ~_any_of(x, labels))
    return df.withColumns(out)


def labelled_records(df: DataFrame, starts, fields, text="text", lower=()) -> DataFrame:
    """One numbered row per record: every start label opens one, its fields follow below it.

    `record` names the start label; text before the first one is dropped.
    """
    marks = "|".join(f"{s}|{s.upper()}" for s in starts)
    blocks = F.filter(F.split(text, rf"(?md)^\s*(?=(?:{marks}):)"), lambda b: _any_of(
        F.regexp_replace(b, r"^\s+", ""), starts))
    rows = df.select("*", F.posexplode(blocks).alias("__at", "__block"))
    named = F.coalesce(*[F.when(_with_label(s)(F.col("__block")), s) for s in starts])
    rows = rows.withColumns({"part": F.col("__at") + 1, "record": named})
    return labelled_fields(rows, "__block", fields, (), lower).drop("__at", "__block")


# Record and field labels of suggestion and quality texts.
FEATURE_RECORDS = (("Feature",), ("Feature", "Description", "Implementation", "Importance", "Category"))
MODEL_RECORDS = (("Model",), ("Model", "Parameters", "Rationale", "Performance", "Complexity"))
QUALITY_RECORDS = (("Issue", "Suggestion"), ("Severity", "Description", "Action"))

EXPLANATION_FIELDS = ("Summary", "Confidence", "Risk", "Water Managers", "Ski Resorts",
                      "Agriculture", "Flood Control", "General Public")
EXPLANATION_SECTIONS = ("Drivers", "Recommendations")


def pipe_rows(lines, names, minimum=3) -> Column:
    """`a|b|c` lines as structs; lines with fewer than `minimum` parts are dropped."""
    parts = F.filter(F.transform(lines, lambda x: F.split(x, r"\|")), lambda p: F.size(p) >= minimum)
    return F.transform(parts, lambda p: F.struct(*[
        F.coalesce(strip(F.try_element_at(p, F.lit(i + 1))), F.lit("")).alias(n)
        for i, n in enumerate(names)]))


def driver_rows(lines) -> Column:
    """`feature|importance|direction|description`; an importance that is no number is 0."""
    rows = pipe_rows(lines, ("feature", "importance", "direction", "description"))
    number = lambda x: F.when(x.rlike(r"^[0-9.]+$"), x.try_cast("double"))
    return F.transform(rows, lambda r: F.struct(
        r["feature"].alias("feature"),
        F.coalesce(number(r["importance"]), F.lit(0.0)).alias("importance"),
        r["direction"].alias("direction"), r["description"].alias("description")))


def parse_explanations(df: DataFrame, text="text") -> DataFrame:
    found = labelled_fields(df, text, EXPLANATION_FIELDS, EXPLANATION_SECTIONS, ("Confidence", "Risk"))
    return found.withColumns({
        "confidence": F.coalesce("confidence", F.lit("medium")),
        "risk": F.coalesce("risk", F.lit("normal")),
        "drivers": driver_rows("drivers")})


def split_sections(df: DataFrame, marker: str, text="text") -> DataFrame:
    """One numbered row per part after each marker; the part before the first one is dropped."""
    parts = F.split(text, rf"\Q{marker}\E")
    rest = F.slice(parts, F.lit(2), F.size(parts))
    return df.select("*", F.posexplode(rest).alias("__at", "__part")).select(
        *df.columns, (F.col("__at") + 1).alias("part"), strip("__part").alias("part_text"))


# ---- forecast documents --------------------------------------------------------------------

RISK_LEVELS = ("Low", "Moderate", "High", "Critical")
_IMPACT = "struct<riskLevel: string, summary: string>"
FORECAST_DOCUMENT = (
    "struct<summary: string, category: string, predictedTemp: double, precip: double, pct: double, "
    f"snow: double, waterAllocation: {_IMPACT}, wildfireRisk: {_IMPACT}, "
    "seasonPhases: array<struct<id: string, label: string, months: string, category: string, "
    "predictedTemp: double, precip: double, pct: double, snow: double, summary: string>>, "
    "trajectory: array<struct<month: string, precip: double, snow: double>>, "
    "details: array<struct<name: string, precip: double, normal: double, snow: double, risks: string>>>"
)


def _filled(c):
    return c.isNotNull() & (strip(c) != "")


def contract_errors(df: DataFrame, text="text") -> DataFrame:
    """`valid` and `first_error` of every forecast document."""
    doc = F.from_json(outer_json(text), FORECAST_DOCUMENT)
    d = df.withColumn("__doc", doc)
    phases = F.transform("__doc.seasonPhases", lambda p: p["id"])
    regions = F.transform("__doc.details", lambda r: r["name"])
    wanted = lambda xs: F.array(*[F.lit(x) for x in xs])
    impact = lambda f: F.coalesce(
        F.col(f"__doc.{f}.riskLevel").isin(*RISK_LEVELS) & _filled(F.col(f"__doc.{f}.summary")),
        F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    error = (
        F.when(F.col("__doc").isNull(), "no_json")
        .when(~yes((F.size("__doc.trajectory") == len(K.MONTH_NAMES))
                   & (F.size("__doc.details") == len(K.REGIONS))), "incomplete_forecast")
        .when(~yes(phases == wanted([p[0] for p in K.SEASON_PHASES])), "incomplete_phases")
        .when(~yes((regions == wanted([r[4] for r in K.REGIONS]))
                   & F.forall("__doc.details", lambda r: _filled(r["risks"]))), "incomplete_regions")
        .when(~(impact("waterAllocation") & impact("wildfireRisk")), "incomplete_impacts"))
    return d.withColumn("first_error", error).withColumn(
        "valid", F.col("first_error").isNull()).drop("__doc")

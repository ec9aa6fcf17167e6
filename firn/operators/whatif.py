"""What-if analysis: all scenarios of a table in one job.

Rows carry a `scenario` struct (see `joins.fan_out`); its numbers are a map, so one plan serves
every scenario and nothing loops on the driver.
"""

from pyspark.sql import DataFrame, functions as F

from firn.functions.rules import scenario_summary
from firn.functions.scalars import numeric_columns, text_columns
from firn.operators.joins import fan_out

# How the second index follows the first, and the snow-line factor.
SECOND_INDEX_SHARE = 0.8
SNOW_LINE_SCALE, SNOW_LINE_FLOOR = 10_000, 0.5


def parameter_names(scenarios) -> set:
    """The parameters that any scenario of the list sets."""
    return {name for s in scenarios for name in s[2]}


def can_move(col, names, columns) -> bool:
    """Whether a scenario with these parameters can change the numeric column `col`."""
    return (
        col in names or "temperature" in col.lower() and "temperature_adjustment" in names
        or "precipitation" in col.lower() and "precipitation_multiplier" in names
        or col == "nino34" and "oni" in names and "oni" not in columns
        or col in ("snow_line", "swe") and "snow_line_elevation" in names)


def applied_columns(df: DataFrame, names=None) -> dict:
    """{column: value under the scenario} for the columns a scenario can move.

    Order: direct values, then shifts, multipliers, index, phase and snow line. With `names`,
    the parameters in use, columns that none of them can move are left out and so keep their
    type; a moved column is a double.
    """
    numbers = F.col("scenario.parameters")
    out = {}
    for c in numeric_columns(df):
        if names is not None and not can_move(c, names, df.columns):
            continue
        direct, old = numbers[c], F.col(c).cast("double")
        new = old + F.coalesce(direct, F.lit(0.0)) if c == "temperature" else F.coalesce(direct, old)
        if "temperature" in c.lower():
            new = new + F.coalesce(numbers["temperature_adjustment"], F.lit(0.0))
        if "precipitation" in c.lower():
            new = new * F.coalesce(numbers["precipitation_multiplier"], F.lit(1.0))
        if c == "nino34" and "oni" not in df.columns:
            new = F.coalesce(numbers["oni"] * SECOND_INDEX_SHARE, new)
        lift = numbers["snow_line_elevation"]
        if c == "snow_line":
            new = new + F.coalesce(lift, F.lit(0.0))
        if c == "swe":
            factor = F.greatest(F.lit(SNOW_LINE_FLOOR), 1 - lift / SNOW_LINE_SCALE)
            new = F.when(lift > 0, new * factor).otherwise(new)
        out[c] = new
    if "enso_phase" in df.columns:
        out["enso_phase"] = moved_text(F.lit("enso_phase"), F.col("enso_phase"))
    return out


def moved_text(column, value):
    """What a scenario makes of one value of the text column `column` (its name as a Column)."""
    phase = F.col("scenario.phase")
    return F.when((column == "enso_phase") & phase.isNotNull(), phase).otherwise(value)


def apply_scenario(df: DataFrame, names=None) -> DataFrame:
    """The same rows with the scenario's values in place; `names` as in `applied_columns`."""
    return df.withColumns(applied_columns(df.drop("scenario"), names))


def apply_scenarios(df: DataFrame, scenarios) -> DataFrame:
    """Every row once per scenario with its values in place; untouched columns stay as they are."""
    return apply_scenario(fan_out(df, scenarios), parameter_names(scenarios))


def beside(df: DataFrame, suffix="_scenario") -> DataFrame:
    """Original and scenario values next to each other."""
    moved = applied_columns(df.drop("scenario"))
    return df.withColumns({f"{c}{suffix}": v for c, v in moved.items()})


def mean_predictor(df: DataFrame, target="swe", name="prediction") -> DataFrame:
    """Stand-in without a model: the mean of the target, 0 where there is no target."""
    if target not in df.columns:
        return df.withColumn(name, F.lit(0.0))
    return df.withColumn(name, df.agg(F.avg(target)).scalar())


def impact_columns(original, changed) -> dict:
    """Level and spread of both predictions and the change of the mean (population deviations)."""
    o, s = F.avg(original), F.avg(changed)
    ends = {
        f"{kind}_{side}": fn(c).cast("double")
        for kind, fn in (("min", F.min), ("max", F.max), ("std", F.stddev_pop))
        for side, c in (("original", original), ("scenario", changed))
    }
    return {
        "mean_original": o, "mean_scenario": s, "absolute_change": s - o,
        "percentage_change": F.when(o == 0, 0.0).otherwise((s - o) / o * 100), **ends,
    }


def impact(df: DataFrame, original, changed, *by) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in impact_columns(original, changed).items()])


def comparison_columns(original, changed) -> dict:
    d = F.col(changed) - F.col(original)
    spread = F.var_pop(original)
    return {
        "rmse": F.sqrt(F.avg(d * d)), "mae": F.avg(F.abs(d)),
        "r_squared": F.when(spread == 0, 0.0).otherwise(1 - F.avg(d * d) / spread),
    }


def comparison(df: DataFrame, original, changed, *by) -> DataFrame:
    """RMSE, MAE and R2 of the scenario against the original; R2 is 0 without spread."""
    return df.groupBy(*by).agg(*[
        c.alias(n) for n, c in comparison_columns(original, changed).items()])


def change_log(fanned: DataFrame) -> DataFrame:
    """(scenario, column, before, after) for every column whose mean or value set moved."""
    base = fanned.drop("scenario")
    moved = applied_columns(base)
    nums = [c for c in numeric_columns(base) if c in moved]
    wide = fanned.select("scenario", *nums, *[moved[c].alias(f"{c}__new") for c in nums]).groupBy(
        F.col("scenario.name").alias("scenario")).agg(
        *[x for c in nums for x in (F.avg(c).alias(f"{c}__before"), F.avg(f"{c}__new").alias(f"{c}__after"))])
    structs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__before").alias("before"),
                 F.col(f"{c}__after").alias("after")) for c in nums])
    return wide.select("scenario", F.explode(structs).alias("m")).select("scenario", "m.*").where(
        "before <> after")


def text_change_log(base: DataFrame, scenarios, cols=None) -> DataFrame:
    """(scenario, column_name, value, change): values a scenario takes out of or brings into a text column.

    One pass over the rows: every text column (or those of `cols`) as (column, value) pairs,
    made distinct map-side before they shuffle. Only distinct pairs meet the scenarios, and one
    grouping says on which side each value stands, so no two tables are joined. An unknown
    value counts as a value. A table without rows or text columns gives no rows.
    """
    cols = text_columns(base, ("scenario",)) if cols is None else [cols] if isinstance(cols, str) else list(cols)
    wide = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    wide = wide.cast("array<struct<column_name:string,value:string>>")
    pairs = base.select(F.explode(wide).alias("p")).select("p.*").distinct()
    after = moved_text(F.col("column_name"), F.col("value"))
    sides = F.array(F.struct(F.col("value"), F.lit(True).alias("before")), F.struct(after.alias("value"), F.lit(False).alias("before")))
    name = F.col("scenario.name").alias("scenario")
    placed = fan_out(pairs, scenarios).where(~after.eqNullSafe(F.col("value")) | F.col("scenario.phase").isNotNull()).select(
        name, "column_name", F.explode(sides).alias("s")).select("scenario", "column_name", "s.*")
    known = placed.groupBy("scenario", "column_name", "value").agg(
        F.bool_or("before").alias("b"), F.bool_or(~F.col("before")).alias("a"))
    return known.where("a <> b").select(
        "scenario", "value", F.when(F.col("b"), "removed").otherwise("added").alias("change"), "column_name")


def full_change_log(base: DataFrame, scenarios) -> DataFrame:
    """All changes of all scenarios in one table: numeric columns with their means before and
    after, text columns with the values they lose (`before_values`) and gain (`after_values`).

    Two passes over the rows, one per kind. The lists hold changed values only, sorted; the
    scenarios bring in at most one value each, and what they remove is the column's value list.
    """
    fanned = fan_out(base, scenarios)
    nums = change_log(fanned).select(
        "scenario", "column_name", F.lit("number").alias("kind"), "before", "after",
        *[F.lit(None).cast("array<string>").alias(f"{s}_values") for s in ("before", "after")])
    of = lambda change: F.array_sort(F.collect_list(F.when(F.col("change") == change, F.coalesce("value", F.lit("(unknown)")))))
    none = F.lit(None).cast("double")
    texts = text_change_log(base, scenarios).groupBy("scenario", "column_name").agg(
        of("removed").alias("before_values"), of("added").alias("after_values")).select(
        "scenario", "column_name", F.lit("text").alias("kind"), none.alias("before"), none.alias("after"),
        "before_values", "after_values")
    return nums.unionByName(texts)


def scenario_predictions(base: DataFrame, scenarios, model=None, target="swe") -> DataFrame:
    """Row-level predictions before and after every scenario.

    `model` is anything with `transform` that adds `prediction`; without one the mean stands in.
    """
    if model is None:
        before = mean_predictor(base, target, "original_prediction")
        moved = apply_scenarios(before, scenarios)
        if target not in base.columns:
            return moved.withColumn("prediction", F.lit(0.0))
        moved = moved.withColumn("__name", F.col("scenario.name"))
        # One mean per scenario of the given list, so the broadcast has as many rows as the list.
        means = moved.groupBy("__name").agg(F.avg(target).alias("prediction"))
        return moved.join(F.broadcast(means), "__name", "left").drop("__name")
    before = model.transform(base).withColumnRenamed("prediction", "original_prediction")
    before = before.select(*base.columns, "original_prediction")
    return model.transform(apply_scenarios(before, scenarios))


def scenario_means(base: DataFrame, scenarios, target="swe") -> DataFrame:
    """(scenario, mean before, mean after): the mean predictor as one row per scenario, 0 without a target."""
    name = F.col("scenario.name").alias("__name")
    if target not in base.columns:
        return fan_out(base, scenarios).groupBy(name).agg(
            F.lit(0.0).alias("original_prediction"), F.lit(0.0).alias("prediction"))
    kept = base.select(target, F.col(target).cast("double").alias("__old"), *[
        c for c in base.columns if c == "oni" and c != target])  # how nino34 moves depends on oni
    moved = apply_scenarios(kept, scenarios)
    return moved.groupBy(name).agg(F.avg("__old").alias("original_prediction"), F.avg(target).alias("prediction"))


def compare_scenarios(base: DataFrame, scenarios, model=None, target="swe") -> DataFrame:
    """One row per scenario: impact, comparison metrics and a summary text.

    Without a model every row of a scenario has the same prediction, so one row per scenario
    with both means stands for all of them and the rows are fanned out and read once.
    """
    if model is None:
        rows = scenario_means(base, scenarios, target)
    else:
        rows = scenario_predictions(base, scenarios, model, target).select(
            F.col("scenario.name").alias("__name"), "original_prediction", "prediction")
    measures = impact_columns("original_prediction", "prediction") | comparison_columns(
        "original_prediction", "prediction")
    measured = rows.groupBy("__name").agg(*[c.alias(n) for n, c in measures.items()])
    joined = measured.join(F.broadcast(scenario_table(base, scenarios)), "__name")
    return joined.withColumn(
        "summary", scenario_summary("__name", "percentage_change", "parameters", "category", target)
    ).withColumnRenamed("__name", "scenario")


def scenario_table(df: DataFrame, scenarios) -> DataFrame:
    from firn.schemas import SCENARIO_SCHEMA

    return df.sparkSession.createDataFrame(list(scenarios), SCENARIO_SCHEMA).withColumnRenamed(
        "name", "__name").select("__name", "parameters", "phase", "category")


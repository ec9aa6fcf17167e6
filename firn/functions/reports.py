"""Reports per audience: fixed lines, with the wording picked by the sign and the size of the change."""

from pyspark.sql import Column, DataFrame, functions as F

from firn.functions.rules import BAND
from firn.functions.scalars import fixed_text, python_signed_text

DEFAULT_AUDIENCE = "water_managers"

# Title, opening and closing words per audience; {p}, {b}, {c} are filled per row.
FRAMES = {
    "water_managers": ("Water supply forecast", "reservoir operators"),
    "ski_resorts": ("Ski season forecast", "resort operators"),
    "agriculture": ("Irrigation water forecast", "growers and water districts"),
}

# Per audience: (line label, text above the band, inside it, below it).
LINES = {
    "water_managers": (
        ("Supply", "reliable, snowpack well above average", "close to average", "at risk, snowpack well below average"),
        ("Reservoirs", "plan normal to high releases", "keep normal operations", "hold back releases"),
        ("First step", "make room for large inflow", "keep the usual schedule", "start conservation now"),
        ("Second step", "tell users about the good outlook", "keep users informed as usual", "prepare a drought plan"),
        ("Third step", *["measure the growth of the snowpack every week"] * 3),
        ("Fourth step", *["agree on plans with the agencies of the region"] * 3),
        ("Timeline", *["review operations now, carry out the steps within a week, check the forecast after a month"] * 3),
    ),
    "ski_resorts": (
        ("Snow year", "strong", "typical", "weak"),
        ("Season length", "likely extended", "normal", "likely shorter, early closure possible"),
        ("Snow depth", "above average", "average", "below average"),
        ("Snow quality", "excellent", "good", "variable, snowmaking may be needed"),
        ("Visitors", "very satisfied guests", "satisfied guests as usual", "less satisfied guests are possible"),
        ("First step", "promote the season", "keep the usual marketing", "plan snowmaking and discounts"),
        ("Second step", "staff a longer season", "keep the usual plan", "prepare for early closure"),
        ("Third step", *["watch the weather every week"] * 3),
        ("Fourth step", *["plan together with tourism partners of the region"] * 3),
        ("Timeline", *["adjust marketing now, decide on seasonal staff within two weeks, on pass prices within a month"] * 3),
    ),
    "agriculture": (
        ("Growing season", "more water than on average", "an average amount of water", "less water than on average"),
        ("Irrigation water", "adequate to abundant", "adequate", "limited"),
        ("Schedules", "normal to longer", "normal", "fewer allocations to be expected"),
        ("Crops", "water-intensive crops are possible", "keep the usual mix", "prefer drought-tolerant crops"),
        ("Water cost", "stable or lower", "stable", "may rise"),
        ("First step", "use full irrigation capacity", "keep the usual schedule", "prepare reduced irrigation"),
        ("Second step", "think of more land for thirsty crops", "keep the present crops", "change to crops that bear drought"),
        ("Third step", *["measure the soil's moisture regularly"] * 3),
        ("Fourth step", *["ask the water districts about allocations"] * 3),
        ("Timeline", *["review plans now, decide on planting within a month, on irrigation within three"] * 3),
    ),
}

# Per audience: (line label, text above the average, text otherwise); these follow the lines of the band.
SIGN_LINES = {
    "water_managers": (
        ("Snowpack year", "above average", "below average"),
        ("Drought", "standard monitoring", "more conservation is advised"),
    ),
}


def _band3(pct, above, inside, below) -> Column:
    return F.when(pct > BAND, above).when(pct < -BAND, below).otherwise(inside)


def report_text(audience: str, predicted, baseline, pct, confidence, risk) -> Column:
    """The whole report as one text column. Unknown audiences get the water report."""
    audience = audience if audience in FRAMES else DEFAULT_AUDIENCE
    title, readers = FRAMES[audience]
    change = F.coalesce(F.col(pct), F.lit(0.0))
    base = F.coalesce(F.col(baseline), F.col(predicted))
    lines = [
        F.lit(f"{title} for {readers}"),
        F.concat(F.lit("Forecast: "), fixed_text(predicted), F.lit(" inches, "),
                 python_signed_text(change), F.lit("% against the average of "), fixed_text(base),
                 F.lit(" inches")),
        F.concat(F.lit("Confidence: "), F.col(confidence), F.lit(", risk: "), F.col(risk)),
        *[F.concat(F.lit(f"{label}: "), _band3(change, a, i, b)) for label, a, i, b in LINES[audience]],
        *[F.when(change > 0, f"{label}: {a}").otherwise(f"{label}: {b}") for label, a, b in SIGN_LINES.get(audience, ())],
    ]
    return F.concat_ws("\n", *lines)


def audience_reports(df: DataFrame, audiences=tuple(FRAMES), predicted="predicted_value",
                     baseline="baseline_value") -> DataFrame:
    """One row per forecast and audience, by exploding a fixed array of reports."""
    reports = F.array(*[
        F.struct(F.lit(a).alias("audience"), report_text(
            a, predicted, baseline, "change_percentage", "confidence", "risk_level").alias("report"))
        for a in audiences
    ])
    return df.withColumn("__r", F.explode(reports)).select(
        *df.columns, F.col("__r.audience").alias("audience"), F.col("__r.report").alias("report"))

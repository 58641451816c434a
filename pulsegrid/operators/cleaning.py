"""Row-level cleaning of raw bars, its log and its per-file summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.config import CleaningRules
from pulsegrid.functions import scalars as S

PRICES = ("Open", "High", "Low", "Latest")


def _invalid_reasons():
    price = [F.col(c) for c in PRICES]
    o, h, l, x = price
    consistent = (h >= o) & (h >= l) & (h >= x) & (l <= o) & (l <= h) & (l <= x)
    checks = {
        "bad_datetime": F.col("Time").isNull(),
        "missing_core_fields": reduce(
            lambda a, b: a | b, [c.isNull() for c in price + [F.col("Volume")]]
        ),
        "nonpositive_price": reduce(lambda a, b: a | b, [S.holds(c <= 0) for c in price]),
        "negative_volume": S.holds(F.col("Volume") < 0),
        "ohlc_inconsistency": ~S.holds(consistent),
    }
    return F.concat_ws(";", *[F.when(c, F.lit(name)) for name, c in checks.items()])


def classify_rows(decoded: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Every decoded data line with the reason it is dropped (``reason``) or NULL when it is kept.

    Order of the checks: parse, core fields, repeated time, one-bar spike. Neighbours of a bar are
    looked up inside its own file and UTC day, since a spike needs both on the same day; a day holds
    a bounded number of bars once repeated times are resolved.
    """
    rows = decoded.withColumn("Time", S.wall_to_utc(F.col("wall_time"), rules.raw_zone))
    rows = rows.withColumn(
        "core_reason",
        F.when(~F.col("parse_ok"), F.lit("parse_failed")).otherwise(
            F.nullif(_invalid_reasons(), F.lit(""))
        ),
    )
    # Only repeated times need the second look, so the copies side stays as small as their number.
    good = F.col("core_reason").isNull()
    repeated = (
        rows.groupBy("file_name", "Time")
        .agg(F.max(F.when(good, F.col("raw_line_no"))).alias("kept_line"), F.count_if(good).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    rows = rows.join(repeated, ["file_name", "Time"], "left")
    is_copy = good & S.holds(F.col("raw_line_no") < F.col("kept_line"))
    rows = rows.withColumn(
        "core_reason", F.when(is_copy, F.lit("duplicate_timestamp")).otherwise(F.col("core_reason"))
    )
    # Rows already dropped share the exchange but are spread by line, away from the days of good bars.
    rows = rows.withColumns(
        {
            "day": F.when(good, F.to_date("Time")),
            "spread": F.when(good, F.lit(-1)).otherwise(F.pmod("raw_line_no", F.lit(1024)).cast("int")),
        }
    )
    near = Window.partitionBy("file_name", "day", "spread").orderBy("Time", "raw_line_no")
    rows = rows.withColumns(
        {
            "p0": F.lag("Latest").over(near),
            "p2": F.lead("Latest").over(near),
            "t0": F.lag("Time").over(near),
            "t2": F.lead("Time").over(near),
        }
    )
    middle = (F.col("p0") + F.col("p2")) / 2
    jump_in = F.log("Latest") - F.log("p0")
    jump_out = F.log("p2") - F.log("Latest")
    spike = S.holds(
        good
        & (S.minutes_between(F.col("t0"), F.col("Time")) <= rules.spike_gap_minutes)
        & (S.minutes_between(F.col("Time"), F.col("t2")) <= rules.spike_gap_minutes)
        & (F.greatest(S.ratio(F.col("Latest"), middle), S.ratio(middle, F.col("Latest"))) >= rules.spike_ratio)
        & (F.abs(jump_in) >= rules.spike_log_jump)
        & (F.abs(jump_out) >= rules.spike_log_jump)
        & (F.signum(jump_in) != F.signum(jump_out))
    )
    return rows.select(
        "file_name", "raw_line_no", "time_text", "Time", *PRICES, "Volume",
        F.when(spike, F.lit("one_bar_price_spike")).otherwise(F.col("core_reason")).alias("reason"),
    )


def clean_bars(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reason").isNull()).select(
        F.col("file_name").alias("file_name_clean"), "Time", *PRICES, "Volume"
    )


def cleaning_log(classified: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Dropped rows with their reasons, and thin-volume rows that are only flagged."""
    thin = F.col("reason").isNull() & (F.col("Volume") <= rules.low_volume)
    late = F.col("reason").isin("duplicate_timestamp", "one_bar_price_spike") | thin
    return classified.where(F.col("reason").isNotNull() | thin).select(
        "file_name",
        "raw_line_no",
        F.when(F.col("reason") == "parse_failed", F.lit(""))
        .when(S.holds(late), F.date_format("Time", "yyyy-MM-dd HH:mm"))
        .otherwise(F.col("time_text"))
        .alias("time_ref"),
        F.when(thin, F.lit("flagged_only")).otherwise(F.lit("dropped")).alias("action"),
        F.when(thin, F.lit("low_volume")).otherwise(F.col("reason")).alias("reason"),
    )


def cleaning_summary(
    classified: DataFrame, bounds: DataFrame, rules: CleaningRules = CleaningRules()
) -> DataFrame:
    """Counts per file and stage; files without data lines keep a row of zeros."""
    reason = F.col("reason")
    kept = reason.isNull()
    staged = ("parse_failed", "duplicate_timestamp", "one_bar_price_spike")
    counts = classified.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_raw_rows"),
        F.count_if(reason == "parse_failed").alias("n_parse_failed"),
        F.count_if(~reason.isin(*staged)).alias("n_invalid_core_dropped"),
        F.count_if(reason == "duplicate_timestamp").alias("n_duplicate_ts_dropped"),
        F.count_if(reason == "one_bar_price_spike").alias("n_spike_rows_dropped"),
        F.count_if(kept & (F.col("Volume") <= rules.low_volume)).alias("n_lowvol_flagged"),
        F.count_if(kept).alias("n_clean_rows"),
        F.min(F.when(kept, F.col("Time"))).alias("first_time_clean"),
        F.max(F.when(kept, F.col("Time"))).alias("last_time_clean"),
    )
    numbers = [c for c in counts.columns if c.startswith("n_")]
    return bounds.select("file_name", "footer_present").join(counts, "file_name", "left").select(
        "file_name",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers],
        "footer_present",
        "first_time_clean",
        "last_time_clean",
    )

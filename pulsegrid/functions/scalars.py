"""Column expressions shared by the operators. Missing values are NULL, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.config import HIKES_FROM, PURCHASES_FROM


def known(x: Column) -> Column:
    """NULL instead of NaN or infinity."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def holds(cond: Column) -> Column:
    """A comparison with a missing side does not hold."""
    return F.coalesce(cond, F.lit(False))


def positive_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def ratio(num: Column, den: Column) -> Column:
    """num / den for a positive denominator, else missing."""
    return F.when(den > 0, num / den)


def row_mean(cols: list[Column]) -> Column:
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("double") for c in cols])
    return F.when(count > 0, total / count)


def to_number(text: Column) -> Column:
    """Text to number; NULL when it does not parse."""
    return known(F.trim(text).try_cast("double"))


def decorated_number(text: Column) -> Column:
    """Number written with thousands separators, percent signs or quotes."""
    return to_number(F.regexp_replace(text, '[,%"]', ""))


def to_flag(text: Column) -> Column:
    return holds(F.lower(F.trim(text)).isin("true", "1"))


def clock_to_interval(text: Column) -> Column:
    """HH:mm text to a day-time interval."""
    parts = F.split(F.trim(text), ":")
    hours = F.get(parts, F.lit(0)).try_cast("double")
    minutes = F.get(parts, F.lit(1)).try_cast("double")
    return F.when(
        hours.isNotNull() & minutes.isNotNull(),
        F.make_dt_interval(
            F.lit(0), hours.cast("int"), minutes.cast("int"), F.lit(0).cast("decimal(18,6)")
        ),
    )


def minutes_between(start: Column, end: Column) -> Column:
    """Whole-second difference in minutes, for zone-neutral timestamps."""
    return F.timestamp_diff("SECOND", start, end) / F.lit(60.0)


def shift_minutes(ts: Column, minutes: Column | int) -> Column:
    amount = F.lit(minutes) if isinstance(minutes, int) else minutes
    return F.timestamp_add("MINUTE", amount.cast("int"), ts)


def wall_to_utc(ts: Column, zone: str) -> Column:
    """Wall clock of an IANA zone to UTC.

    A clock time that occurs twice takes the earlier offset, one that is skipped moves forward.
    """
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def regime_flags(day: Column) -> dict[str, Column]:
    return {
        "regime_pre_app": (day < F.lit(PURCHASES_FROM)).cast("double"),
        "regime_app": ((day >= F.lit(PURCHASES_FROM)) & (day < F.lit(HIKES_FROM))).cast("double"),
        "regime_hike": (day >= F.lit(HIKES_FROM)).cast("double"),
    }


def surprise_columns(target: Column, scale: float = 10.0) -> dict[str, Column]:
    """Scaled surprise with its size, positive part and negative magnitude."""
    unit = target / F.lit(scale)
    return {
        "shock_target_10bp": unit,
        "abs_shock_target_10bp": F.abs(unit),
        "shock_pos_10bp": F.greatest(unit, F.lit(0.0)),
        "shock_neg_10bp": F.greatest(-unit, F.lit(0.0)),
    }


def truncated_cubic_basis(q: Column, knots: list[Column]) -> list[Column]:
    return [F.pow(F.greatest(q - k, F.lit(0.0)), 3) for k in knots]


def optional(df: DataFrame, name: str, kind: str = "double") -> Column:
    """The column when it is there, a typed missing value otherwise."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def require_columns(df: DataFrame, names: list[str], label: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{label}: missing columns {', '.join(missing)}")
    return df

"""Surprise series per event date."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.functions.timeparse import parse_dates
from pulsegrid.sources.calendar import find_column

# Accepted names, prefix, maturities and path averages.
DATE_NAMES = (
    "event_date",
    "date",
    "meeting_date",
    "meetingday",
    "meeting_day",
    "govc_date",
    "eventday",
    "date_meeting",
)
PREFIX = "eampd_"
MATURITIES = ("1m", "3m", "6m", "1y", "2y", "3y", "4y", "5y", "10y")
LONG_PATH = ("2y", "3y", "5y")
MEDIUM_PATH = ("6m", "1y", "2y")
MIN_PARSED = 3
MIN_PARSED_SHARE = 0.5


def normal_name(name: str) -> str:
    text = re.sub(f"^{PREFIX}", "", name.lower())
    return re.sub(r"[^a-z0-9]+", "_", text).strip("_")


def _valid_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


def read_surprises(spark: SparkSession, path: str) -> DataFrame:
    return build_surprises(spark.read.option("header", "true").csv(path))


def build_surprises(raw: DataFrame) -> DataFrame:
    date_name = find_column(raw.columns, DATE_NAMES)
    if date_name is None:
        raise ValueError("surprises: no date column")
    others = [c for c in raw.columns if c != date_name]
    texts = [c for c in others if dict(raw.dtypes)[c] == "string"]
    numeric = set(others) - set(texts)
    if texts:
        counts = raw.agg(
            *[F.count(S.to_number(F.col(c))).alias(f"p{i}") for i, c in enumerate(texts)],
            *[F.count_if(F.trim(F.col(c)) != "").alias(f"f{i}") for i, c in enumerate(texts)],
        ).first()
        for i, c in enumerate(texts):
            if counts[f"p{i}"] >= max(MIN_PARSED, MIN_PARSED_SHARE * counts[f"f{i}"]):
                numeric.add(c)
    rows = parse_dates(raw, date_name).where(F.col(date_name).isNotNull()).select(
        F.col(date_name).alias("event_date"),
        *[
            (S.to_number(F.col(c)) if c in texts else F.col(c).cast("double"))
            .alias(_valid_name(PREFIX + c))
            if c in numeric
            else F.col(c).alias(_valid_name(PREFIX + c))
            for c in others
        ],
        F.monotonically_increasing_id().alias("_row"),
    )
    values = [c for c in rows.columns if c not in ("event_date", "_row")]
    first = (
        rows.groupBy("event_date")
        .agg(F.min_by(F.struct(*values), "_row").alias("r"))
        .select("event_date", "r.*")
    )
    return add_maturities(first)


def add_maturities(df: DataFrame) -> DataFrame:
    """Canonical maturity columns, target and the two path averages."""
    by_name = {normal_name(c): c for c in reversed(df.columns)}
    found = {}
    for m in MATURITIES:
        names = [f"ois_{m}", f"ois{m}"] + (["ois_01m"] if m == "1m" else [])
        hit = next((by_name[n] for n in names if n in by_name), None)
        if hit:
            found[m] = f"ois_{m}_raw"
            df = df.withColumn(found[m], F.col(hit).try_cast("double"))
    if "1m" in found:
        df = df.withColumn("shock_target", F.col(found["1m"]))
    for name, members in (("mean", LONG_PATH), ("med", MEDIUM_PATH)):
        present = [F.col(found[m]) for m in members if m in found]
        if present:
            df = df.withColumn(f"shock_path_proxy_{name}", S.row_mean(present))
    return df

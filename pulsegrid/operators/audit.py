"""Audit of raw files and the coverage grid of expected contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulsegrid import config as C
from pulsegrid.functions import scalars as S
from pulsegrid.sources.bars import file_metadata


def _time_steps(rows: DataFrame, stride: int = 4096) -> DataFrame:
    """Sign counts of the time differences between consecutive dated lines of each file.

    Lines are cut into strides of line numbers, so no task holds a whole file. Differences inside a
    stride come from a window; the seams are closed from one first / last pair per stride.
    """
    dated = rows.where(F.col("wall_time").isNotNull()).withColumn(
        "stride", F.floor(F.col("raw_line_no") / stride)
    )
    inside = Window.partitionBy("file_name", "stride").orderBy("raw_line_no")
    step = F.timestamp_diff("SECOND", F.lag("wall_time").over(inside), F.col("wall_time"))
    signs = lambda s: [
        F.count_if(s > 0).alias("up"),
        F.count_if(s < 0).alias("down"),
        F.count_if(s == 0).alias("flat"),
    ]
    within = dated.withColumn("step", step)
    per_stride = within.groupBy("file_name", "stride").agg(
        *signs(F.col("step")),
        F.min_by("wall_time", "raw_line_no").alias("first_time"),
        F.max_by("wall_time", "raw_line_no").alias("last_time"),
    )
    seam = Window.partitionBy("file_name").orderBy("stride")
    jump = F.timestamp_diff("SECOND", F.lag("last_time").over(seam), F.col("first_time"))
    return (
        per_stride.withColumn("jump", jump)
        .groupBy("file_name")
        .agg(
            (F.sum("up") + F.count_if(F.col("jump") > 0)).alias("up"),
            (F.sum("down") + F.count_if(F.col("jump") < 0)).alias("down"),
            (F.sum("flat") + F.count_if(F.col("jump") == 0)).alias("flat"),
        )
    )


def audit_files(decoded: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row per raw file: structure, counts of defects, sort order, status and flags."""
    o, h, l, x = (F.col(c) for c in ("Open", "High", "Low", "Latest"))
    v = F.col("Volume")
    priced = o.isNotNull() & h.isNotNull() & l.isNotNull() & x.isNotNull()
    consistent = (h >= o) & (h >= l) & (h >= x) & (l <= o) & (l <= h) & (l <= x)
    per_time = decoded.groupBy("file_name", "wall_time").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~(priced & v.isNotNull())).alias("missing"),
        F.count_if(S.holds(o <= 0) | S.holds(h <= 0) | S.holds(l <= 0) | S.holds(x <= 0)).alias("nonpos"),
        F.count_if(S.holds(v < 0)).alias("negvol"),
        F.count_if(priced).alias("priced"),
        F.count_if(priced & ~S.holds(consistent)).alias("broken"),
    )
    dated = F.col("wall_time").isNotNull()
    counts = per_time.groupBy("file_name").agg(
        F.sum("rows").alias("n_rows"),
        F.min("wall_time").alias("first_ts"),
        F.max("wall_time").alias("last_ts"),
        F.sum(F.when(dated, F.col("rows") - 1).otherwise(0)).alias("n_duplicates"),
        F.sum(F.when(dated, 0).otherwise(F.col("rows"))).alias("n_bad_dt"),
        F.sum("missing").alias("n_missing_core"),
        F.sum("nonpos").alias("n_nonpositive_price"),
        F.sum("negvol").alias("n_negative_volume"),
        ((F.sum("priced") > 0) & (F.sum("broken") == 0)).alias("ohlc_ok"),
    )
    up, down, flat = F.col("up"), F.col("down"), F.col("flat")
    order = (
        F.when(up + down + flat == 0, "single")
        .when(down + flat == 0, "strict_ascending")
        .when(up + flat == 0, "strict_descending")
        .when(down == 0, "ascending_with_duplicates")
        .when(up == 0, "descending_with_duplicates")
        .otherwise("unsorted")
    )
    steps = _time_steps(decoded).select("file_name", order.alias("sort_order"))
    joined = (
        bounds.select("file_name", "header_ok", "footer_present")
        .join(counts, "file_name", "left")
        .join(steps, "file_name", "left")
        .withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
        .withColumn("ohlc_ok", S.holds(F.col("ohlc_ok")))
        .withColumns(file_metadata(F.col("file_name")))
    )
    checks = {
        "filename_parse_failed": ~F.col("name_ok"),
        "header_unexpected": ~F.col("header_ok"),
        "footer_missing": ~F.col("footer_present"),
        "duplicate_timestamps": F.col("n_duplicates") > 0,
        "bad_datetime": F.col("n_bad_dt") > 0,
        "missing_core_fields": F.col("n_missing_core") > 0,
        "nonpositive_price": F.col("n_nonpositive_price") > 0,
        "negative_volume": F.col("n_negative_volume") > 0,
        "timestamp_unsorted": F.col("sort_order") == "unsorted",
        "ohlc_inconsistency": ~F.col("ohlc_ok"),
        "empty": F.col("n_rows") == 0,
    }
    flags = F.concat_ws(";", *[F.when(c, F.lit(n)) for n, c in checks.items()])
    return joined.withColumn("flags", flags).withColumn(
        "status", F.when(F.col("flags") == "", "ok").otherwise("review")
    )


def coverage_grid(
    spark: SparkSession,
    manifest: DataFrame,
    roots=C.ROOTS,
    expiries=C.EXPIRIES,
    years: tuple[int, int] = C.STUDY_YEARS,
) -> DataFrame:
    """Expected root x expiry x year cells with the files found for each."""
    grid = (
        spark.range(years[0], years[1] + 1)
        .select(F.col("id").cast("double").alias("year"))
        .withColumn("root", F.explode(F.array(*[F.lit(r) for r in roots])))
        .withColumn("expiry", F.explode(F.array(*[F.lit(e) for e in expiries])))
    )
    found = manifest.groupBy(
        F.col("root_code").alias("root"),
        F.col("expiry_code").alias("expiry"),
        F.col("contract_year").alias("year"),
    ).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.array_join(F.sort_array(F.collect_list("file_name")), " | ").alias("file_name"),
    )
    n = F.coalesce(F.col("n_files"), F.lit(0))
    return grid.join(found, ["root", "expiry", "year"], "left").select(
        "root",
        "expiry",
        "year",
        n.alias("n_files"),
        F.coalesce("file_name", F.lit("")).alias("file_name"),
        F.when(n == 0, "missing").when(n == 1, "ok").otherwise("duplicate").alias("coverage_status"),
    )

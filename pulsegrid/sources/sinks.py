"""Table sinks, provenance manifests and their checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid import config as C
from pulsegrid.sources.bars import expected_clean_bars, missing_clean_files, scan_clean_bars
from pulsegrid.sources.calendar import clock_mismatches

MANIFEST_FIELDS = (
    "schema_version",
    "raw_time_zone",
    "event_time_zone",
    "analysis_time_zone",
    "cleaned_time_column",
    "status",
)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, sort_by: list[str] | None = None
) -> None:
    """Parquet keeps types; CSV uses minute timestamps and ISO dates. Sorted tables are dealt by ranges of the sort columns, so
    the files are in order one after the other."""
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", "true").option("timestampNTZFormat", "yyyy-MM-dd HH:mm")
    writer.format(fmt).save(path)


def _manifest_path(folder: str) -> str:
    return f"{folder.rstrip('/')}/manifests/clock_manifest"


def publish_cleaning(folder: str, bars: DataFrame, row_log: DataFrame, summary: DataFrame) -> None:
    """Write a cleaning run. The manifest of an earlier run is replaced by one that is not complete before any table changes,
    and the complete one is written last: a run that breaks off leaves nothing a later step accepts."""
    folder = folder.rstrip("/")
    spark = summary.sparkSession
    stale = clock_manifest(spark.createDataFrame([], "n_clean_rows long"), "running")
    stale.write.mode("overwrite").parquet(_manifest_path(folder))
    write_table(bars.withColumn("trade_date", F.to_date("Time")), f"{folder}/clean_bars", partition_by=["trade_date"])
    write_table(row_log, f"{folder}/cleaning_row_flags", "csv", sort_by=["file_name", "raw_line_no"])
    write_table(summary, f"{folder}/cleaning_file_summary", sort_by=["file_name"])
    clock_manifest(spark.read.parquet(f"{folder}/cleaning_file_summary")).write.mode("overwrite").parquet(_manifest_path(folder))


def accept_cleaning(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(bars, file summary) of a finished cleaning run; every later step begins here.

    Raises ValueError when the manifest is missing, of other clocks or not complete, and when a file the summary counts
    clean rows for has no bars. Files the summary does not know are ignored.
    """
    folder = folder.rstrip("/")
    try:
        manifest = spark.read.parquet(_manifest_path(folder))
    except AnalysisException as missing:
        raise ValueError("clock manifest is missing; run the cleaning step first") from missing
    require_clock_manifest(manifest)
    summary = spark.read.parquet(f"{folder}/cleaning_file_summary")
    bars = scan_clean_bars(spark, f"{folder}/clean_bars")
    absent = missing_clean_files(summary, bars).where("n_clean_rows > 0")
    names = [r.file_name_clean for r in absent.orderBy("file_name_clean").limit(5).collect()]
    if names:
        raise ValueError(f"clean bars are missing for {', '.join(names)}")
    return expected_clean_bars(bars, summary), summary


def require_clocks(events: DataFrame) -> DataFrame:
    """The events, if every stored UTC release is the local one in the event zone; ValueError otherwise."""
    wrong = [str(r.event_date) for r in clock_mismatches(events).select("event_date").orderBy("event_date").limit(5).collect()]
    if wrong:
        raise ValueError(f"stored UTC release differs from the local clock on {', '.join(wrong)}")
    return events


def clock_manifest(file_summary: DataFrame, status: str = "complete") -> DataFrame:
    """One row that records the clocks of a finished cleaning run."""
    return file_summary.agg(
        F.lit(C.CLOCK_SCHEMA).alias("schema_version"),
        F.lit(C.RAW_ZONE).alias("raw_time_zone"),
        F.lit(C.EVENT_ZONE).alias("event_time_zone"),
        F.lit(C.ANALYSIS_ZONE).alias("analysis_time_zone"),
        F.lit(C.TIME_COLUMN).alias("cleaned_time_column"),
        F.lit("timezone-neutral datetime displaying UTC").alias("cleaned_time_semantics"),
        F.lit(status).alias("status"),
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("n_clean_rows"), F.lit(0)).alias("n_clean_rows"),
        F.max(F.current_timestamp()).alias("generated_at_utc"),
    )


def require_clock_manifest(manifest: DataFrame) -> None:
    """Refuse inputs whose clock manifest is absent, malformed or of another kind."""
    missing = [c for c in MANIFEST_FIELDS if c not in manifest.columns]
    rows = [] if missing else manifest.select(*MANIFEST_FIELDS).limit(2).collect()
    if missing or len(rows) != 1:
        raise ValueError("clock manifest is malformed; run the cleaning step again")
    expected = (
        C.CLOCK_SCHEMA, C.RAW_ZONE, C.EVENT_ZONE, C.ANALYSIS_ZONE, C.TIME_COLUMN, "complete"
    )
    if tuple(rows[0]) != expected:
        raise ValueError("clock manifest does not match; run the cleaning step again")


DIGEST_CHUNK = 1 << 22


def file_facts(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """(path, length, sha256) of files of any size: a task opens its file in the store the path names (local, HDFS or object
    store) and hashes it piece by piece; the content is never a value of a row. Spark's reader leaves empty files out."""
    files = spark.read.format("binaryFile").load(inputs).select("path", "length")  # the content is not read
    digest = F.udf(_stream_digest, "string")
    return files.repartition("path").select("path", "length", digest("path").alias("digest"))


def _stream_digest(path: str) -> str:
    import hashlib

    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    found = hashlib.sha256()
    with store.open_input_stream(inside) as stream:
        while piece := stream.read(DIGEST_CHUNK):
            found.update(piece)
    return found.hexdigest()


def run_manifest(spark: SparkSession, inputs: list[str], parameters: dict[str, str]) -> DataFrame:
    """Key / value rows: size and SHA-256 of every input file, and the run parameters."""
    facts = file_facts(spark, inputs).select(
        F.explode(
            F.create_map(
                F.concat(F.lit("bytes:"), "path"), F.col("length").cast("string"),
                F.concat(F.lit("sha256:"), "path"), F.col("digest"),
            )
        ).alias("key", "value")
    )
    given = spark.createDataFrame(list(parameters.items()), "key string, value string")
    return facts.unionByName(given)

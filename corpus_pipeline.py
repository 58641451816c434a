"""From raw documents to packed training sequences, stage by stage.

Every stage works on all its predecessor kept. Stages but the last return the columns they got; texts that a stage
changes get their new length in n_chars. Rows that repeat an id and a text are one document from the n-gram join on;
rows without an id pass it as they are. SQL can express neither the language model nor the tokenizer, so there is no
twin; tests hold the stages against plain versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pulsegrid.llm import language_id, line_dedup, mixing, ngram_join, packing
from pulsegrid.llm.common import WORD, documents
from pulsegrid.session import durable


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the language model does not reject."""
    model = language_id.fit(docs, F.coalesce(~language_id.held_out(), F.lit(True)))
    return docs.where(~language_id.rejects(spark, model)("text"))


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has."""
    done = line_dedup.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")),
           "n_chars": F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates, once."""
    joined = ngram_join.join_ngrams(docs)
    kept = joined.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # The join's partitioning by id serves the window as well.
    again = F.lag(F.col("text")).over(W.partitionBy("doc_id").orderBy("text")).eqNullSafe(F.col("text"))
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("text"))
    once = docs.join(kept, "doc_id", "left_semi").withColumns({"_again": again, "_nth": nth}).where((F.col("_nth") == 1) | ~F.col("_again"))
    return once.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's budget ends where the budget does."""
    version = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    taken = mixing.mix(docs.withColumn("_version", version), carry=("_version",)).where(F.col("taken") > 0)
    # Rows alike in id and text take what the largest of them takes.
    taken = taken.groupBy(F.col("doc_id").alias("_id"), "_version").agg(F.max("taken").alias("_taken"), F.max("size").alias("_size"))
    met = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (version == F.col("_version")))
    times = met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")))))
    words = F.least(F.col("_size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")).cast("int")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, words), " ")
    cut = words < F.col("_size")
    new = {"text": F.when(cut, part).otherwise(F.col("text")), "n_chars": F.when(cut, F.char_length(part).cast("long")).otherwise(F.col("n_chars"))}
    return times.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", own_lines),
    ("ngram_join", first_of_group),
    ("mixing", mixed_sources),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

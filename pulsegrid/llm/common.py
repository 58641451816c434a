"""Column helpers the corpus operators share."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of the contracts, space and U+0009 to U+000D.
WHITE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a missing doc_id where ids are ordered: after every other.
LAST_ID = 2**63 - 1


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the quick function does just that where every byte is ASCII."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def digest(text: Column) -> Column:
    """128 bits as binary: no two of 10^13 different texts are likely to share one."""
    return F.unhex(F.md5(text))


def crc_bucket(name: str, modulus: int) -> Column:
    """crc32 of the decimal id, modulo; the id is text so that every engine agrees."""
    return F.pmod(F.crc32(F.col(name).cast("string")), F.lit(modulus))


def root_bits(rows: int) -> int:
    """Bits of a bucket number so that bucket count and bucket size both follow the square root of the rows."""
    return max(0, math.ceil(math.log2(max(rows, 1)) / 2))


#: A key with more than one in so many rows is joined where its rows are; there are fewer such keys than this.
MOST_OFTEN = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """The rows whose key has facts, with them. ``facts`` has one row per key, and ``often``: how many of the ``total`` rows may
    hold it. Keys held often are broadcast, at most ``MOST_OFTEN`` of them; the rows of the others meet by key, a thousandth
    of all at most in one place."""
    hot = F.col("often") * MOST_OFTEN > total
    few = F.broadcast(facts.where(hot).drop("often").withColumn("_hot", F.lit(True)))
    marked = rows.join(few, key, "left")
    rest = marked.where(F.col("_hot").isNull()).select(*rows.columns).join(facts.where(~hot).drop("often"), key)
    return marked.where(F.col("_hot")).drop("_hot").unionByName(rest)

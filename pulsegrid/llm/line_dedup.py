"""Drops lines that several documents share, except in the first document that holds them.

Lines are exploded, normalised and hashed; distinct documents are counted per hash; positions over the
threshold are dropped and the rest of each document is put together by position. Only DataFrame functions.

Defined cases: a null or empty text is one empty line. A null doc_id is a document after all others. Rows that
repeat a doc_id count as one document and each gets its own result. An empty table gives an empty result. Columns
of the input other than the id and the text are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.llm.common import LAST_ID, WHITE, ascii_lower, digest, documents, join_facts, whole_text
from pulsegrid.session import durable


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, version, pos, line) of every line long enough to count; version tells texts of one id apart."""
    text = whole_text(text_col)
    rows = docs.select(
        F.coalesce(F.col(id_col), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(text).alias("version"),
        F.posexplode(_lines(text)).alias("pos", "raw"),
    ).select("doc", "version", "pos", line_key(F.col("raw")).alias("key"))
    return rows.where(F.char_length("key") >= min_chars).select("doc", "version", "pos", digest(F.col("key")).alias("line"))


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes that at least ``min_docs`` documents hold, with the first of these and how often they occur. The first count is
    dealt by (line, doc), so a line of every document is counted in many tasks before its counts meet."""
    return (
        lines.groupBy("line", "doc").agg(F.count(F.lit(1)).alias("times"))
        .groupBy("line").agg(F.count(F.lit(1)).alias("holders"), F.min("doc").alias("keeper"), F.sum("times").alias("often"))
        .where(F.col("holders") >= min_docs).drop("holders")
    )


def dropped_positions(lines: DataFrame, min_docs: int) -> DataFrame:
    """(doc, version, dropped): positions of shared lines in other documents than their first."""
    shared = durable(shared_lines(lines, min_docs))
    marked = join_facts(lines, shared, "line", lines.count())
    return marked.where(F.col("doc") > F.col("keeper")).groupBy("doc", "version").agg(F.collect_set("pos").alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """The rows of ``docs`` as (id, row, n_lines, n_dropped, kept_text), where row is the whole input row."""
    drops = dropped_positions(durable(hashed_lines(docs, id_col, text_col, min_chars)), min_docs)
    text = whole_text(text_col)
    whole = docs.select(
        F.coalesce(F.col(id_col), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(text).alias("version"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        _lines(text).alias("lines"),
    )
    # The split happens below the join, so the lambda reads a finished array.
    found = whole.join(drops, ["doc", "version"], "left")
    n = F.size("lines")
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("dropped")), lambda i: F.get(F.col("lines"), i))
    )
    return found.select(
        F.col("row"),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.array_size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept_text"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    done = dedup_lines(documents(spark, folder).select("doc_id", "text"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )


SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, s.keeper IS NOT NULL AND k.doc_id > s.keeper AS gone FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

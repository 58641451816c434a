"""Mixes sources to target weights by exact word budgets.

Documents get hash-random keys, are range-sorted by key within their source, and a distributed prefix sum of
their words says which fall within the source's budget. A budget above the source's size repeats whole epochs
first. Only DataFrame functions.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; a null doc_id gets
a key of its own. Repeated rows are separate documents. Sources without words get target 0. An empty table gives an
empty result. Ties in the key go by id and size, and rows equal in both are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pulsegrid.llm.common import WORD, documents, root_bits, whole_text
from pulsegrid.session import durable

#: Weights of the sources in code-point order, repeating, and the most epochs a source may give.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
KEY_BITS = 60


def hash_key(doc_id: Column, seed: int) -> Column:
    """A 60-bit key from md5, which every engine has."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most_epochs: int) -> DataFrame:
    """(source, source_size) with each source's target.

    One row per source, so the windows without a key hold the source list only. Sources are capped in order of
    cap per weight; what the caps leave is shared by weight among the rest, as repeated resharing would end.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    capped = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most_epochs).withColumns({
        "total": F.sum("source_size").over(everything),
        "cap_before": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "weight_left": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    }).withColumn("capped", F.col("cap") * F.col("weight_left") <= (F.col("total") - F.col("cap_before")) * F.col("weight"))
    shared = capped.withColumns({
        "left": F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything),
        "free": F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything),
    })
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (F.col("left") * F.col("weight")).cast("double") / F.col("free").cast("double")
    )
    return shared.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: int = 8,
        carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``, and the columns to carry."""
    sized = durable(docs.select(
        "doc_id", "source", *carry,
        F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"),
        hash_key(F.col("doc_id"), seed).alias("key"),
    ))
    bits = root_bits(sized.count())
    sized = sized.withColumn("slot", F.shiftright("key", KEY_BITS - bits))
    slots = sized.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("source").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    targets = source_targets(slots.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most_epochs)
    offsets = slots.withColumn("slot_before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    a, b, c = sized.alias("a"), offsets.alias("b"), targets.alias("c")
    placed = (
        a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.slot") == F.col("b.slot")))
        .join(c, F.col("a.source").eqNullSafe(F.col("c.source")))
        .select("a.*", "b.slot_before", "c.source_size", "c.target")
    )
    inside = W.partitionBy("source", "slot").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("slot_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor(F.col("target") + 0.5)
    whole = F.floor(budget / F.col("source_size"))
    return placed.withColumn("before", before).select(
        "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("size") == 0, F.lit(0)).otherwise(
            whole * F.col("size")
            + F.greatest(F.lit(0), F.least(F.col("size"), budget - whole * F.col("source_size") - F.col("before")))
        ).cast("long").alias("taken"),
        *carry,
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::BIGINT AS weight FROM sized GROUP BY source),
ordered AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM named WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST)),
judged AS (SELECT *, cap * weight_left <= (total - cap_before) * weight AS capped FROM ordered),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
         ((total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight)::DOUBLE
         / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM judged),
placed AS (
  SELECT s.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (budget // source_size) * size
         + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END::BIGINT AS taken, source
FROM placed
"""

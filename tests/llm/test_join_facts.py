"""Joins of hot keys against a plain join; components of a star and a chain."""

import random

from pyspark.sql import functions as F

from pulsegrid.llm.common import join_facts
from pulsegrid.llm.components import components


def test_hot_and_rare_keys_join_alike(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i % 700}", i) for i in range(1500)] + [(None, 1), ("lost", 2)]
    left = spark.createDataFrame(rows, "key string, v int")
    facts = left.where("key IS NOT NULL AND key <> 'lost'").groupBy("key").agg(F.max("v").alias("most"), F.count(F.lit(1)).alias("often"))
    for total in (len(rows), 10 * len(rows), 0):
        got = sorted(tuple(r) for r in join_facts(left, facts, "key", total).select("key", "v", "most").collect())
        assert got == sorted(tuple(r) for r in left.join(facts, "key").select("key", "v", "most").collect()) and len(got) == 4500


def test_components_of_a_star_and_a_chain(spark):
    star, chain = [(5, i) for i in range(100, 1300)], [(i, i + 1) for i in range(2000, 2040)]
    links = star + chain + [(9000, 9001), (9001, 9000), (7, 7)]
    random.Random(1).shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {5: 5} | {b: 5 for _, b in star} | {i: 2000 for i in range(2000, 2041)} | {9000: 9000, 9001: 9000}
    assert got == want

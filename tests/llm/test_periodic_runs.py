"""Periodic runs: brute force over all starts and periods, whole texts of the tables, defined cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import corpus
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import periodic_runs
from pulsegrid.llm.hashing import mix64

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def plain_runs(words):
    """Every (start, length, period): stretches of agreement at each lag, kept where the lag is the smallest period."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(words[t] == words[t + d] for t in range(i, j + q - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *head, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def runs_of(*texts):
    words = mix64(np.array([w for t in texts for w in t], dtype=np.uint64) + np.uint64(99))
    got = periodic_runs.find_runs(words, np.array([len(t) for t in texts], dtype=np.int64))
    first = np.cumsum([0] + [len(t) for t in texts])
    return [tuple(int(v) for v in row) for row in zip(*got)], first


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), min_size=1, max_size=4))
def test_small_alphabets_match_brute_force(texts):
    found, first = runs_of(*texts)
    assert found == [(s + int(first[t]), length, q) for t, words in enumerate(texts) for s, length, q in plain_runs(words)]


@pytest.mark.parametrize("seed", range(30))
def test_planted_periods_match_brute_force(seed):
    rng = random.Random(seed)
    words = []
    for _ in range(rng.randint(1, 4)):
        words += [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(rng.randint(0, 30))]
        block = [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(rng.randint(1, 40))]
        words += (block * 6)[: int(len(block) * rng.choice([3.9, 4, 4.3, 5.5]))]
    found, _ = runs_of(words)
    assert found == plain_runs(words)


def test_every_lag_is_in_one_class_that_suits_it():
    classes = list(periodic_runs.lag_classes(100_000))
    lags = [q for least, most, _ in classes for q in range(least, most + 1)]
    assert lags == list(range(1, lags[-1] + 1)) and lags[-1] >= 25_000
    for least, most, k in classes:
        for q in {least, most}:
            shortest = max(6, 4 * q)
            assert k >= 2 * q or q == 1
            assert k <= shortest - q


def test_whole_tables_match_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in periodic_runs.query(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(r.text or "") < 12_000]
    assert len(got) == len(rows) and len(short) > 150
    assert {r.doc_id: got[r.doc_id] for r in short} == {r.doc_id: plain_row(r.doc_id, r.text) for r in short}
    assert sum(v[0] for v in got.values()) > 10


def test_defined_cases(spark, tmp_path):
    docs = corpus.clashing(corpus.odd_documents(spark)).withColumns({"runs": F.lit("mine"), "collapsed": F.lit(2)})
    rows = periodic_runs.query(spark, corpus.written(docs, tmp_path)).collect()
    want = [(r[0], *plain_row(r[0], r[1])) for r in corpus.odd_rows() if len(r[1] or "") < 12_000]
    got = [tuple(r) for r in rows]
    assert len(got) == len(corpus.odd_rows()) and all(w in got for w in want)
    kept = periodic_runs.periodic_runs(docs.drop("runs", "collapsed"))
    assert {"slot", "rank", "spans", "source"} <= set(kept.columns) and kept.count() == len(rows)


def test_ties_take_the_first_run_then_the_shortest_period(spark):
    text = "x " + "a " * 8 + "y " + "b " * 8 + "z " + "c d " * 8
    (row,) = periodic_runs.periodic_runs(spark.createDataFrame([(text,)], "text string")).select(
        "collapsed", periodic_runs.strongest(F.col("runs")).alias("best"), F.size("runs").alias("n")).collect()
    assert tuple(row.best) == (1, 8, 1) and row.n == 3 and row.collapsed == "x a y b z c d"


def test_very_long_texts(spark):
    rng = random.Random(3)
    own = [f"w{rng.randint(0, 5000)}" for _ in range(60_000)]
    text = " ".join(own[:30_000] + own[10_000:15_000] * 4 + own[30_000:] + ["same"] * 200_000)
    (row,) = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    runs = {tuple(r) for r in row.runs}
    assert any(q == 5_000 and length >= 20_000 for _, length, q in runs) and any(q == 1 and length >= 200_000 for _, length, q in runs)
    assert len(row.collapsed.split()) < 66_000


def test_empty_table(spark, tmp_path):
    assert periodic_runs.query(spark, corpus.written(corpus.empty_documents(spark), tmp_path)).collect() == []

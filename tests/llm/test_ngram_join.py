"""The n-gram join against all pairs."""

import random
import re
from collections import Counter

import corpus
import pytest

from pulsegrid.llm import key_blocks, ngram_join

WHITE = " \t\n\x0b\f\r"


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = sorted({shingles(r[1]) for r in rows} - {frozenset()}, key=lambda s: sorted(s))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(i)] = root(j)
    at = {s: root(i) for i, s in enumerate(sets)}
    least = {}
    for doc, text in (r[:2] for r in rows):
        s = shingles(text)
        if s and doc is not None:
            least[at[s]] = min(doc, least.get(at[s], doc))
    out = Counter()
    for doc, text in (r[:2] for r in rows):
        s = shingles(text)
        out[(doc, len(s), None if doc is None else least[at[s]] if s else doc)] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(key_blocks, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(ngram_join, "BYTES_PER_PART", 8000)
    monkeypatch.setattr(ngram_join, "RARE", 4)
    monkeypatch.setattr(ngram_join, "HOT", 6)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)


def family(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def test_odd_documents(spark, small):
    docs = corpus.clashing(corpus.odd_documents(spark)).repartition(3)
    assert found(ngram_join.join_ngrams(docs)) == brute(corpus.odd_rows())


@pytest.mark.parametrize("seed", [1, 2])
def test_families_chains_and_templates(spark, small, seed):
    rng = random.Random(seed)
    rows = []
    for f in range(6):
        base = corpus.words(rng, rng.choice([30, 60, 110]))
        for _ in range(25):
            rows.append(family(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 4])))
        chain = list(base)  # each differs a little from the one before
        for _ in range(12):
            chain[rng.randrange(len(chain))] = f"c{rng.randrange(10**9)}"
            rows.append(" ".join(chain))
    passage = corpus.words(rng, 50)
    for _ in range(60):  # mostly one passage: many candidates, few links
        rows.append(" ".join(passage + corpus.words(rng, rng.choice([0, 3, 8, 10, 12, 16, 40]))))
    for _ in range(40):
        rows.append(" ".join(corpus.words(rng, rng.randint(0, 7))))
    ids = rng.sample(range(10 * len(rows)), len(rows))
    table = list(zip(ids, rows))
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(6)
    assert found(ngram_join.join_ngrams(docs)) == brute(table)


def broadcast_lists(plan):
    """Lines of a plan that make rows of lists right below a broadcast, with no shuffle, and so no measured size, between."""
    found, at, free = [], None, True
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if at is not None and depth <= at:
            at = None
        if "BroadcastExchange" in line:
            at, free = depth, True
        elif at is not None and " Exchange " in line:
            free = False
        elif at is not None and free and "Generate" in line:
            found.append(line.strip())
    return found


def test_pairs_of_tokens_are_not_broadcast(spark, small, monkeypatch):
    """A few lists of tokens look small, their pairs are not: no join sends them through the driver."""
    plans, write = [], ngram_join.durable

    def written(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(ngram_join, "durable", written)
    rng = random.Random(5)
    passages = [corpus.words(rng, 40) for _ in range(4)]
    table = [(i, " ".join(corpus.words(rng, rng.choice([3, 8, 10])) + passages[i % 4] + corpus.words(rng, rng.choice([0, 3, 8])))) for i in range(120)]
    result = ngram_join.join_ngrams(spark.createDataFrame(table, "doc_id long, text string").repartition(4))
    assert found(result) == brute(table)
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    assert any("Generate posexplode(slice(frequent" in p for p in plans) and not [x for p in plans for x in broadcast_lists(p)]


def test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert found(ngram_join.join_ngrams(table)) == brute([tuple(r) for r in table.collect()])


def test_empty_table(spark):
    assert ngram_join.join_ngrams(corpus.empty_documents(spark)).collect() == []

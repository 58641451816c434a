"""Passage removal against brute force, and the pieces of the exchange."""

import hashlib
import random
from collections import Counter

import corpus
import numpy as np
import pytest

from pulsegrid.llm import key_blocks, suffix_dedup
from pulsegrid.llm.common import LAST_ID

DEPTH = 50


def brute(rows):
    texts = [(LAST_ID if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for doc, data in texts:
        for s in range(len(data) - DEPTH + 1):
            key = data[s:s + DEPTH]
            first[key] = min(doc, first.get(key, doc))
    out = Counter()
    for doc, data in texts:
        gone = bytearray(len(data))
        for s in range(len(data) - DEPTH + 1):
            if first[data[s:s + DEPTH]] < doc:
                gone[s:s + DEPTH] = b"\1" * DEPTH
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[(None if doc == LAST_ID else doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in df.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(key_blocks, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "BYTES_PER_PART", 4000)


def test_odd_documents(spark, small_blocks):
    docs = corpus.clashing(corpus.odd_documents(spark)).repartition(3)
    assert found(suffix_dedup.dedup_passages(docs, digest_only=True)) == brute(corpus.odd_rows())


def test_passages_at_every_shift(spark, small_blocks):
    rng = random.Random(2)
    letters = "abcdefgh é\n"
    passage = "".join(rng.choice(letters) for _ in range(400))
    rows = []
    for i in range(120):
        own = "".join(rng.choice(letters) for _ in range(rng.randint(0, 160)))
        at, n = rng.randint(0, 340), rng.choice([10, 48, 49, 50, 51, 60, 120, 400])
        rows.append((rng.randint(0, 90), own + passage[at:at + n] + own[:30] + ("z" * rng.choice([0, 60, 300]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(suffix_dedup.dedup_passages(docs, digest_only=True)) == brute(rows)


def test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert found(suffix_dedup.dedup_passages(table, digest_only=True)) == brute([tuple(r) for r in table.collect()])


def test_bytes_are_returned(spark):
    docs = spark.createDataFrame([(1, "a" * 60), (2, "b" + "a" * 55)], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup_passages(docs).collect()} == {1: b"a" * 60, 2: b"b"}


def test_cover_has_every_difference():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


def test_packed_keys_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    for k in (keys, keys[:1], keys[:0]):
        assert (key_blocks.unpack_sorted(key_blocks.pack_sorted(k)) == k).all()


def test_empty_table(spark):
    assert suffix_dedup.dedup_passages(corpus.empty_documents(spark)).collect() == []

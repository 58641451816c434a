"""Merkle manifest: a plain tree in Python, proofs that hold and fail, defined cases."""

import hashlib
import string
import zlib

import corpus
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import merkle_manifest

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = [None if v is None else str(v) for v in (row[0], row[3], row[2], row[4], text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree_paths(hashes):
    """(root, path of every node as (before, after) per level)."""
    paths = [[] for _ in hashes]
    at = list(range(len(hashes)))
    while len(hashes) > 1:
        for i, p in enumerate(paths):
            lo = at[i] // 16 * 16
            p.append(("".join(hashes[lo:at[i]]), "".join(hashes[at[i] + 1:lo + 16])))
            at[i] //= 16
        hashes = [sha("".join(hashes[i:i + 16])) for i in range(0, len(hashes), 16)]
    return hashes[0], paths


def plain_manifest(rows):
    leaves = [(r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, plain_leaf(r, r[4 + 1]), r) for r in rows]
    leaves.sort(key=lambda x: x[:5])
    groups = {}
    for x in leaves:
        groups.setdefault(x[:2], []).append(x)
    built = [(g, *tree_paths([x[4] for x in g])) for g in groups.values()]
    root, tops = tree_paths([b[1] for b in built])
    out = []
    for (group, subroot, paths), top in zip(built, tops):
        for x, path in zip(group, paths):
            row, whole = x[5], path + top
            leaf = x[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                leaf = plain_leaf(row, None if row[5] is None else row[5].translate(LOWER))
            for before, after in whole:
                leaf = sha(before + leaf + after)
            out.append((row[0], x[4], subroot, root, sha("".join(a + b for a, b in whole)), leaf, leaf == root))
    return out


def rows_of(docs):
    """(doc_id, -, lang, source, n_chars, text)"""
    return [(r.doc_id, None, r.lang, r.source, r.n_chars, r.text) for r in docs.select("doc_id", "lang", "source", "n_chars", "text").collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    got = [tuple(r) for r in merkle_manifest.query(spark, folder).select(*COLUMNS).collect()]
    assert ordered(got) == ordered(plain_manifest(rows_of(spark.read.parquet(f"{folder}/documents.parquet"))))
    tampered = [r[-1] for r in got if not r[-1]]
    assert 10 < len(tampered) < len(got) / 4


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 2, 256, 257, 33], [1] * 20])
def test_run_and_level_edges(spark, tmp_path, sizes):
    docs = [(1000 * s + i, f"Text {i}", "en", None if s == 0 else f"s{s:02}é", i) for s, n in enumerate(sizes) for i in range(n)]
    folder = corpus.written(spark.createDataFrame(docs, corpus.SCHEMA).repartition(3), tmp_path)
    got = [tuple(r) for r in merkle_manifest.query(spark, folder).select(*COLUMNS).collect()]
    assert ordered(got) == ordered(plain_manifest([(d[0], None, d[2], d[3], d[4], d[1]) for d in docs]))


def test_defined_cases(spark, tmp_path):
    docs = corpus.clashing(corpus.odd_documents(spark)).withColumns({n: F.lit("mine") for n in ("group", "n", "hash", "path", "left", "total", "at")})
    folder = corpus.written(docs, tmp_path)
    got = [tuple(r) for r in merkle_manifest.query(spark, folder).select(*COLUMNS).collect()]
    assert ordered(got) == ordered(plain_manifest(rows_of(corpus.odd_documents(spark))))


def test_rows_alike_in_everything(spark, tmp_path):
    docs = [(7, "same text", "en", "a", 9)] * 300 + [(None, None, None, None, None)] * 40
    folder = corpus.written(spark.createDataFrame(docs, corpus.SCHEMA), tmp_path)
    got = [tuple(r) for r in merkle_manifest.query(spark, folder).select(*COLUMNS).collect()]
    assert ordered(got) == ordered(plain_manifest([(d[0], None, d[2], d[3], d[4], d[1]) for d in docs]))


def test_nulls_and_empty_texts_differ():
    row = (1, None, "en", "a", 0)
    assert plain_leaf(row, None) != plain_leaf(row, "") and plain_leaf((1, None, "e", "na", 0), "") != plain_leaf((1, None, "en", "a", 0), "")


def test_very_long_text(spark, tmp_path):
    docs = [(1, "Long " * 400_000, "en", "a", 1), (2, "B", "en", "a", 1)]
    folder = corpus.written(spark.createDataFrame(docs, corpus.SCHEMA), tmp_path)
    got = [tuple(r) for r in merkle_manifest.query(spark, folder).select(*COLUMNS).collect()]
    assert ordered(got) == ordered(plain_manifest([(d[0], None, d[2], d[3], d[4], d[1]) for d in docs]))


def test_empty_table(spark, tmp_path):
    assert merkle_manifest.query(spark, corpus.written(corpus.empty_documents(spark), tmp_path)).collect() == []

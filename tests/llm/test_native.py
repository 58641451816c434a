"""The native operators against their SQL twins and plain versions."""

import hashlib
import os
import sys
from collections import Counter

import compare_stages as plain
import corpus
import pytest

from pulsegrid.llm import line_dedup, mixing

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import compare  # noqa: E402

from pulsegrid.llm import catalog  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(spark, name):
    folder = "/root/testdata/sf0.01"
    left = compare.spark_rows(catalog.QUERIES[name](spark, folder))
    assert compare.difference(left, compare.oracle_rows(compare.connect(folder), catalog.SQL[name])) is None


def test_lines_of_odd_documents(spark, tmp_path):
    folder = corpus.written(corpus.clashing(corpus.odd_documents(spark)), tmp_path)
    found = Counter(tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in line_dedup.query(spark, folder).collect())
    assert found == Counter((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
                            for r, kept, lines in plain.kept_lines(corpus.odd_rows()))


def test_lines_with_a_threshold(spark):
    rows = [(1, "a shared line here\nown line number one"), (2, "a shared line here\nown line number two"), (3, "A SHARED LINE HERE ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.row.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs, min_docs=3).collect()} == {1: 0, 2: 1, 3: 1}
    assert {r.n_dropped for r in line_dedup.dedup_lines(docs, min_docs=4).collect()} == {0}


def test_mix_of_odd_documents(spark):
    rows = corpus.odd_rows()
    found = mixing.mix(corpus.clashing(corpus.odd_documents(spark))).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter((r[0], r[3], plain.words(r[1])) for r in rows)
    target, size = plain.targets(rows), plain.words_by_source(rows)
    taken = Counter()
    for r in found:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(t + 0.5) for s, t in target.items())
    again = mixing.mix(corpus.odd_documents(spark).repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_empty_tables(spark):
    assert mixing.mix(corpus.empty_documents(spark)).collect() == []
    assert line_dedup.dedup_lines(corpus.empty_documents(spark)).collect() == []

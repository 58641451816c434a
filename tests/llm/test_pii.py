"""Personal data: base spans against the plain rules, boosting, added spans."""

import hashlib
import random
import re

import corpus
import pytest

from pulsegrid.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in text.split(".")),
            "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in RULES.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def same(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.query(spark, corpus.written(docs, tmp_path)).collect()
    wanted = sorted((d if d is not None else -1, ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t))) for d, t in rows)
    texts = {(d, hashlib.sha256(s.encode()).hexdigest()) for d, s in wanted}
    assert len(found) == len(rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.base_sha256) for r in found) == sorted((d, hashlib.sha256(s.encode()).hexdigest()) for d, s in wanted) and texts
    by_id = {d: t for d, t in rows}
    for r in found:
        base = brute(by_id[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in pii.KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert set(f"{k}:{s}:{e}" for k, s, e in base) <= set(spans) and len(spans) == len(base) + r.n_added
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)
    return found


def test_base_spans_of_odd_texts(spark, tmp_path):
    rng = random.Random(1)
    parts = ["a@b.co", "x.y@z.com.@q.r", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111",
             "4111  1111", "+1 (255) 555-8013", "+1+23456789012", "+1234567", "é🦊", "@", ".", "-", " ", "\n", "a", "_d@e.fg", "5500005555555559", "12", "%", "+"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", "", " ", ","]) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    same(spark, rows, tmp_path)


def long_runs(n):
    return [(1, "a" * n), (2, "1" * n), (3, "1 " * n), (4, "a." * n + "@b"), (5, "a@b" + ".c" * n), (6, "1." * n), (7, "+1" * n), (8, "+1" + "(" * n)]


def test_long_runs(spark, tmp_path):
    same(spark, [*long_runs(1500), (9, None), (10, "")], tmp_path)


def test_long_runs_take_linear_time(spark, tmp_path):
    docs = spark.createDataFrame(long_runs(100_000), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.query(spark, corpus.written(docs, tmp_path)).collect()}
    assert len(found) == 8 and found[5].n_email == 1 and found[6].n_ip == 25_000


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_table(spark, tmp_path, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = same(spark, rows, tmp_path)
    assert sum(r.n_added for r in found) <= 0.05 * sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in found)


@pytest.mark.parametrize("loose", [2, 20, 100])
def test_loose_forms_are_added_at_any_share(spark, tmp_path, loose):
    """Written-out addresses and phone numbers without a plus next to a word for them; base spans and plain numbers beside."""
    rows = [(i, f"mail me at user{i}@host{i % 7}.org now") for i in range(100)] + [(100 + i, f"call +1 ({200 + i}) 555-{1000 + i} now") for i in range(100)]
    rows += [(200 + i, f"order 12 of 345, lot {i} 17:04, see page 555 in 20{i:02}") for i in range(60)]
    rows += [(1000 + i, f"write to user{i} (at) host{i % 5} (dot) org today") for i in range(loose)]
    rows += [(2000 + i, f"my phone {210 + i} 555-{2000 + i} at home") for i in range(loose)]
    rows += [(3000, "items 1,2,3,4 and 10:20:30:40"), (3001, "ref 212 555-1234 x"), (3002, None)]
    found = {r.doc_id: r for r in same(spark, rows, tmp_path)}
    for i in range(loose):
        text = dict(rows)[1000 + i]
        start, end = text.index("user"), text.index("org") + 3
        assert found[1000 + i].spans == f"email:{start}:{end}" and found[1000 + i].n_email == 0
        assert found[2000 + i].n_added == 1 and found[2000 + i].spans.startswith("phone:9:")
    assert all(found[i].n_added == 0 for i in range(260)) and found[3000].n_added == found[3001].n_added == 0


def test_nothing_is_added_without_examples(spark, tmp_path):
    rows = [(i, f"no data here, 12 34, lot {i}, 212 555-42{i % 90 + 10}") for i in range(50)]
    assert all(r.spans == "" for r in same(spark, rows, tmp_path))


def test_boosting_separates_cells():
    good, bad = (3, 2, 0, 0, 0, 0, 1, 1), (3, 2, 0, 0, 1, 0, 1, 0)
    counts = [(good, 100.0, 99.0), (bad, 50.0, 1.0)]
    trees = pii.boost(counts)
    score = {x: sum(t.value(x) if isinstance(t, pii.Split) else t for t in trees) for x in (good, bad)}
    assert score[bad] < 0 < score[good]
    assert score[bad] < pii.calibrated(counts, trees, 0.98) <= score[good]


def test_odd_documents_and_clashing_columns(spark, tmp_path):
    folder = corpus.written(corpus.clashing(corpus.odd_documents(spark)), tmp_path / "a")
    assert len(pii.query(spark, folder).collect()) == len(corpus.odd_rows())
    assert pii.query(spark, corpus.written(corpus.empty_documents(spark), tmp_path / "b")).collect() == []

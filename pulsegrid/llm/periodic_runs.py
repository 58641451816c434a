"""Runs of words that repeat with a period, found by seeds and extension along diagonals.

A run of smallest period q and length of at least 4 q matches itself at lag q over at least 3 q words. Lags are taken
in classes from Q to about 1.5 Q, and for each class the word grams of k = 3 Q, the overlap every run of the class is
sure to have, are indexed within the document (k = 5 for the lags 1 and 2). Such a gram is at least 2 q long, so it has the
smallest period of its run and its next occurrence in the document lies exactly q further: consecutive
occurrences with a lag of the class are all the seeds that are needed, and they are fewer than the words. Each is
extended to both sides along its diagonal, word by word; per lag, the furthest word covered so far tells which seeds lie in
a run already found. A gram that occurs once cannot begin a longer gram that occurs twice, so each class looks only at
the positions the class before left.

Defined cases: a null, empty or blank text has no word and no run; its collapsed text is empty. Words are told apart by
64-bit hashes. Rows stand alone: repeated ids, null ids and repeated rows get a result each. An empty table gives an empty
result. Columns besides the id and the text are not read. A text is handled whole in one task, in memory that
follows its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.llm.common import WHITE, documents
from pulsegrid.llm.hashing import inverse_powers, mix64, run_edges, segment_hashes
from pulsegrid.llm.key_blocks import in_sorted, repeated
from pulsegrid.llm.text_buffers import buffers

LEAST_WORDS = 6
LEAST_PERIODS = 4
GROUP_BYTES = 4 << 20

_IS_WORD = np.array([c not in b"\t\n\x0b\x0c\r " for c in range(256)])
_RESULT = "starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def lag_classes(most_words: int) -> Iterator[tuple[int, int, int]]:
    """(smallest lag, largest lag, k) of the classes that runs within ``most_words`` words can have."""
    yield 1, 2, 5
    least = 3
    while LEAST_PERIODS * least <= most_words:
        beyond = 3 * least // 2 + 1
        yield least, beyond - 1, 3 * least
        least = beyond


def word_edges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text); words do not cross texts."""
    inside = _IS_WORD[data]
    starts, ends = run_edges(inside)
    cut = np.unique(bounds[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut] & inside[cut - 1]]
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    per_text = np.diff(np.searchsorted(starts, bounds))
    return starts, ends, per_text


def _agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """Leading words that agree; looks at twice as many each time."""
    at, step = 0, 32
    while at < len(x):
        apart = x[at:at + step] != y[at:at + step]
        if apart.any():
            return at + int(apart.argmax())
        at, step = at + step, step * 2
    return len(x)


def find_runs(words: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run in word hashes of consecutive texts, ordered by start, then period."""
    ends = np.cumsum(per_text)
    text = np.repeat(np.arange(len(per_text)), per_text)
    grams = _Grams(words)
    salt = mix64(np.arange(1, len(per_text) + 1, dtype=np.uint64))
    left = np.arange(len(words))
    found: list[tuple[int, int, int]] = []
    for least, most, k in lag_classes(int(per_text.max(initial=0))):
        left = left[left + k <= ends[text[left]]]
        key = grams.at(left, k) + salt[text[left]]
        twice = in_sorted(repeated(np.sort(key)), key)
        left, key = left[twice], key[twice]
        if not len(left):
            break
        order = np.argsort(key, kind="stable")  # positions ascend within a key
        here, after, same = left[order[:-1]], left[order[1:]], key[order[:-1]] == key[order[1:]]
        lag = after - here
        seed = same & (lag >= least) & (lag <= most)
        found.extend(_extended(words, ends, text, here[seed], lag[seed]))
    out = np.array(sorted((s, q, n) for s, n, q in found), dtype=np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 2], out[:, 1]


def _extended(words: np.ndarray, ends: np.ndarray, text: np.ndarray, seeds: np.ndarray, lags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs around seeds."""
    order = np.lexsort((seeds, lags))
    seeds, lags = seeds[order], lags[order]
    for q in np.unique(lags).tolist():
        lo, hi = np.searchsorted(lags, [q, q + 1])
        own = seeds[lo:hi]
        at, covered = 0, -1
        while at < len(own):
            i = int(own[at])
            end = int(ends[text[i]])
            begin = int(ends[text[i] - 1]) if text[i] else 0
            right = i + _agreeing(words[i:end - q], words[i + q:end])
            start = i - _agreeing(words[begin:i][::-1], words[begin + q:i + q][::-1])
            length = right + q - start
            if length >= max(LEAST_WORDS, LEAST_PERIODS * q):
                yield start, length, q
            covered = max(right, i + 1)
            at = int(np.searchsorted(own, covered))


class _Grams:
    """Hashes of k words at chosen positions, from one running sum; equal words in order give equal hashes."""

    def __init__(self, words: np.ndarray):
        self.words = np.zeros(len(words) + 1, dtype=np.uint64)
        self.up, self.down = inverse_powers(len(words))
        np.cumsum(words * self.up, out=self.words[1:])

    def at(self, positions: np.ndarray, k: int) -> np.ndarray:
        return mix64((self.words[positions + k] - self.words[positions]) * self.down[positions])


def _group(data: np.ndarray, bounds: np.ndarray) -> dict[str, list]:
    starts, ends, per_text = word_edges(data, bounds)
    words = segment_hashes(data, starts, ends)
    start, length, period = find_runs(words, per_text)
    last = np.cumsum(per_text)
    first = last - per_text
    dropped = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    gone = np.cumsum(dropped[:-1]) > 0
    text = np.searchsorted(last, start, side="right")
    cuts = np.searchsorted(text, np.arange(len(per_text) + 1))
    out = {name: [] for name in ("starts", "lengths", "periods", "collapsed")}
    raw = data.tobytes()
    for t in range(len(per_text)):
        lo, hi = cuts[t], cuts[t + 1]
        kept = raw[bounds[t]:bounds[t + 1]].split()
        if hi > lo:
            kept = [w for w, drop in zip(kept, gone[first[t]:last[t]].tolist()) if not drop]
        for name, value in zip(out, (start[lo:hi] - first[t], length[lo:hi], period[lo:hi], b" ".join(kept))):
            out[name].append(value)
    return out


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, each as it was, then ``runs`` (array of start, length, period: word numbers
    from 0, by start, then period) and ``collapsed``: the words no run repeats, joined by one space."""
    kept = [c for c in docs.columns if c != text_col]
    place = {c: f"_{i}" for i, c in enumerate(kept)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in place.items()], F.col(f"`{text_col}`").alias("text"))
    schema = ", ".join([f"{place[f.name]} {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col] + [_RESULT])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(batch.schema.names[:-1])
            for lo, hi, data, bounds in buffers(batch["text"], GROUP_BYTES):
                found = _group(data, bounds)
                numbers = [pa.array(found[n], pa.list_(pa.int64())) for n in ("starts", "lengths", "periods")]
                collapsed = pa.array(found["collapsed"], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*own.slice(lo, hi - lo).columns, *numbers, collapsed],
                                                 names=[*own.schema.names, "starts", "lengths", "periods", "collapsed"])

    runs = F.arrays_zip("starts", "lengths", "periods").cast("array<struct<start:long,length:long,period:long>>")
    return rows.mapInArrow(over, schema).select(*[F.col(n).alias(c) for c, n in place.items()], runs.alias("runs"), "collapsed")


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period; of equal ones the first, then the shortest period; null without runs."""

    def order(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        by_place = F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(
            F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))
        return F.when(a > b, -1).when(a < b, 1).otherwise(by_place)

    return F.get(F.array_sort(runs, order), F.lit(0))


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of every tenth id by hash made periodic from a word on, as the contract of the query
    says; a null id is none of them."""
    text = F.btrim("text", F.lit(WHITE))
    h = F.crc32(F.col("doc_id").cast("string"))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(
        (F.pmod(h, F.lit(10)) == 0) & (text != ""), F.split(text, r"[\x20\x09-\x0D]+")).alias("words"))
    n = F.size("words").cast("long")
    placed = split.select("doc_id", "text", "g", "words", n.alias("n"), F.when(n > 0, F.pmod("g", n)).alias("a"))
    rest = F.col("n") - F.col("a")
    p = 1 + F.floor(rest / (3 + F.pmod("g", F.lit(8))))
    counted = placed.select("doc_id", "text", "words", rest.cast("int").alias("rest"), F.col("a").cast("int").alias("a"), p.cast("int").alias("p"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(period, F.ceil(F.col("rest") / F.col("p")).cast("int"))), F.lit(1), F.col("rest"))
    whole = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")
    return counted.select("doc_id", F.when(F.col("words").isNotNull(), whole).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(looped(documents(spark, folder))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

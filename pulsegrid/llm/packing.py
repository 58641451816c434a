"""Packs documents into token windows by minimum bin slack.

Every document is cut into full windows and a remainder. The remainders' lengths form a multiset of at most
``window`` different numbers, however many documents there are. Bin by bin, the longest length left is fixed and a
bitset subset-sum program over the counts left picks the lengths that come closest to filling the window; the
backtracked counts are repeated as often as the multiset allows. Pieces then take the places of their length in
order of rank, so the plan holds lengths only and rows meet it by (length, rank).

Defined cases: a null or empty text is the end token alone. Null ids are allowed; repeated rows are packed as rows
of their own. An empty table gives an empty result. Columns besides doc_id and text are not read. Texts are encoded
whole, one Arrow batch at a time.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pulsegrid.llm.batches import map_batches
from pulsegrid.llm.common import documents, root_bits
from pulsegrid.llm.text_buffers import buffers
from pulsegrid.llm.tokens import encoder, tokenizer_path
from pulsegrid.session import durable

WINDOW = 2048
END_ID = 1
BATCH_BYTES = 4 << 20


def token_pieces(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows of every document and what remains of it."""
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).group
        for batch in batches:
            for lo, hi, data, bounds in buffers(batch["text"], BATCH_BYTES):
                ids, ends = encode(data, bounds)
                # The end token goes behind each document's ids.
                ids = np.insert(ids, ends, end_id).astype("<u4")
                total = np.diff(ends, prepend=0) + 1
                count = -(-total // window)
                nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                doc_tokens = np.repeat(total, count)
                start = nth * window
                length = np.minimum(window, doc_tokens - start)
                raw = memoryview(ids.tobytes())
                at = 4 * (np.repeat(np.cumsum(total) - total, count) + start)
                crc = [zlib.crc32(raw[a:a + n]) for a, n in zip(at.tolist(), (4 * length).tolist())]
                docs_of = batch["doc_id"].slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), count)))
                yield pa.RecordBatch.from_arrays([docs_of, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(doc_tokens)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(over, ", ".join(f"{n} long" for n in names))


# ---- the plan, on lengths and counts ----------------------------------------------------------------


def _parts(length: int, count: int) -> list[tuple[int, int]]:
    """(copies, width): binary parts whose subsets are all numbers of copies up to count."""
    parts, step = [], 1
    while count > 0:
        copies = min(step, count)
        parts.append((copies, copies * length))
        count -= copies
        step *= 2
    return parts


def fullest(counts: dict[int, int], lengths: list[int], space: int) -> Counter[int]:
    """The multiset of lengths, within ``counts``, whose sum is the largest of at most ``space``.

    Bit s of the reachable set says that some multiset sums to s; the sets before each part are kept, and from the
    best sum the parts are walked back.
    """
    mask, reach = (1 << (space + 1)) - 1, 1
    trail: list[tuple[int, int, int, int]] = []
    for length in lengths:
        if length > space or reach >> space & 1:
            continue
        for copies, width in _parts(length, min(counts[length], space // length)):
            wider = reach | (reach << width & mask)
            if wider != reach:
                trail.append((reach, length, copies, width))
                reach = wider
            if reach >> space & 1:
                break
    best, chosen = reach.bit_length() - 1, Counter()
    for before, length, copies, width in reversed(trail):
        if not before >> best & 1:
            chosen[length] += copies
            best -= width
    return chosen


@dataclass
class Places:
    """For every length: rank ranges, in order, and where their pieces go."""

    first_rank: np.ndarray
    sequence: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray


def minimum_slack_plan(histogram: dict[int, int], window: int) -> dict[int, Places]:
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(counts, reverse=True)
    used: Counter[int] = Counter()
    rows: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    sequence = 0
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        chosen = fullest(counts, lengths, window - longest)
        counts[longest] += 1
        chosen[longest] += 1
        bins = min(counts[n] // k for n, k in chosen.items())
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            rows[n].append((used[n], sequence, k, offset))
            used[n] += bins * k
            counts[n] -= bins * k
            offset += n * k
        sequence += bins
        lengths = [n for n in lengths if counts[n]]
    return {n: Places(*(np.array(column, dtype=np.int64) for column in zip(*found))) for n, found in rows.items()}


def place(plan: dict[int, Places], lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sequence, offset = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
    for n in np.unique(lengths):
        own, p = np.flatnonzero(lengths == n), plan[int(n)]
        at = np.searchsorted(p.first_rank, ranks[own], side="right") - 1
        done = ranks[own] - p.first_rank[at]
        sequence[own] = p.sequence[at] + done // p.per_bin[at]
        offset[own] = p.offset[at] + done % p.per_bin[at] * n
    return sequence, offset


# ---- rows meet the plan -----------------------------------------------------------------------------


def ranked(pieces: DataFrame, bits: int) -> DataFrame:
    """Pieces numbered from 0 within their length: counts by hash slot first, so that a length which most pieces
    share is still numbered in many tasks."""
    slot = F.shiftright(F.xxhash64("doc_id", "start"), 64 - bits) if bits else F.lit(0).cast("long")
    slotted = pieces.withColumn("slot", slot)
    earlier = W.partitionBy("length").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    before = slotted.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy("length", "slot").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return slotted.withColumn("nth", F.row_number().over(inside)).join(before, ["length", "slot"]).withColumn(
        "rank", F.col("before") + F.col("nth") - 1)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = durable(token_pieces(docs, path or tokenizer_path(), window, end_id))
    # At most ``window`` rows.
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Plain arrays, which executors read without a class of this package.
    plan = pieces.sparkSession.sparkContext.broadcast({n: astuple(p) for n, p in minimum_slack_plan(histogram, window).items()})

    def each(batch):
        sequence, offset = place({n: Places(*p) for n, p in plan.value.items()}, batch["length"].to_numpy(), batch["rank"].to_numpy())
        kept = {n: batch[n] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        return kept | {"sequence_id": sequence, "offset": offset}

    rows = ranked(pieces, root_bits(sum(histogram.values())))
    return map_batches(rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"), each,
                       "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder))

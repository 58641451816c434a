"""Removes bytes of passages that start in an earlier document too, by blockwise suffix sorting over a cover.

A difference cover holds a few residues of a period such that any two positions, moved by the same number of bytes
below the period, both fall on it. So where two 50-byte strings are equal, some pair of cover positions inside them
starts equal strings of 50 - period + 1 bytes. The suffixes at cover positions are classed first: the ranks of
their leading bytes are sorted range by range, and a class that only one place holds ends there. Only
suffixes within a period before a repeated cover class can repeat for 50 bytes. These are dealt to suffix buckets
and sorted one bucket at a time; a tie is resolved to depth 50 by the class of its whole window, so memory is bounded
by a bucket and no text is compared byte by byte.

A suffix's bucket follows from its window's smallest 8-byte class, which equal windows share and neighbours
mostly share too: a bucket's suffixes arrive as short overlapping stretches of text. Suffixes that a smaller
document of the same block starts are settled in the block and never sent.

Classes are 64-bit hashes besides the bucket's own bits. Defined cases: a null text is empty; a null doc_id is a
document after all others; rows that repeat a doc_id are one document and keep what they share. Texts below 50 bytes
lose nothing. An empty table gives an empty result. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm.batches import arrow_schema
from pulsegrid.llm.common import LAST_ID, documents
from pulsegrid.llm.hashing import Windows, mix64
from pulsegrid.llm.key_blocks import (
    ANSWERS,
    PACKED,
    Block,
    by_part,
    held_elsewhere,
    held_twice,
    map_blocks,
    pack_planes,
    part_bits,
    send_keys,
    unpack_planes,
    write_blocks,
)

DEPTH = 50
#: A perfect difference set; every residue of the period is a difference of two of its members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = DEPTH - PERIOD + 1
#: Bytes whose smallest class in a window names the window's bucket.
SEED_BYTES = 8
BYTES_PER_PART = 8 << 20
SEGMENTS, SETTLED = 0, 1
_OFFSET_BITS = np.uint64((1 << 16) - 1)


def _marked(block: Block, pattern: np.ndarray | None, reach: int) -> np.ndarray:
    """Positions with ``reach`` bytes left in their document, on the pattern of document offsets if one is given."""
    mark = np.zeros(len(block.data), dtype=bool)
    for start, length in zip(block.starts.tolist(), block.lengths.tolist()):
        if length >= reach:
            mark[start:start + length - reach + 1] = True if pattern is None else pattern[:length - reach + 1]
    return mark


def cover_suffixes(block: Block, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(position, class of the anchor) at cover positions."""
    longest = int(block.lengths.max(initial=0))
    pattern = np.isin(np.arange(max(longest, 1)) % PERIOD, COVER)
    positions = np.flatnonzero(_marked(block, pattern, ANCHOR))
    return positions, windows.at(positions, ANCHOR)


def send_cover(number: int, block: Block, bits: int) -> dict[str, list]:
    _, classes = cover_suffixes(block, Windows(block.data))
    return send_keys(number, classes, bits)


def candidate_suffixes(block: Block, windows: Windows, answers: list[tuple[int, bytes]], bits: int) -> np.ndarray:
    """Starts of whole windows that hold a cover position whose class occurs twice."""
    positions, classes = cover_suffixes(block, windows)
    hit = positions[held_twice(classes, classes, answers, bits)]
    # Windows from PERIOD - 1 before a hit up to it; hits are distinct, so each adds and takes at its own place.
    depth = np.zeros(len(block.data) + PERIOD, dtype=np.int32)
    depth[hit] += 1
    depth[hit + PERIOD] -= 1
    held = np.cumsum(depth, dtype=np.int32)[PERIOD - 1:PERIOD - 1 + len(block.data)] > 0
    return np.flatnonzero(held & _marked(block, None, DEPTH))


def earlier_in_group(classes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether the same class has a smaller document; sorts one bucket of suffixes."""
    if not len(classes):
        return np.zeros(0, dtype=bool)
    order = np.argsort(classes)
    ranked = classes[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    least = np.minimum.reduceat(docs[order], np.flatnonzero(new))
    out = np.empty(len(classes), dtype=bool)
    out[order] = docs[order] > least[np.cumsum(new) - 1]
    return out


def window_seeds(windows: Windows, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, position) of the smallest 8-byte class inside each window, the leftmost of equals."""
    steps = DEPTH - SEED_BYTES + 1
    # Stretches of neighbouring starts, each widened by the window, so that seeds are hashed once.
    breaks = np.flatnonzero(np.diff(starts) > 1) + 1
    lo, hi = starts[np.concatenate([[0], breaks])], starts[np.concatenate([breaks - 1, [len(starts) - 1]])] + steps
    sizes = hi - lo
    base = np.cumsum(sizes) - sizes
    spots = np.arange(int(sizes.sum())) - np.repeat(base - lo, sizes)
    classes = windows.at(spots, SEED_BYTES)
    # The position rides in the low bits, so one running minimum gives both.
    tagged = (classes & ~_OFFSET_BITS) | ((spots - np.repeat(lo, sizes)).astype(np.uint64) & _OFFSET_BITS)
    return _running_minimum(tagged, steps, classes, spots, starts, lo, base)


def _running_minimum(tagged, steps, classes, spots, starts, lo, base):
    # Van Herk by doubling: after k rounds a cell holds the minimum of 2^k cells from it on.
    least, width = tagged.copy(), 1
    while width * 2 <= steps:
        least[:-width] = np.minimum(least[:-width], least[width:])
        width *= 2
    stretch = np.searchsorted(lo, starts, side="right") - 1
    at = base[stretch] + starts - lo[stretch]
    found = np.minimum(least[at], least[at + steps - width])
    # Back from the tag to the cell: the tag's offset is taken modulo 2^16, and the window is far shorter.
    inside = (found - (starts - lo[stretch]).astype(np.uint64)) & _OFFSET_BITS
    cell = at + inside.astype(np.int64)
    return classes[cell], spots[cell]


def send_suffixes(number: int, block: Block, answers: list[tuple[int, bytes]], bits: int) -> dict[str, list]:
    """Segments of the candidate suffixes for their buckets, and the stretches settled in the block."""
    rows: list[tuple[int, int, bytes]] = []
    windows = Windows(block.data)
    starts = candidate_suffixes(block, windows, answers, bits)
    if len(starts):
        doc = np.searchsorted(block.ends, starts, side="right")
        late = earlier_in_group(windows.at(starts, DEPTH), block.ids[doc])
        if late.any():
            rows.append(((number ^ number >> 32) % (1 << bits), SETTLED, pack_stretches(starts[late])))
        starts, doc = starts[~late], doc[~late]
    if len(starts):
        seed, spot = window_seeds(windows, starts)
        new = np.concatenate([[True], (np.diff(starts) > 1) | (np.diff(spot) != 0)])
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [len(starts)]]))
        # Smallest classes crowd at the low end of the range, so they are mixed once more before they are dealt.
        route = mix64(seed[first] & ~_OFFSET_BITS)
        order = np.argsort(route, kind="stable")
        for part, lo, hi in by_part(route[order], bits):
            own = order[lo:hi]
            own = own[np.argsort(first[own])]
            rows.append((part, SEGMENTS, pack_segments(block, starts[first[own]], count[own], doc[first[own]])))
    return {"part": [r[0] for r in rows], "block": [number] * len(rows), "kind": [r[1] for r in rows], "payload": [r[2] for r in rows]}


def pack_stretches(positions: np.ndarray) -> bytes:
    """Sorted positions as (gap before a run, run length)."""
    new = np.concatenate([[True], np.diff(positions) > 1])
    first = np.flatnonzero(new)
    return pack_sorted_pairs(positions[first], np.diff(np.concatenate([first, [len(positions)]])))


def pack_sorted_pairs(starts: np.ndarray, counts: np.ndarray) -> bytes:
    return pack_planes(np.diff(starts.astype(np.uint64), prepend=np.uint64(0))) + pack_planes(counts)


def unpack_stretches(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, rest = unpack_planes(data)
    counts, _ = unpack_planes(rest)
    return np.cumsum(gaps, dtype=np.uint64).astype(np.int64), counts.astype(np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] numbers, then those of the next."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def pack_segments(block: Block, starts: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> bytes:
    """Positions, window counts, document ids and the bytes of stretches of suffixes."""
    named, index = np.unique(block.ids[docs], return_inverse=True)
    text = block.data[ragged(starts, counts + DEPTH - 1)]
    head = pack_sorted_pairs(starts, counts) + pack_planes(named.astype(np.uint64)) + pack_planes(index)
    return head + text.tobytes()


def unpack_segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    gaps, data = unpack_planes(data)
    counts, data = unpack_planes(data)
    named, data = unpack_planes(data)
    index, data = unpack_planes(data)
    return np.cumsum(gaps, dtype=np.uint64).astype(np.int64), counts.astype(np.int64), named.astype(np.int64)[index.astype(np.int64)], data


def sort_bucket(table: pa.Table) -> pa.Table:
    """One suffix bucket: which of its suffixes start in a smaller document too, as stretches for their blocks."""
    blocks, kinds, payloads = (table[n].to_pylist() for n in ("block", "kind", "payload"))
    out: list[tuple[int, bytes]] = [(b, p) for b, k, p in zip(blocks, kinds, payloads) if k == SETTLED]
    sent = [(b, *unpack_segments(p)) for b, k, p in zip(blocks, kinds, payloads) if k == SEGMENTS]
    if sent:
        starts, counts, docs = (np.concatenate([s[i] for s in sent]) for i in (1, 2, 3))
        data = np.frombuffer(b"".join(s[4] for s in sent), dtype=np.uint8)
        widths = counts + DEPTH - 1
        suffix = ragged(np.cumsum(widths) - widths, counts)
        late = earlier_in_group(Windows(data).at(suffix, DEPTH), np.repeat(docs, counts))
        owner = np.repeat(np.repeat(np.arange(len(sent)), [len(s[1]) for s in sent]), counts)
        place = ragged(starts, counts)
        cuts = np.searchsorted(owner, np.arange(len(sent) + 1))
        for i, (block, *_) in enumerate(sent):
            own = place[cuts[i]:cuts[i + 1]][late[cuts[i]:cuts[i + 1]]]
            if len(own):
                out.append((block, pack_stretches(own)))
    return pa.table({"block": [b for b, _ in out], "kind": [SETTLED] * len(out), "payload": [p for _, p in out]}, schema=arrow_schema(ANSWERS))


def without_repeats(block: Block, stretches: list[bytes]) -> dict[str, list]:
    """Per document: bytes, removed bytes, maximal removed runs and what is kept."""
    size = len(block.data) + 1
    depth = np.zeros(size, dtype=np.int32)
    for starts, counts in map(unpack_stretches, stretches):
        np.add.at(depth, starts, 1)
        np.subtract.at(depth, starts + counts + DEPTH - 1, 1)
    gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
    out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
    for doc, start, end in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist()):
        own = gone[start:end]
        removed = int(np.count_nonzero(own))
        runs = int(np.count_nonzero(own[1:] & ~own[:-1]) + own[0]) if removed else 0
        kept = block.data[start:end][~own].tobytes() if removed else block.raw[start:end]
        for name, value in zip(out, (None if doc == LAST_ID else doc, end - start, removed, runs, kept)):
            out[name].append(value)
    return out


def dedup_passages(docs: DataFrame, digest_only: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; with ``digest_only`` kept is the sha256 in hex."""
    blocks = write_blocks(docs)
    bits = part_bits(blocks, BYTES_PER_PART)
    cover = map_blocks(blocks, lambda n, b, _: iter([send_cover(n, b, bits)]), PACKED)
    elsewhere = held_elsewhere(cover)

    def suffixes(number, block, answers):
        yield send_suffixes(number, block, answers, bits)

    sent = map_blocks(blocks, suffixes, PACKED, elsewhere)
    late = sent.groupBy("part").applyInArrow(sort_bucket, ANSWERS)

    def finish(_, block, answers):
        found = without_repeats(block, [p for _, p in answers])
        if digest_only:
            found["kept"] = [hashlib.sha256(k).hexdigest() for k in found["kept"]]
        yield found

    kept = "string" if digest_only else "binary"
    return map_blocks(blocks, finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kept}", late)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_passages(documents(spark, folder), digest_only=True).select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))

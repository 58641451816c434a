"""Texts in blocks, and exchanges of 64-bit keys between blocks.

A block holds the texts of a few thousand documents. Each block sends its distinct keys, sorted and packed as byte
planes of their differences, to parts of the key range; a part sees all blocks' keys of its range, and sends back
to every block which of its keys other blocks hold as well. Rows are packed arrays, so the shuffle moves a few bytes
per key, and a key that every document holds crosses it once per block.

Blocks are written once, bucketed by their number, so that answers join them without moving the texts again.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.batches import arrow_schema
from pulsegrid.llm.common import LAST_ID
from pulsegrid.session import shared_folder

#: Text in a block; more of it means fewer, larger packed rows and more memory in a task.
BLOCK_BYTES = 2 << 20
BLOCKS = "block long, ids binary, lengths binary, data binary, n_bytes long"
ANSWERS = "block long, kind int, payload binary"
PACKED = "part int, block long, kind int, payload binary"


def pack_planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes: planes of high zero bytes are left out."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(values).to_bytes(6, "little") + width.to_bytes(1, "little") + planes.tobytes()


def unpack_planes(data: bytes) -> tuple[np.ndarray, bytes]:
    """The numbers, and what follows them."""
    count, width = int.from_bytes(data[:6], "little"), data[6]
    out = np.zeros((count, 8), dtype=np.uint8)
    end = 7 + count * width
    out[:, :width] = np.frombuffer(data[7:end], dtype=np.uint8).reshape(width, count).T
    return out.reshape(-1).view(np.uint64), data[end:]


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    gaps, _ = unpack_planes(data)
    return np.cumsum(gaps, dtype=np.uint64)


def in_sorted(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys


def repeated(sorted_keys: np.ndarray) -> np.ndarray:
    """Distinct keys that occur more than once."""
    same = sorted_keys[1:] == sorted_keys[:-1]
    return np.unique(sorted_keys[1:][same])


def distinct(sorted_keys: np.ndarray) -> np.ndarray:
    return sorted_keys[np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])] if len(sorted_keys) else sorted_keys


def by_part(keys: np.ndarray, bits: int, width: int = 64) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted keys of ``width`` bits; a part is a range of the key's upper bits."""
    if not len(keys):
        return
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits) if bits else np.zeros(0, dtype=np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    for part in np.flatnonzero(np.diff(cuts)):
        yield int(part), int(cuts[part]), int(cuts[part + 1])


class Block:
    def __init__(self, ids: bytes, lengths: bytes, data: bytes):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.lengths = np.frombuffer(lengths, dtype=np.int64)
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.raw = data
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths


def write_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in blocks, from the partitions they are in: no shuffle. A missing id is LAST_ID."""

    fields = arrow_schema(BLOCKS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "block": [number], "ids": [np.array(ids, dtype=np.int64).tobytes()],
                "lengths": [np.array([len(t) for t in texts], dtype=np.int64).tobytes()],
                "data": [b"".join(texts)], "n_bytes": [held],
            }, schema=fields)

        for batch in batches:
            for doc, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                ids.append(doc)
                texts.append((text or "").encode("utf-8", "replace"))
                held += len(texts[-1])
                if held >= BLOCK_BYTES:
                    yield block()
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield block()

    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(text_col).alias("text"))
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.mapInArrow(gather, BLOCKS).write.bucketBy(buckets, "block")
     .option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name))
    return spark.table(name)


def part_bits(blocks: DataFrame, bytes_per_part: int) -> int:
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(0, math.ceil(math.log2(max(1, total / bytes_per_part))))


def map_blocks(blocks: DataFrame, each: Callable[[int, Block, list[tuple[int, bytes]]], Iterator[dict]], schema: str,
               answers: DataFrame | None = None) -> DataFrame:
    """Rows of ``each(number, block, answers to it)``; ``answers`` has (block, kind, payload)."""
    if answers is None:
        joined = blocks.select("block", "ids", "lengths", "data", F.lit(None).cast("array<struct<kind:int,payload:binary>>").alias("answers"))
    else:
        gathered = answers.groupBy("block").agg(F.collect_list(F.struct("kind", "payload")).alias("answers"))
        joined = blocks.join(gathered, "block", "left").select("block", "ids", "lengths", "data", "answers")

    fields = arrow_schema(schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch[name][i].as_py() for name in batch.schema.names}
                got = [(a["kind"], a["payload"]) for a in row["answers"] or ()]
                for columns in each(row["block"], Block(row["ids"], row["lengths"], row["data"]), got):
                    yield pa.RecordBatch.from_pydict(columns, schema=fields)

    return joined.mapInArrow(over, schema)


def send_keys(number: int, classes: np.ndarray, bits: int) -> dict[str, list]:
    """Packed rows for a block's classes, shortened to keys: fewer bits pack better, and a key that two blocks share by
    chance only keeps a class that a later, exact step drops."""
    keys = distinct(np.sort(short_keys(classes, bits)))
    rows = [(part, pack_sorted(keys[lo:hi])) for part, lo, hi in by_part(keys, bits, key_width(bits))]
    return {"part": [p for p, _ in rows], "block": [number] * len(rows), "kind": [0] * len(rows), "payload": [b for _, b in rows]}


def key_width(bits: int) -> int:
    """Bits of a key that make chance matches about one in a thousand: a part holds some 2^22 keys, so ten more."""
    return min(64, bits + 32)


def short_keys(classes: np.ndarray, bits: int) -> np.ndarray:
    return classes >> np.uint64(64 - key_width(bits))


def held_twice(classes: np.ndarray, own: np.ndarray, answers: list[tuple[int, bytes]], bits: int) -> np.ndarray:
    """Which classes another block holds as well, or occur twice among ``own``."""
    elsewhere = union_sorted([unpack_sorted(p) for _, p in answers])
    return in_sorted(elsewhere, short_keys(classes, bits)) | in_sorted(repeated(np.sort(own)), classes)


def held_elsewhere(sent: DataFrame) -> DataFrame:
    """(block, kind, payload): the keys of each block that some other block sent as well."""

    def part(table: pa.Table) -> pa.Table:
        arrays = [unpack_sorted(b) for b in table["payload"].to_pylist()]
        shared = repeated(np.sort(np.concatenate(arrays)))
        found = [a[in_sorted(shared, a)] for a in arrays]
        rows = [(b, pack_sorted(f)) for b, f in zip(table["block"].to_pylist(), found) if len(f)]
        return pa.table({"block": [b for b, _ in rows], "kind": [0] * len(rows), "payload": [p for _, p in rows]}, schema=arrow_schema(ANSWERS))

    return sent.groupBy("part").applyInArrow(part, ANSWERS)


def union_sorted(arrays: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(arrays)) if arrays else np.zeros(0, dtype=np.uint64)

"""Documents in blocks: one row holds some megabytes of text, so that tasks can summarise a block
before anything is shuffled and get one answer per block back.

A block is a row (block, kind, n_bytes, payload) of a stored table; its id does not change
when a task is repeated, since the table is written once. ``exchange`` brings rows that
belong together into one task, sorted, so that a task sees one group after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import python_tasks, stored
from ledgerflow.llm.text import pieces, utf8

#: Text bytes of a block (a longer document is a block of its own).
BLOCK_BYTES = 8 << 20


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays as one compressed value; integer arrays wider than a byte are stored byte plane by byte plane."""
    head, body = [], []
    for a in arrays:
        head.append(f"{a.dtype.str}:{len(a)}")
        raw = np.ascontiguousarray(a).view(np.uint8)
        body.append((raw.reshape(-1, a.dtype.itemsize).T if a.dtype.itemsize > 1 else raw).tobytes())
    text = ",".join(head).encode()
    return zstandard.ZstdCompressor(level=level).compress(
        len(text).to_bytes(4, "little") + text + b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for item in raw[4:at].decode().split(",") if at > 4 else ():
        kind, n = item.split(":")
        dtype, n = np.dtype(kind), int(n)
        part = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at)
        if dtype.itemsize > 1:
            part = np.ascontiguousarray(part.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)
        out.append(part)
        at += n * dtype.itemsize
    return out


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    """Differences of ascending keys (small ones compress well); ``np.cumsum`` gives the keys back."""
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values (none of them -1)."""
    first = np.flatnonzero(np.diff(values, prepend=-1))
    return zip(first, [*first[1:], len(values)] if len(first) else (), strict=True)


class Block:
    """ids (and which are null), the UTF-8 bytes of all texts, and where each text begins."""

    def __init__(self, payload: bytes):
        self.ids, null, self.offsets, self.data = unpack(payload)
        self.null = null.astype(bool)


def to_blocks(docs: DataFrame, kind: Column, name: str, max_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Store ``docs`` (doc_id, text) as blocks; documents of different ``kind`` (an int) never share one."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def row(kind: int) -> pa.RecordBatch:
            nonlocal number
            ids = np.concatenate([p[0] for p in held[kind]])
            null = np.concatenate([p[1] for p in held[kind]])
            lengths = np.concatenate([p[2] for p in held[kind]])
            offsets = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(lengths, out=offsets[1:])
            data = np.concatenate([p[3] for p in held[kind]])
            number += 1
            held[kind], size[kind] = [], 0
            return pa.record_batch([pa.array([number]), pa.array([kind], pa.int32()), pa.array([len(data)], pa.int64()),
                                    pa.array([pack(ids, null, offsets, data)], pa.binary())],
                                   names=["block", "kind", "n_bytes", "payload"])

        for part in pieces(batches, 1, max_bytes):
            kinds = part.column(2).to_numpy(zero_copy_only=False)
            for k in np.unique(kinds):
                some = part.filter(pa.array(kinds == k))
                data, offsets = utf8(some.column(1))
                null = some.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                ids = some.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                if size.get(k, 0) and size[k] + len(data) > max_bytes:
                    yield row(k)
                held.setdefault(k, []).append((ids, null, np.diff(offsets), data.copy()))
                size[k] = size.get(k, 0) + len(data)
        for k in sorted(held):
            if held[k]:
                yield row(k)

    plain = docs.select("doc_id", "text", kind.cast("int").alias("kind"))
    return stored(plain.mapInArrow(run, "block long, kind int, n_bytes long, payload binary"), name)


def exchange(df: DataFrame, parts: int, by: str, *then: str) -> DataFrame:
    """Rows of one ``by`` in one task, one group after the other, in the order of ``then``."""
    return df.repartition(parts, by).sortWithinPartitions(by, *then)


def grouped(batches: Iterator[pa.RecordBatch], by: int = 0) -> Iterator[tuple[int, list[tuple]]]:
    """Groups of consecutive rows with equal column ``by`` (as Python values)."""
    group, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[by] != group:
                if rows:
                    yield group, rows
                group, rows = row[by], []
            rows.append(row)
    if rows:
        yield group, rows

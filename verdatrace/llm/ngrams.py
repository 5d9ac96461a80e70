"""Byte n-grams packed into integers, sorted hash arrays, and packed count tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks the start (as context) and the end of a text; no byte of UTF-8.
EDGE = 0xFF
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Distinct keys that a task holds before it hands on what it has counted.
HELD_KEYS = 400_000


def mix(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well-spread high bits."""
    return (keys ^ (keys >> np.uint64(29))) * _ODD


class HashArray:
    """Distinct unsigned 64-bit keys in order of their hashes, with an index on the first bits of a hash."""

    def __init__(self, keys: np.ndarray):
        h = mix(np.ascontiguousarray(keys, np.uint64))
        #: Values for the keys belong in this order; it does not travel.
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        bits = max(1, int(len(h)).bit_length() - 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.append(np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(h)).astype(np.int32)
        self.deepest = int(np.diff(self.starts).max(initial=0))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "order"}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        h = mix(keys)
        bucket = (h >> self.shift).astype(np.int64)
        place = self.starts[bucket]
        out = np.full(len(keys), -1, np.int64)
        if not len(self.hashes):
            return out
        last = len(self.hashes) - 1
        hit = self.hashes[np.minimum(place, last)] == h
        out[hit] = place[hit]
        left = np.flatnonzero(~hit)
        for step in range(1, self.deepest):
            if not len(left):
                break
            at = place[left] + step
            left, at = left[keep := at < self.starts[bucket[left] + 1]], at[keep]
            hit = self.hashes[at] == h[left]
            out[left[hit]] = at[hit]
            left = left[~hit]
        return out


def windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size``-grams that end at each byte and at the end of each text, and the number of them by text.

    A text's first bytes have ``EDGE`` for what precedes them; its last n-gram
    ends with ``EDGE``.  The newest byte is the lowest of an n-gram's integer.
    """
    pad = bytes([EDGE]) * (size - 1)
    u = np.frombuffer(pad + b"".join([x + b"\xff" + pad for x in texts]), np.uint8)
    n = len(u) - size + 1
    code = u[:n].astype(np.uint64)
    for k in range(1, size):
        code = (code << np.uint64(8)) | u[k : n + k]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    keep = np.ones(n, bool)
    ends = np.cumsum(lengths + size - 1)
    for k in range(1, size):
        keep[ends[ends - k < n] - k] = False
    return code[keep], lengths


class Counts:
    """Counts of 64-bit keys that a task has seen."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > 4 * HELD_KEYS:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return total(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))

    def full(self) -> bool:
        return self.held > 2 * HELD_KEYS

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out, self.parts, self.held = self.merged(), [], 0
        return out


def total(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the bucket that a key is dealt to."""
    return (mix(mix(keys)) >> np.uint64(33)).astype(np.int64) % buckets


def packed(kind: int, keys: np.ndarray, counts: np.ndarray, buckets: int, dealt_by: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows ``kind, bucket, keys, counts`` of one count table, dealt by the hash of the key or of ``dealt_by``."""
    bucket = bucket_of(keys if dealt_by is None else dealt_by, buckets)
    order = np.argsort(bucket, kind="stable")
    keys, counts = keys[order], counts[order]
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(full), kind, np.int32)), pa.array(full.astype(np.int32)), pa.array([keys[cuts[b] : cuts[b + 1]].astype("<u8").tobytes() for b in full], pa.binary()), pa.array([counts[cuts[b] : cuts[b + 1]].astype("<i8").tobytes() for b in full], pa.binary())],
        names=["kind", "bucket", "keys", "counts"],
    )


def sum_packed(table: pa.Table) -> pa.Table:
    """One bucket's rows summed to one row with ``distinct`` keys and their ``total``."""
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u8")
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i8")
    keys, counts = total(keys, counts)
    return pa.table({"kind": table.column("kind")[:1], "bucket": table.column("bucket")[:1], "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "distinct": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})


PACKED = "kind int, bucket int, keys binary, counts binary"
SUMMED = PACKED + ", distinct bigint, total bigint"


def sum_buckets(df: DataFrame) -> DataFrame:
    """Sum packed counts; a bucket has about as many keys as any other, whatever their frequencies."""
    return df.groupBy("kind", "bucket").applyInArrow(sum_packed, SUMMED)


def bucket_count(docs: DataFrame, per: int = 1000) -> int:
    """Buckets in proportion to the documents, so that one bucket's size does not grow with the input."""
    return int(min(1 << 17, max(16, docs.agg(F.count("*")).first()[0] // per)))

"""Number arrays as compact bytes, and hash ranges, for operators whose chunks of texts ask buckets of hashes."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def packed(values: np.ndarray) -> bytes:
    """An array as compressed planes of bytes."""
    if not len(values):
        return pickle.dumps((0, values.dtype.str, b""))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pickle.dumps((len(values), values.dtype.str, pa.compress(planes.tobytes(), codec="zstd", asbytes=True)))


def unpacked(data: bytes) -> np.ndarray:
    size, kind, body = pickle.loads(data)
    kind = np.dtype(kind)
    if not size:
        return np.zeros(0, kind)
    raw = pa.decompress(body, decompressed_size=size * kind.itemsize, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(kind.itemsize, size).T.copy().view(kind).ravel()


def small(values: np.ndarray) -> np.ndarray:
    """The array in the smallest unsigned type that holds it."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def packed_sorted(hashes: np.ndarray) -> bytes:
    return packed(np.diff(hashes, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def bucket_of(hashes: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Bucket by range, so that sorted hashes are sorted by bucket; up to 2^32 buckets."""
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)


def filled(*of: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The buckets that any of some sorted arrays names, ascending, and per array the cuts between them.

    A chunk sends to these alone: its rows are never more than its hashes, however many buckets there are.
    """
    named = np.unique(np.concatenate([b[np.flatnonzero(np.diff(b, prepend=b[:1] + np.uint64(1)))] for b in of]))
    return named.astype(np.int64), [np.append(np.searchsorted(b, named), len(b)) for b in of]


def in_batches(rows: Iterable[tuple[int, int, bytes]], most: int = 256) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, chunk, payload) as Arrow batches."""
    held: list[tuple[int, int, bytes]] = []

    def batch() -> pa.RecordBatch:
        bucket, chunk, payload = zip(*held, strict=True)
        arrays = [pa.array(bucket, pa.int64()), pa.array(chunk, pa.int64()), pa.array(payload, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["bucket", "chunk", "payload"])

    for row in rows:
        held.append(row)
        if len(held) == most:
            yield batch()
            held = []
    if held:
        yield batch()

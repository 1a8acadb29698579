"""Columnar postings: (token, owner) pairs travel as packed arrays, one row for many pairs.

A row of Spark costs tens of bytes and a microsecond; a pair here costs about nine bytes and some nanoseconds. Each
chunk of a task's pairs is cut by hash of the token into as many parts as there are shuffle partitions, so every part
sees all pairs of its tokens and holds an even share of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs that a task gathers before it hands them on.
CHUNK = 1 << 20
LOW = np.uint64((1 << 48) - 1)


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    """The part of a token, from its upper bits; rows carry the lower 48 bits only."""
    return ((tokens >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)


def squeeze(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsqueeze(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a batch's texts are not all Python strings at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin, and the length at the end."""
    n = len(sorted_values)
    if not n:
        return np.zeros(1, dtype=np.int64)
    return np.concatenate((np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))), [n]))


def cut_by_part(tokens: np.ndarray, owner_no: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, tokens, owner numbers) for each part; within a part pairs keep their order."""
    part = part_of(tokens, parts)
    order = np.argsort(part.astype(np.uint16) if parts <= 65536 else part, kind="stable")
    part, tokens, owner_no = part[order], tokens[order], owner_no[order]
    bounds = runs(part)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(part[lo]), tokens[lo:hi], owner_no[lo:hi]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def joined(batches: list[pa.RecordBatch], name: str, dtype: str) -> np.ndarray:
    """All bytes of a binary column as one array."""
    return np.frombuffer(b"".join(x for b in batches for x in column(b, name).to_pylist()), dtype=dtype)

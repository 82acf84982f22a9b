"""Byte n-grams of many texts at once, in bounded memory."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20


def texts_as_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], pad: int, block: int = BLOCK):
    """Pieces (data, starts, ends, owners): bytes with pad line feeds before each text.

    An n-gram with pad = n - 1 that ends inside [start, end) belongs to text
    ``owner``; long texts span several pieces, each with the bytes before it.
    """
    lead = b"\n" * pad
    parts, starts, ends, owners, size = [], [], [], [], 0

    def out():
        return np.frombuffer(b"".join(parts), np.uint8), np.array(starts), np.array(ends), np.array(owners)

    for i, t in enumerate(texts):
        for at in range(0, len(t), block):
            if size >= block:
                yield out()
                parts, starts, ends, owners, size = [], [], [], [], 0
            piece = t[at : at + block]
            before = (lead + t[max(0, at - pad) : at])[-pad:]
            parts += [before, piece]
            starts.append(size + pad)
            ends.append(size + pad + len(piece))
            owners.append(i)
            size += pad + len(piece)
    if parts:
        yield out()


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]; segments are in order, disjoint and not empty."""
    edges = np.empty(2 * len(starts), np.int64)
    edges[::2], edges[1::2] = starts, ends
    if edges[-1] == len(values):
        edges = edges[:-1]
    return np.add.reduceat(values, edges, axis=0)[::2]

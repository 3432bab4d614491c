"""Arrow and numpy helpers for task code: words of many texts at once, caches that live as long as a worker."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from attest.session import ship_with_plans

ship_with_plans(__name__)


def process_cache(name: str) -> dict:
    """A dictionary that later tasks of the same Python worker find again; nothing depends on its contents.

    A worker keeps one at a time: that of the operator it works for.
    """
    module = sys.modules.setdefault("_attest_llm_caches", types.ModuleType("_attest_llm_caches"))
    held = module.__dict__.setdefault("held", {})
    if name not in held:
        held.clear()
        held[name] = {}
    return held[name]


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts with one space after each, and where each text starts; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    parts = [b"" if t is None else t for t in texts.cast(pa.large_binary()).to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    return np.frombuffer(b" ".join([*parts, b""]), np.uint8), starts


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` in order (binary), and the index of each text's first word, with the end."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    solid = ~space
    before = np.concatenate([[True], space[:-1]])
    first = np.flatnonzero(solid & before)
    last = np.flatnonzero(space & ~before)  # every text is followed by a space
    offsets = np.concatenate([[0], np.cumsum(last - first)])
    body = data[solid]
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)]
    )
    return words, np.searchsorted(first, starts)


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4_000_000):
    """Slices of a batch whose texts have about ``most_bytes`` bytes or are one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(lengths):
        room = np.cumsum(lengths[at:])
        n = max(1, int(np.searchsorted(room, most_bytes, "right")))
        yield batch.slice(at, n)
        at += n

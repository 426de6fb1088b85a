"""Texts as arrays inside a task: blocks of a batch, code points, folding."""

from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

BLOCK_CHARS = 2_000_000     # characters handled at once


def ship_by_value() -> None:
    """Pickle this package's functions by value, so executors need not have it."""
    cloudpickle.register_pickle_by_value(sys.modules["arborform"])


def worker_state(name: str, build):
    """``build()``, kept for the life of the Python worker and its later tasks."""
    held = sys.modules.setdefault("_arborform_worker", types.ModuleType("_arborform_worker")).__dict__
    if name not in held:
        held[name] = build()
    return held[name]


def release(*names: str) -> None:
    """Drop what ``worker_state`` keeps under these names and hand freed memory
    back, so a worker that waits for its next stage holds little."""
    held = sys.modules.setdefault("_arborform_worker", types.ModuleType("_arborform_worker")).__dict__
    for name in names:
        held.pop(name, None)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc
    if trim:
        trim(0)


def blocks(texts: list[str], limit: int = BLOCK_CHARS):
    """(first, end) runs of texts that hold about ``limit`` characters; a longer
    text is a run of its own."""
    first = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and the start of each text (one more than texts)."""
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cps, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def column(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()

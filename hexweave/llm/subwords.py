"""Vectorised pieces of text: cut a batch into chunks, code each distinct chunk once, put the codes together.

A chunk runs from one space to the next, and no token reaches over that border, so a text's ids are its
chunks' ids one after the other. A batch has far fewer distinct chunks than chunks, and only those meet
Python code; all else is array work on the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text worked on at once, and distinct chunks kept per worker: bounds on memory, not on work.
SLICE_BYTES = 2 << 20
MEMO = 300_000


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts hold about `SLICE_BYTES`; a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(ends, done + SLICE_BYTES, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])
    pa.default_memory_pool().release_unused()  # workers live on after their task


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the offsets of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts])  # no offset of a slice
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    content = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return content, at - at[0]


def chunked(content: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Distinct chunks, as texts, and the number of each chunk's; chunks begin at the sorted ``starts``."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    offsets = np.append(starts, len(content)).astype(np.int64)
    array = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(content)))
    coded = array.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def ragged(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``which`` of a ragged table one after the other, and the running total of their lengths (from 0)."""
    lengths = np.diff(offsets)[which]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    where = np.arange(ends[-1]) + np.repeat(offsets[:-1][which] - ends[:-1], lengths)
    return flat[where], ends


class Coder:
    """Ids of chunks, each distinct one computed once as long as it is remembered."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def table(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all remembered chunks one after the other, offsets, and the number of each given chunk."""
        if len(self.known) > MEMO:
            self.forget()
        known = self.known
        new = [c for c in chunks if c not in known]
        if new:
            coded = self.encode(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            lengths = np.fromiter(map(len, coded), np.int64, len(coded))
            ids = np.fromiter(chain.from_iterable(coded), np.uint32, int(lengths.sum()))
            self.flat = np.concatenate([self.flat, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        return self.flat, self.offsets, np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))

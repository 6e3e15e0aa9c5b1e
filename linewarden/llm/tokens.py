"""Words of whole Arrow batches, without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 22


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each have about ``SLICE_BYTES``."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        ends = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + SLICE_BYTES, "right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def split(texts: pa.Array, mapped: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
    """Row number of each word, and the words, of binary texts without nulls.

    Words are cut at ASCII white space; ``mapped`` replaces bytes before.
    """
    texts = pa.concat_arrays([texts])  # drops the offset of a slice
    _, offsets, data = texts.buffers()
    if mapped is not None and data is not None:
        data = pa.py_buffer(mapped[np.frombuffer(data, np.uint8)])
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    plain = pa.Array.from_buffers(kind, len(texts), [None, offsets, data])
    lists = pc.ascii_split_whitespace(plain)
    rows = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    found = lists.values
    some = pc.greater(pc.binary_length(found), 0)
    return rows[some.to_numpy(False)], found.filter(some)


def codes(found: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each word in the order of first occurrence, and the distinct words."""
    coded = found.dictionary_encode()
    return coded.indices.to_numpy(False).astype(np.int64), coded.dictionary


#: White space of ASCII: the only bytes that part words.
GAPS = np.zeros(256, bool)
GAPS[[0x20, *range(0x09, 0x0E)]] = True


def _powers(seed: int, n: int) -> np.ndarray:
    powers = np.full(n + 1, seed | 1, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First word of each binary text and one more, and two 64-bit hashes of each word, as rows.

    A hash is a polynomial over random numbers of the bytes; nothing is made for a single word.
    """
    texts = pa.concat_arrays([texts])  # drops the offset of a slice
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int32)[: len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[: places[-1]]
    solid = ~GAPS[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    # A text starts a word even where the one before ends without a gap.
    starts = places[:-1][places[:-1] < len(raw)]
    first[starts] = solid[starts]
    at = np.flatnonzero(first)
    counts = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])[places]
    lanes = np.zeros((2, len(at)), np.uint64)
    if not len(at):
        return counts, lanes
    # Place of each byte in its word; what lies before the first word belongs to none.
    own = np.repeat(at, np.diff(np.append(at, len(raw))))
    inside = np.concatenate([np.zeros(at[0], np.int64), np.arange(at[0], len(raw)) - own])
    inside[~solid] = 0
    longest = int(inside.max())
    rng = np.random.Generator(np.random.PCG64(20240229))
    for lane, seed in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        of_byte = rng.integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        of_byte[GAPS] = 0
        value = of_byte[raw] * _powers(seed, longest)[inside]
        lanes[lane] = np.add.reduceat(value, at)
    return counts, lanes


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Join batches until their texts have ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, column):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)

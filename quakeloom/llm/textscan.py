"""Vectorised scans over the texts of an Arrow batch, used inside mapInArrow tasks.

A batch's texts lie in one byte buffer with an offset per document, so that every scan is a few
numpy passes over the buffer whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one scan holds at once; a longer single text is scanned alone.
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into row ranges of at most `limit` bytes of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and, per document, where they start and end."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True inside each document: start, end (exclusive) and document of each."""
    n = len(mask)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:n]
    last[:-1] &= ~mask[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than ASCII white space: start, end and document of each word."""
    return spans(~_SPACE[data], offsets)


def per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each document are marked."""
    running = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def mix(keys: np.ndarray) -> np.ndarray:
    """Scramble 64-bit keys one to one, so that every bit of the result depends on all bits."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start at `starts`."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as an Arrow array."""
    sizes = ends - starts
    stops = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(stops), pa.py_buffer(data[ranges(starts, sizes)])])


def span_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per byte span, the same exactly for equal bytes of this buffer."""
    return strings(data, starts, ends).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def row_ids(*columns: np.ndarray) -> np.ndarray:
    """A number per row, the same exactly for rows that are equal in all columns.

    Rows are sorted by a key of all columns; should rows that differ meet in a key, by the columns themselves.
    """
    n = len(columns[0])
    keys = np.zeros(n, np.uint64)
    for c in columns:
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + c.astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    differ = lambda: np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    new = differ()
    if (new & (keys[order][1:] == keys[order][:-1])).any():
        order = np.lexsort(columns[::-1])
        new = differ()
    out = np.empty(n, np.int64)
    out[order] = np.concatenate([[0], np.cumsum(new)])[:n]
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of each byte span; equal spans are hashed once."""
    found = strings(data, starts, ends).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    each = np.fromiter(map(digest, found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
    return each[found.indices.to_numpy(zero_copy_only=False)]


def gram_hashes(keys: np.ndarray, groups: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of runs of `size` consecutive items of one group, and the index of each run's first item."""
    n = len(keys) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + keys[i : i + n]
    first = np.flatnonzero(groups[:n] == groups[size - 1 :])
    return mix(total[first]), first


def window_hashes(data: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """A polynomial key of the `size` bytes that start at each position, by doubling. base: odd."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, out, power, block, width = 0, np.zeros(n, np.uint64), 1, _BYTE_KEYS[data], 1
    left = size
    while left:
        if left & 1:
            out += block[done : done + n] * np.uint64(power)
            power = power * base % 2**64
            done += width
        left >>= 1
        if left:
            block = block[:-width] + block[width:] * np.uint64(base)
            base = base * base % 2**64
            width *= 2
    return mix(out)


def code_points(data: np.ndarray) -> np.ndarray:
    """How many code points start before each byte position, the end included."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])

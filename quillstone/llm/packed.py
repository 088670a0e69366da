"""Blocks of documents and packed exchanges between them.

A block is a bounded stretch of rows.  What a block needs to know about its
distinct words (or pairs) goes out as packed arrays, one row for each block and
hash range, is worked out once for each distinct key, and comes back to the block
in the same order.  Hash ranges split keys evenly and each block sends a key once,
so a frequent key costs one entry a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Text bytes after which a block is closed; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes that a row counts besides its text, so that a block of very short texts has a bounded number of rows.
ROW_BYTES = 128


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers, by byte planes, compressed."""
    values = np.ascontiguousarray(values)
    width = next((w for w in (1, 2, 4) if not len(values) or values.max() < 1 << (8 * w)), 8)
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:], max_output_size=1 << 31), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def pack_words(words: pa.Array) -> tuple[bytes, bytes]:
    """Lengths and contents of byte strings."""
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2]
    content = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
    return pack(np.diff(offsets)), zstandard.ZstdCompressor(level=3).compress(bytes(content))


def unpack_words(lengths: bytes, content: bytes) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(unpack(lengths)))).astype(np.int64)
    data = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 31)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def mix64(values: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 (public domain), on unsigned 64-bit integers."""
    x = values.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each byte string, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal hash ranges each hash lies in; monotone in the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def cut_blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Tables of consecutive rows with about ``most`` bytes of text each."""
    held, size = [], 0
    for batch in batches:
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), float))
        start = 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, start = [], 0, i
            size += n + ROW_BYTES
        if start < len(sizes):
            held.append(batch.slice(start))
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def block_number(seq: int) -> int:
    """A block's identity: its task's partition and its place there."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32 | seq


def by_hash(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words in hash order and the new place of each."""
    order = np.argsort(word_hashes(words), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return words.take(pa.array(order)), place


def stretches(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, start, end) of each run in sorted ``keys``."""
    if not len(keys):
        return []
    starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
    ends = np.concatenate((starts[1:], [len(keys)]))
    return [(int(keys[a]), int(a), int(b)) for a, b in zip(starts, ends, strict=True)]

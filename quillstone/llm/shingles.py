"""Hashed five-word shingle sets of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillstone.llm.packed import mix64, word_hashes

WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct shingle hashes, ascending, one text after the other.

    Words are runs of anything but ASCII white space.  A text of one to four words has them as its one
    shingle; an empty or null one has none.
    """
    lists = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    flat, parents = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    encoded = flat.filter(real).dictionary_encode()
    doc = parents.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.bincount(doc, minlength=len(texts))
    if not len(doc):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    words = word_hashes(encoded.dictionary)[encoded.indices.to_numpy(zero_copy_only=False)]
    with np.errstate(over="ignore"):
        n = len(words) - WORDS + 1
        if n > 0:
            rolled = words[:n].copy()
            for k in range(1, WORDS):
                rolled = rolled * _STEP + words[k : k + n]
            whole = doc[:n] == doc[WORDS - 1 :]
            hashes, owner = mix64(rolled[whole]), doc[:n][whole]
        else:
            hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        starts = np.cumsum(counts) - counts
        short = np.flatnonzero((counts > 0) & (counts < WORDS))
        if len(short):
            value = np.full(len(short), 1, np.uint64)
            for k in range(WORDS - 1):
                has = counts[short] > k
                value[has] = value[has] * _STEP + words[starts[short[has]] + k]
            hashes, owner = np.concatenate([hashes, mix64(value)]), np.concatenate([owner, short])
    order = np.argsort(hashes)
    small = owner.astype(np.uint16) if len(texts) <= 1 << 16 else owner
    order = order[np.argsort(small[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))

"""Words of texts as hashes, by array operations over the distinct words of a slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STRIP = ".,;:!?\"'()[]{}*#$%&|<>/\\-_=+~`@^"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Strings hashed at a time, which bounds the table of powers.
PIECE = 1 << 15


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial in its bytes (and their number), mixed."""
    parts = [_hashes(strings.slice(a, PIECE)) for a in range(0, len(strings), PIECE)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _hashes(strings: pa.Array) -> np.ndarray:
    raw = pc.cast(strings, pa.large_binary())
    edges = np.frombuffer(raw.buffers()[1], "<i8")[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]].astype(np.uint64) + np.uint64(1)
    start, end = edges[:-1] - edges[0], edges[1:] - edges[0]
    if len(_powers[0]) <= len(data):
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(2 * len(data) + 2, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    sums = np.append(np.uint64(0), np.cumsum(data * _powers[0][: len(data)]))
    return mix((sums[end] - sums[start]) * _powers[1][start] + (end - start).astype(np.uint64))


def clean_words(texts: pa.Array, marked: frozenset[str] = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of all texts (lower-cased, punctuation at its ends off; what is empty then falls out), whether it is
    one of `marked`, and the text it is in."""
    lists = pc.utf8_split_whitespace(texts)
    n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    d = pc.dictionary_encode(lists.flatten())
    words = pc.utf8_trim(pc.utf8_lower(d.dictionary), _STRIP)
    hashes = string_hashes(words)
    flags = pc.is_in(words, value_set=pa.array(sorted(marked), pa.string())).to_numpy(zero_copy_only=False)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    codes = d.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), n)
    keep = real[codes] if len(codes) else np.zeros(0, bool)
    codes, doc = codes[keep], doc[keep]
    return hashes[codes], flags[codes], doc

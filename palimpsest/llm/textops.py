"""Word and shingle hashing over whole Arrow batches, vectorised over bytes.

A batch of texts is one byte array with offsets. Word borders come from a 256-entry class table, word hashes from
one pass per eight bytes within words, shingle hashes from k shifted sums. No Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_GOLD, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Longer words are hashed one by one, so that one endless word does not cost many passes.
LONG_WORD = 48
#: Bytes of text handled at once; one longer document is handled alone.
CHUNK = 1_000_000
#: Bits of the document's number in the sort key of a chunk; the rest holds the shingle's hash.
DOC_BITS = 14
HASH_BITS = 64 - DOC_BITS


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _GOLD
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


_STEP = U(0xD6E8FEB86659FD93)
#: Keeps the first 0 to 8 bytes of a little-endian word of eight.
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def classes(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(is a separator, byte in lower case) by byte. kind ``space``: words are runs of other than space and \\t-\\r;
    ``alnum``: runs of ASCII letters and digits and of bytes beyond ASCII. A-Z count as a-z in both."""
    sep = np.zeros(256, bool)
    if kind == "space":
        sep[[32, *range(9, 14)]] = True
    else:
        sep[:128] = True
        for lo, hi in ((48, 58), (65, 91), (97, 123)):
            sep[lo:hi] = False
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return sep, low


_CLASSES = {k: classes(k) for k in ("space", "alnum")}


def pieces(col: pa.Array, limit: int = CHUNK, rows: int = (1 << DOC_BITS) - 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a text column as (first row, bytes, offsets within the bytes), of so many bytes and rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    if col.null_count:
        lens = np.diff(off) * np.asarray(col.is_valid())
        if (np.diff(off) != lens).any():
            yield from pieces(col.fill_null(""), limit, rows)
            return
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start, end) of every word, in order."""
    sep, low = _CLASSES[kind]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    cut = np.ones(n + 1, bool)
    inside = ~sep[data]
    cut[1:n] = ~inside[: n - 1]
    cut[off[:-1][off[:-1] < n]] = True
    start = np.flatnonzero(inside & cut[:n])
    last = np.ones(n, bool)
    last[: n - 1] = ~inside[1:]
    ends = off[1:-1]
    last[ends[(ends > 0)] - 1] = True
    end = np.flatnonzero(inside & last) + 1
    doc = np.searchsorted(off, start, "right") - 1
    size = end - start
    h = size.astype(np.uint64) * _GOLD
    eight = np.ndarray((n + 1,), "<u8", np.concatenate([low[data], np.zeros(8, np.uint8)]), 0, (1,))
    h = (h ^ (eight[start] & _KEEP[np.minimum(size, 8)])) * _STEP
    live = np.flatnonzero(size > 8)
    for i in range(8, min(LONG_WORD, int(size.max(initial=0))), 8):
        live = live[size[live] > i]
        x = eight[start[live] + i] & _KEEP[np.minimum(size[live] - i, 8)]
        g = h[live]
        h[live] = ((g ^ (g >> U(29))) ^ x) * _STEP
    for w in np.flatnonzero(size > LONG_WORD):
        h[w] ^= U(xxhash.xxh64_intdigest(low[data[start[w] : end[w]]].tobytes()))
    return mix(h), doc, start, end


def shingles(h: np.ndarray, doc: np.ndarray, k: int, whole: bool = True, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of k words; with fewer words, the whole sequence as one if ``whole``.

    Another seed gives another, independent hash of the same shingles, in the same order."""
    n = len(h)
    if not n:
        return h, doc
    coef = mix(np.arange(1, k + 1, dtype=np.uint64) * U(2) + U(seed << 20)) | U(1)
    out, at = np.zeros(0, np.uint64), doc[:0]
    if n >= k:
        full = doc[: n - k + 1] == doc[k - 1 :]
        s = h[: n - k + 1] * coef[0]
        for i in range(1, k):
            s += h[i : n - k + 1 + i] * coef[i]
        out, at = mix(s[full]), doc[: n - k + 1][full]
    if whole:
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[first, n])
        for w in range(1, k):
            f = first[count == w]
            if len(f):
                s = np.full(len(f), w, np.uint64) * _GOLD
                for i in range(w):
                    s = s + h[f + i] * coef[i]
                out, at = np.r_[out, mix(s)], np.r_[at, doc[f]]
    return out, at


def sets(out: np.ndarray, at: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes sorted by document, document, bounds by document); hashes keep HASH_BITS bits."""
    key = np.sort((at.astype(np.uint64) << U(HASH_BITS)) | (out >> U(DOC_BITS)))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    doc = (key >> U(HASH_BITS)).astype(np.int64)
    return key & U((1 << HASH_BITS) - 1), doc, np.searchsorted(doc, np.arange(docs + 1))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int, kind: str = "space"):
    """The distinct shingles of each document of a chunk; see sets()."""
    h, doc, _, _ = words(data, off, kind)
    out, at = shingles(h, doc, k)
    return sets(out, at, len(off) - 1)


def least(out: np.ndarray, at: np.ndarray, docs: int) -> np.ndarray:
    """The least hash, in all its 64 bits, of each document."""
    low = np.full(docs, ~U(0))
    np.minimum.at(low, at, out)
    return low


def ragged(lists: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from arrays."""
    off = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=off[1:])
    flat = np.concatenate(lists) if lists else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, kind))

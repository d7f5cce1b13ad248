"""Arrow text columns as flat byte arrays inside tasks: slabs, words, hashes, shingle sets.

Every function works on whole texts; a null text counts as empty unless a caller says otherwise.
"""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB = 1 << 20
SHINGLE = 5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words ``[^\x20\x09-\x0D]+`` in UTF-8.
PLAIN_WORD = np.ones(256, dtype=bool)
PLAIN_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in UTF-8, after lower-casing.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[48:58] = ALNUM_WORD[97:123] = ALNUM_WORD[128:] = True


def text_array(column) -> pa.Array:
    """A string column as one array without nulls; not copied where it is one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and n+1 offsets into them that start at 0."""
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offs = np.frombuffer(offsets, kind)[texts.offset:texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def hand_back() -> None:
    """Give freed memory back to the system: workers live on between tasks and operators."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slabs(texts: pa.Array, target: int = SLAB) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``target`` bytes; a longer text stands alone."""
    n = len(texts)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    cum = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < n:
        to = int(np.searchsorted(cum, cum[at] + target, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to
    hand_back()


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts and ends (byte positions) of all words, and the text each is in."""
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_ROOT = 0x9E3779B97F4A7C15 | 1
_ROOT_INVERSE = pow(_ROOT, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) <= n:
        size = (n // (1 << 18) + 1 << 18) + 1
        up = np.full(size, _ROOT, np.uint64)
        down = np.full(size, _ROOT_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers, _inverse = np.cumprod(up), np.cumprod(down)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n+1 running sums from which ``span_hash`` takes the hash of any span, of bytes or of 64-bit
    hashes of words, in O(1)."""
    n = len(data)
    _grow(n)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE[data] if data.dtype == np.uint8 else data) * _powers[:n], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix64((prefix[ends] - prefix[starts]) * _inverse[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, target: int = SLAB):
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and n+1 offsets into them.

    One long text is worked through in stretches of about ``target`` bytes that end between words.
    """
    if len(offsets) > 2 or len(data) <= target:
        starts, ends, doc = words(data, offsets, PLAIN_WORD)
        return span_hash(prefix_hash(data), starts, ends), np.searchsorted(
            doc, np.arange(len(offsets)))
    out, at = [], 0
    while at < len(data):
        end = min(at + target, len(data))
        while end < len(data) and PLAIN_WORD[data[end]]:
            inside = PLAIN_WORD[data[end:end + target]]
            end += len(inside) if inside.all() else int(inside.argmin())
        piece = data[at:end]
        starts, ends, _ = words(piece, np.array([0, len(piece)]), PLAIN_WORD)
        out.append(span_hash(prefix_hash(piece), starts, ends))
        at = end
    hashed = np.concatenate(out)
    return hashed, np.array([0, len(hashed)])


_STEP = mix64(np.arange(11, 11 + 16, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(word_hash: np.ndarray, doc: np.ndarray, n_docs: int, k: int = SHINGLE):
    """(hash, text) of every k-word window; a text of 1 to k-1 words gives one hash of them all."""
    n = len(word_hash)
    counts = np.bincount(doc, minlength=n_docs)
    full = np.zeros(0, np.uint64)
    at = np.zeros(0, np.int64)
    if n >= k:
        ok = doc[:n - k + 1] == doc[k - 1:]
        acc = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            acc += word_hash[j:n - k + 1 + j] * _STEP[j]
        full, at = mix64(acc[ok]), doc[:n - k + 1][ok]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])[short]
        acc = counts[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        for j in range(k - 1):
            has = counts[short] > j
            acc[has] += word_hash[first[has] + j] * _STEP[j]
        full = np.concatenate([full, mix64(acc)])
        at = np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        full, at = full[order], at[order]
    return full, at


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, sorted distinct shingle hashes, number of words) of every text, in order.

    A-Z is lower-cased; words are split at ASCII white space.
    """
    for lo, hi in slabs(texts):
        data, offsets = flat(texts.slice(lo, hi - lo))
        low = LOWER[data]
        starts, ends, doc = words(low, offsets, PLAIN_WORD)
        hashed = span_hash(prefix_hash(low), starts, ends)
        n_words = np.bincount(doc, minlength=hi - lo)
        full, at = shingle_hashes(hashed, doc, hi - lo)
        cut = np.searchsorted(at, np.arange(hi - lo + 1))
        for r in range(hi - lo):
            yield lo + r, np.unique(full[cut[r]:cut[r + 1]]), int(n_words[r])

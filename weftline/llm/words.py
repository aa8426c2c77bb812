"""Vectorised word hashing of Arrow string columns: 64-bit hashes of the words of many texts at once."""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18  # bytes hashed at a time, so that scratch arrays stay near 10 MB
LONG = 64  # words of more bytes are hashed one by one
_KEYS = np.random.default_rng(20_250_101).integers(0, 1 << 64, LONG // 8 + 1, dtype=np.uint64)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the low k bytes


def trim() -> None:
    """Give memory that this Python worker no longer uses back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def folded(word: str) -> np.ndarray:
    """For each byte its value with A-Z lower-cased, or 0 where it is in no word.

    word: "alnum" (ASCII letters and digits and whatever is not ASCII) or "space" (all but space and TAB to CR).
    """
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    if word == "alnum":
        lut[:0x30] = lut[0x3A:0x41] = lut[0x5B:0x61] = lut[0x7B:0x80] = 0
    else:
        lut[0x20] = lut[0x09:0x0E] = 0
        if word == "space":
            lut[0] = 0xC0  # a NUL is part of a word; 0xC0 occurs in no UTF-8
    return lut


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after another (nulls empty), and the offsets of its texts."""
    col = col.cast(pa.large_string()).fill_null("") if not pa.types.is_large_string(col.type) or col.null_count else col
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def _word_hashes(b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the words b[first:last], of which eight bytes at a time are mixed in; b has eight bytes beyond the last word.

    Each step is a bijection of the state, so different words of up to eight bytes and one length never collide.
    """
    n = last - first
    h = mix64(n.astype(np.uint64) ^ _KEYS[-1])
    eight = np.ndarray((len(b) - 7,), "<u8", b.data, 0, (1,))
    own = np.arange(len(n))
    for j in range(LONG // 8):
        own = own[n[own] > 8 * j] if j else own
        if not len(own):
            break
        x = eight[first[own] + 8 * j] & _LOW[np.minimum(n[own] - 8 * j, 8)]
        h[own] = mix64((h[own] ^ x) + _KEYS[j])
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = np.frombuffer(hashlib.blake2b(b[first[i] : last[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return h


def hashes(data: np.ndarray, off: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the number of the words before it (one more at the end)."""
    out, starts_all = [], []
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and lut[data[end]] and not edge[end]:
            end += 1  # no word is cut
        b = np.zeros(end - at + 8, np.uint8)
        b[:-8] = lut[data[at:end]]
        inside = np.zeros(end - at + 2, bool)
        inside[1:-1] = b[:-8] != 0
        cut = edge[at : end + 1]
        first = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        last = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        out.append(_word_hashes(b, first, last))
        starts_all.append(first + at)
        at = end
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.searchsorted(starts, off, "left")


def hash_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings data[first:last], without folding."""
    return _word_hashes(np.concatenate([data, np.zeros(8, np.uint8)]), first, last)


def hash_pieces(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings data[at[i]:at[i+1]], without folding."""
    return hash_spans(data, at[:-1], at[1:])


def plain(text: bytes) -> bytes:
    """Words of the kind "space" with A-Z lower-cased and one space between: equal for equal word sequences and no others."""
    return b" ".join(text.lower().split())


def shards(batches, text: str, most: int):
    """Join Arrow batches into tables of about `most` bytes of text and not much more (a single row may have more)."""
    held, size = [], 0
    for batch in batches:
        lengths = np.diff(buffers(batch.column(batch.schema.get_field_index(text)))[1])
        upto, begin = np.cumsum(lengths), 0
        while begin < batch.num_rows:
            base = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, base + most - size, "right")))
            end = min(end, batch.num_rows)
            held.append(batch.slice(begin, end - begin))
            size += int(upto[end - 1] - base)
            begin = end
            if size >= most or begin < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()

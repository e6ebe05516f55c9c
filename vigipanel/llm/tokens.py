"""Vectorised word and byte hashes of one text, for code that runs inside tasks.

A text is an array of its UTF-8 bytes.  The hash of any span follows from one
running sum, so words, shingles and windows cost a few array operations.
Hashes are 64 bits wide and do not depend on the process, the batch or the
partition; equal spans have equal hashes.
"""

from __future__ import annotations

import numpy as np

_STEP = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_STEP, -1, 1 << 64)
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))       # a copy, which the rest changes in place
    x *= _A
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}

_WORD = bytes(k != 0x20 and not 9 <= k <= 13 for k in range(256))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        held = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def powers(n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the base of all polynomials here."""
    return _powers(_STEP, n)


def inverse_powers(n: int) -> np.ndarray:
    return _powers(_INVERSE, n)


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes as they are."""
    return _LOWER[data]


def running(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hashes`` takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), dtype=np.uint64, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(sums))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_STEP))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    padded = np.zeros(len(inside) + 2, np.int8)
    padded[1:-1] = inside
    edges = np.diff(padded)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def sequence_hashes(items: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` items; of the whole if there are fewer; none if there is none."""
    if not len(items):
        return items
    size = min(size, len(items))
    n = len(items) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total *= np.uint64(_STEP)
        total += items[k:k + n]
        total ^= total >> np.uint64(31)
    return mix(total)


def words(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased."""
    return _word_hashes((text or "").encode("utf-8", "surrogatepass").lower())[1]       # lower() of bytes: A-Z only


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of every word."""
    inside = np.frombuffer(b"\0" + data.translate(_WORD) + b"\0", np.uint8)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], span_hashes(running(np.frombuffer(data, np.uint8)), edges[::2], edges[1::2])


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The set of word shingles as sorted distinct hashes."""
    found = np.sort(sequence_hashes(words(text), size))
    return found[np.concatenate((np.ones(min(len(found), 1), bool), found[1:] != found[:-1]))]


def shingle_sets(texts, size: int = 5, chunk: int = 1 << 16):
    """``shingles`` of each text, computed for several texts of about ``chunk`` bytes together."""
    held, total = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass").lower())
        total += len(held[-1])
        if total >= chunk:
            yield from _shingle_sets(held, size)
            held, total = [], 0
    yield from _shingle_sets(held, size)


def _shingle_sets(held: list[bytes], size: int):
    starts, found = _word_hashes(b"\n".join(held))
    every = sequence_hashes(found, size) if len(found) >= size else found[:0]
    low = 0
    for high in np.searchsorted(starts, np.cumsum([len(x) + 1 for x in held])).tolist():
        own = np.sort(every[low:high - size + 1] if high - low >= size else sequence_hashes(found[low:high], size))
        yield own[np.concatenate((np.ones(min(len(own), 1), bool), own[1:] != own[:-1]))]
        low = high


def word_starts(data: bytes) -> np.ndarray:
    """First byte of every word."""
    inside = np.frombuffer(b"\0" + data.translate(_WORD), np.uint8)
    return np.flatnonzero(inside[1:] > inside[:-1])


def shingle_sequences(texts, size: int = 5, chunk: int = 1 << 18):
    """The hashes of every run of ``size`` words of texts, strings or bytes, of about ``chunk`` bytes together.

    Yields the number of the first of these texts, the hashes of all of them one
    behind the other, and how many each has; a text of fewer words has none.
    """
    held, total, first = [], 0, 0
    for k, text in enumerate(texts):
        held.append((text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).lower())
        total += len(held[-1])
        if total >= chunk:
            yield first, *_shingle_sequences(held, size)
            held, total, first = [], 0, k + 1
    if held:
        yield first, *_shingle_sequences(held, size)


def _shingle_sequences(held: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    starts, found = _word_hashes(b"\n".join(held))
    ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in held]))
    words = np.diff(ends, prepend=0)
    sizes = np.maximum(words - size + 1, 0)
    at = np.arange(sizes.sum()) + np.repeat(ends - words - np.cumsum(sizes) + sizes, sizes)
    return sequence_hashes(found, size)[at], sizes


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every window of ``width`` values."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)

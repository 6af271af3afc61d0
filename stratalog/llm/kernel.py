"""Vectorised text kernels: words, their hashes, window hashes and window minima over Arrow string columns.

Hashes are polynomial sums modulo 2**64 over odd bases, read from prefix sums and mixed at the end, so any span costs two
lookups. A chunk is a run of documents whose UTF-8 bytes lie side by side; nothing ever spans two documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
TOP = U(0xFFFFFFFFFFFFFFFF)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text handled at once; one longer document is a chunk of its own.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (multiply, xor, shift) under which near inputs have unrelated outputs."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BYTE_BASE, WORD_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; kept for the process while small."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 2 * CHUNK:
            _powers[base] = got
    return got


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of a string column; null counts as empty."""
    a = pc.fill_null(texts, "").cast(pa.large_string()) if len(texts) else pa.array([], pa.large_string())
    _, offs, data = a.buffers()
    offs = np.frombuffer(offs, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents of at most limit bytes, or of one document."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b
        a = b


def text_chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, bytes, offsets from 0) for each chunk of a column."""
    buf, offs = utf8(texts)
    for a, b in chunks(offs, limit):
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def spans_by(is_gap: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without gap bytes, cut at documents; first[i]:first[i+1] are those of document i."""
    n = len(is_gap)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    own = ~is_gap
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = is_gap[:-1], is_gap[1:]
    before[offs[:-1][offs[:-1] < n]] = True
    after[offs[1:][offs[1:] > 0] - 1] = True
    start, end = np.flatnonzero(own & before), np.flatnonzero(own & after) + 1
    return start, end, np.searchsorted(start, offs)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans_by(SPACE[buf], offs)


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of values[j] * base**j for j < i."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(base, len(sums))[1][start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix(BYTE[buf], BYTE_BASE), start, end, BYTE_BASE)


def gram_hashes(units: np.ndarray, n: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of units[i:i+n] for each i that has so many after it, whatever document they are of."""
    if len(units) < n:
        return np.zeros(0, U)
    sums = prefix(units, base)
    return mix((sums[n:] - sums[:-n]) * powers(base, len(sums))[1][: len(units) - n + 1])


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether the n units from i on are of one document, for each i that has so many after it."""
    m = max(0, total - n + 1)
    if not m:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))[:m]
    return np.arange(m) + n <= ends


def sliding(values: np.ndarray, n: int, of=np.minimum) -> np.ndarray:
    """of over each n values side by side."""
    if len(values) < n:
        return values[:0]
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = of(out[:-step], out[step:])
        have += step
    return out


def anchors(grams: np.ndarray, gram_ok: np.ndarray, window_ok: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Window minima: lowest[i] is the least of grams[i:i+width], for windows that lie in one document; the positions of grams that are least in some window."""
    lowest = sliding(np.where(gram_ok, grams, TOP), width)[: len(window_ok)]
    lowest = np.where(window_ok, lowest, U(0))
    if not len(lowest):
        return lowest, np.zeros(0, np.int64)
    padded = np.zeros(len(lowest) + 2 * (width - 1), U)
    padded[width - 1 : width - 1 + len(lowest)] = lowest
    highest = sliding(padded, width, np.maximum)
    n = min(len(grams), len(highest))
    return lowest, np.flatnonzero((highest[:n] == grams[:n]) & gram_ok[:n] & (grams[:n] != 0))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

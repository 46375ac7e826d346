"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on the raw UTF-8 buffer of an Arrow column, so a batch of documents is tokenised and hashed by
a fixed number of numpy passes and no Python object exists per word.  Large batches are cut into pieces of about
``PIECE_BYTES`` so that the temporaries stay in cache and a worker's memory does not depend on the batch size; one
document is never cut, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 512 << 10

#: The white space of the word contract: space and U+0009 to U+000D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_U = np.uint64
MIX = _U(0x9E3779B97F4A7C15)
BASE = _U(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> _U(32))) * MIX
    x = (x ^ (x >> _U(29))) * BASE
    return x ^ (x >> _U(32))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, cached for the default base."""
    global _POWERS
    if base != BASE:
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])
    if len(_POWERS) < n:
        m = max(n, 1024)
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, BASE, np.uint64))])
    return _POWERS[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (one more than rows, starting at 0); null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """The words of a piece: byte span, row within the piece and 64-bit hash of each, in text order."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each row's first word, with the number of words appended


def words(buf: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row; a word never crosses rows.  Hashes are zero unless asked for."""
    n, rows = len(buf), len(offsets) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64))
    inside = ~IS_SPACE[buf]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    opens[edge] = inside[edge]
    start = np.flatnonzero(opens)
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64))
    row = np.searchsorted(offsets, start, "right") - 1
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tail = offsets[1:][np.diff(offsets) > 0] - 1
    closes[tail] = inside[tail]
    end = np.flatnonzero(closes) + 1
    own = span_hash(buf, inside, start, end) if hashed else np.zeros(len(start), np.uint64)
    return Words(start, end, row, own, np.searchsorted(row, np.arange(rows + 1)))


def span_hash(values: np.ndarray, keep: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span's kept bytes, in their order; spans ascend and do not overlap."""
    kept = np.flatnonzero(keep)
    upto = np.zeros(len(keep) + 1, np.int32)
    np.cumsum(keep, out=upto[1:])
    before = upto[start].astype(np.int64)
    count = upto[end] - before
    owner = np.repeat(np.arange(len(start)), count)
    # bytes outside all spans are skipped: positions of a span's bytes in `kept` are before .. before + count
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = kept[np.repeat(before, count) + place]
    term = (values[at].astype(np.uint64) + _U(1)) * powers(int(count.max()) if len(count) else 1)[place]
    total = np.zeros(len(start), np.uint64)
    some = count > 0
    if some.any():
        total[some] = np.add.reduceat(term, (np.cumsum(count) - count)[some])
    return mix(total ^ (count.astype(np.uint64) * MIX))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hash of ``values[i : i + k]`` for each i up to len - k, by doubling."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    cur, length, out, have, rest = values, 1, None, 0, k
    while rest:
        if rest & 1:
            if out is None:
                out, have = cur, length
            else:
                m = min(len(out), len(cur) - have)
                out = out[:m] * _power(length) + cur[have : have + m]
                have += length
        rest >>= 1
        if rest:
            m = len(cur) - length
            cur = cur[:m] * _power(length) + cur[length : length + m]
            length *= 2
    return mix(out[: n - k + 1])


def _power(n: int) -> np.uint64:
    return _U(pow(int(BASE), n, 1 << 64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of ``x[i : i + w]`` for each i up to len - w."""
    n, cur, length = len(x), x, 1
    while length * 2 <= w:
        cur = np.minimum(cur[: len(cur) - length], cur[length:])
        length *= 2
    if length < w:
        s = w - length
        cur = np.minimum(cur[: len(cur) - s], cur[s:])
    return cur[: n - w + 1]


def minimizer_runs(tokens: np.ndarray, first: np.ndarray, k: int, window: int):
    """Anchors that any two equal windows of ``window`` tokens have in common.

    ``first`` gives each row's first token, with the number of tokens appended.  The anchor of a window is the leftmost
    k-gram of least hash in it, so it depends on the window's tokens alone.  Returns (anchor, low, high, hash): for the
    windows starting at low .. high, all in one row, the anchor starts at token ``anchor``; each window of each row is
    in exactly one such run.
    """
    none = np.zeros(0, np.int64)
    w, n = window - k + 1, len(tokens)
    if n < window:
        return none, none, none, np.zeros(0, np.uint64)
    h = rolling(tokens, k)
    least = sliding_min(h, w)
    valid = np.zeros(len(least), np.int8)
    lo, hi = first[:-1], first[1:] - window + 1
    good = hi > lo
    step = np.zeros(len(least) + 1, np.int32)
    np.add.at(step, lo[good], 1)
    np.add.at(step, hi[good], -1)
    valid = np.cumsum(step[:-1]) > 0
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    change[lo[good]] = True
    start = np.flatnonzero(change & valid)
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    stop = np.append(np.flatnonzero(change)[1:], len(least)) - 1
    stop = stop[valid[np.flatnonzero(change)]]
    offs, parts = np.arange(w), []
    for i in range(0, len(start), 65536):
        s = start[i : i + 65536]
        parts.append(s + (h[s[:, None] + offs] == least[s][:, None]).argmax(1))
    anchor = np.concatenate(parts)
    found = [(anchor, start, np.minimum(stop, anchor), least[start])]
    # where the least hash comes again further right, as in periodic text, each place that has it is the next windows' anchor
    again = stop > anchor
    start, stop = anchor[again] + 1, stop[again]
    for i in range(0, len(start), 65536):
        s, e = start[i : i + 65536], stop[i : i + 65536]
        at, owner = expand(s, np.minimum(e + w - 1, len(h) - 1))
        same = h[at] == least[s][owner]
        at, owner = at[same], owner[same]
        opens = np.ones(len(at), bool)
        opens[1:] = owner[1:] != owner[:-1]
        low = np.where(opens, s[owner], np.concatenate([[0], at[:-1] + 1]))
        some = low <= e[owner]
        at, owner, low = at[some], owner[some], low[some]
        found.append((at, low, np.minimum(at, e[owner]), least[s][owner]))
    a, s, e, v = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) == 1:
        return a, s, e, v
    order = np.argsort(s, kind="stable")
    return a[order], s[order], e[order], v[order]


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the closed ranges low .. high, and the range each comes from."""
    count = high - low + 1
    owner = np.repeat(np.arange(len(low)), count)
    return low[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)), owner


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of n positions, true where a range start .. start + length - 1 lies."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:-1]) > 0

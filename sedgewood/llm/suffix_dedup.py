"""Exact substring dedup over bytes by a common-prefix-aware merge sort of sampled suffixes.

A 50-byte string can repeat in another document only if its anchor does (``_anchors``), so only suffixes that start at
shared anchors are sorted, each with the few bytes before the anchor that its windows need.  Buckets are ranges of the
suffixes' order: their limits come from a bounded sample of the texts, and only their balance depends on it.  Suffixes
that begin with the same anchor are in one range; hot anchors, of many contexts, are taken apart, and each of their
windows is a suffix by itself, dealt by its own content.  A block sorts its suffixes
and sends each bucket a front-coded run: the length of the prefix shared with the suffix before, and the rest.  A
bucket merges the runs of all blocks with a loser tree in which every contender carries the length of the prefix it
shares with the last winner, so bytes known to be equal are never compared again; the merged order comes with the
prefix lengths of its neighbours.  From these, two windows with the same distance to their anchor are equal if no
prefix between them is shorter than their right part and their left parts are equal.

The smallest document id of each class of equal windows is compared with the suffix's own, and a block gets back one
mask of windows for each suffix it sent.  Left parts (26 bytes at most) are compared by 64-bit fingerprints.

Defined cases: a null text is empty; a null id is neither reference nor cut; rows of equal id do not cut each other;
an empty table gives an empty result.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sedgewood.llm import _anchors
from sedgewood.llm._blocks import BLOCK_BYTES, pack_arrays, partitions, squeeze, unpack_arrays
from sedgewood.llm._text import BASE, cover, mix

WINDOW, GRAM = 50, 24
LEFT = WINDOW - GRAM  # bytes before an anchor that a window may need
WIDTH = WINDOW + LEFT + 2  # right part, left part from the anchor backwards, both lengths
_U = np.uint64


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def _tokens(buf: np.ndarray, offsets: np.ndarray):
    return None, _BYTE_VALUES[buf], offsets


def _spec(many: int = _anchors.MANY) -> _anchors.Spec:
    return _anchors.Spec(_tokens, GRAM, WINDOW, "text", "id", many)


#: Runs whose keys are made, or compared, at once; the indexes that this takes are several times the keys' size.
SLICE = 65_536


def _keys(p: _anchors.Piece) -> np.ndarray:
    """The suffix of each run as WIDTH bytes that sort as the suffix does; the last byte is never zero."""
    n, size = len(p.anchor), len(p.buf)
    key = np.zeros((n, WIDTH), np.uint8)
    to, back = np.arange(WINDOW), np.arange(LEFT)
    for i in range(0, n, SLICE):
        own, anchor = key[i : i + SLICE], p.anchor[i : i + SLICE]
        right, left = p.high[i : i + SLICE] + WINDOW - anchor, anchor - p.low[i : i + SLICE]
        at = np.minimum(anchor[:, None] + to, max(size - 1, 0))
        own[:, :WINDOW] = np.where(to < right[:, None], p.buf[at], 0)
        at = np.maximum(anchor[:, None] - 1 - back, 0)
        own[:, WINDOW : WINDOW + LEFT] = np.where(back < left[:, None], p.buf[at], 0)
        own[:, -2], own[:, -1] = right, left + 1
    return key


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _sorted_suffixes(found: list[_anchors.Piece], ids: np.ndarray, limits: np.ndarray, n: int):
    """Distinct suffixes of a block by (bucket, suffix) as a matrix, with bucket, smallest id, and each run's place."""
    some = [p for p in found if len(p.anchor)]
    if not some:
        return np.zeros((0, WIDTH), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = _joined([_keys(p) for p in some])
    h, alone = np.concatenate([p.hash for p in some]), np.concatenate([p.alone for p in some])
    doc = ids[np.concatenate([p.row for p in some])]
    gram = np.ascontiguousarray(key[:, :GRAM]).view(f"S{GRAM}").reshape(-1)
    bucket = np.where(alone, (h % _U(n)).astype(np.int64), np.searchsorted(limits, gram, "right"))
    order = np.argsort(key.view(f"S{WIDTH}").reshape(-1), kind="stable")
    order = order[np.argsort(bucket[order], kind="stable")]
    new = np.ones(len(order), bool)
    for i in range(1, len(order), SLICE):
        a, b = order[i : i + SLICE], order[i - 1 : i + SLICE - 1][: len(order) - i]
        new[i : i + SLICE] = (key[a] != key[b]).any(1) | (bucket[a] != bucket[b])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return key[order[at]], bucket[order[at]], np.minimum.reduceat(doc[order], at), place


def _entries(limits: np.ndarray):
    def entries(found, ids, n):
        key, bucket, least, _ = _sorted_suffixes(found, ids, limits, n)
        at = np.searchsorted(bucket, np.arange(n + 1))
        for b in range(n):
            if at[b] < at[b + 1]:
                part = key[at[b] : at[b + 1]]
                shared = np.zeros(len(part), np.uint8)
                differs = part[1:] != part[:-1]
                shared[1:] = differs.argmax(1)
                rest = part[np.arange(WIDTH) >= shared[:, None]]
                yield b, pack_arrays(shared, rest), pack_arrays(least[at[b] : at[b + 1]])

    return entries


#: Sampled anchors for each bucket's limit.
SAMPLED = 64


def bucket_limits(df: DataFrame, n: int) -> np.ndarray:
    """Where one bucket ends and the next begins, n - 1 ascending grams at most, from the least ``SAMPLED * n`` of the anchors by hash."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = SAMPLED * n
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for p in _anchors.scan(table, _spec()):
                own = mix(p.hash)
                some = np.argsort(own, kind="stable")[:most]
                key = p.buf[np.minimum(p.anchor[some][:, None] + np.arange(GRAM), max(len(p.buf) - 1, 0))]
                yield pa.record_batch([pa.array((own[some] >> _U(1)).astype(np.int64)), pa.array([x.tobytes() for x in key], pa.binary())], names=["h", "gram"])

    # one text in sixteen, however many there are; a table of a few texts may give no limit, and is one bucket
    texts = df.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0)
    rows = texts.mapInArrow(grams, "h long, gram binary").distinct().orderBy("h", "gram").limit(SAMPLED * n).collect()
    found = np.sort(np.array([bytes(r["gram"]) for r in rows], f"S{GRAM}"))
    return np.unique(found[(np.arange(1, n) * len(found)) // n]) if len(found) else found


def _decode(data: bytes) -> tuple[list[bytes], list[int]]:
    """A run's suffixes and the length of the prefix each shares with the one before."""
    shared, rest = unpack_arrays(data)
    raw, known = rest.tobytes(), shared.tolist()
    out, last, at = [], b"", 0
    for s in known:
        end = at + WIDTH - s
        last = last[:s] + raw[at:end]
        out.append(last)
        at = end
    return out, known


def _differ(a: bytes, b: bytes, known: int) -> tuple[int, bool]:
    """Length of the common prefix of a and b, of which ``known`` bytes need not be read, and whether a sorts first."""
    x, y = int.from_bytes(a[known:], "big"), int.from_bytes(b[known:], "big")
    if x == y:
        return WIDTH, True
    return known + (8 * (WIDTH - known) - (x ^ y).bit_length()) // 8, x < y


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Loser tree over sorted runs: the run that each merged suffix comes from, and its prefix shared with the last.

    A contender is (shared prefix with the last winner, suffix).  Of two, the one that shares more sorts first and the
    other's prefix stays as it was; only equal prefixes make bytes be read, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    pos, size = [0] * k, [len(r[0]) for r in runs] + [0] * (k - len(runs))
    keys, shared = [r[0] for r in runs] + [[]] * (k - len(runs)), [r[1] for r in runs] + [[]] * (k - len(runs))
    # a contender that has ended shares -1 and loses against all
    lcp = [0 if s else -1 for s in size]
    head = [x[0] if x else b"" for x in keys]
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        if lcp[a] < 0:
            return a, b
        same, first = _differ(head[a], head[b], lcp[a])
        w, x = (a, b) if first else (b, a)
        lcp[x] = same
        return w, x

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, x = play(build(2 * node), build(2 * node + 1))
        loser[node] = x
        return w

    source, prefix = [], []
    win = build(1) if k > 1 else 0
    while lcp[win] >= 0:
        source.append(win)
        prefix.append(lcp[win])
        i = pos[win] = pos[win] + 1
        if i < size[win]:
            lcp[win], head[win] = shared[win][i], keys[win][i]
        else:
            lcp[win] = -1
        node = (win + k) >> 1
        while node:
            x = loser[node]
            a, b = lcp[win], lcp[x]
            if a < b:
                loser[node], win = win, x
            elif a == b and a >= 0:
                same, first = _differ(head[win], head[x], a)
                if first:
                    lcp[x] = same
                else:
                    lcp[win] = same
                    loser[node], win = win, x
            node >>= 1
    return source, prefix


def _merge(table: pa.Table) -> list[bytes]:
    runs = [_decode(x.as_py()) for x in table["run"]]
    docs = [unpack_arrays(x.as_py())[0] for x in table["extra"]]
    source, prefix = merge_runs(runs)
    source = np.array(source, np.int64)
    order = np.argsort(source, kind="stable")  # the merged places of each run's suffixes, run by run
    flat = np.frombuffer(b"".join(b"".join(r[0]) for r in runs), np.uint8).reshape(-1, WIDTH)
    key, doc = np.empty_like(flat), np.empty(len(flat), np.int64)
    key[order], doc[order] = flat, np.concatenate(docs)
    mask = np.empty(len(flat), np.uint32)
    mask[...] = earlier_windows(key, np.array(prefix, np.int64), doc)
    mine, out, i = mask[order], [], 0
    for d in docs:
        out.append(squeeze(mine[i : i + len(d)].tobytes(), 1))
        i += len(d)
    return out


def earlier_windows(key: np.ndarray, prefix: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each suffix, in sorted order, the mask of its windows that a smaller id has: bit j is the window j bytes before the anchor."""
    right, left = key[:, -2].astype(np.int64), key[:, -1].astype(np.int64) - 1
    out = np.zeros(len(key), np.uint32)
    before = np.zeros(len(key), np.uint64)
    for j in range(LEFT + 1):
        if j:
            before = before * BASE + key[:, WINDOW + j - 1].astype(np.uint64) + _U(1)
        need = WINDOW - j
        some = np.flatnonzero((right >= need) & (left >= j))
        if not len(some):
            continue
        group = np.cumsum(prefix < need)[some].astype(np.uint64)
        same = mix(mix(group + _U(1)) ^ before[some])
        order = np.argsort(same, kind="stable")
        new = np.concatenate([[True], same[order][1:] != same[order][:-1]])
        least = np.minimum.reduceat(doc[some][order], np.flatnonzero(new))[np.cumsum(new) - 1]
        late = some[order[doc[some][order] > least]]
        out[late] |= np.uint32(1 << j)
    return out


def _digest(limits: np.ndarray, table, found, ids, told, n):
    key, bucket, least, place = _sorted_suffixes(found, ids, limits, n)
    at, mask = np.searchsorted(bucket, np.arange(n + 1)), np.zeros(len(key), np.uint32)
    for b, raw in told.items():
        mask[at[b] : at[b + 1]] = np.frombuffer(raw, np.uint32)
    size, lost, spans, sha, i = [], [], [], [], 0
    for p in found:
        own = place[i : i + len(p.anchor)]
        i += len(own)
        bits = np.where(ids[p.row] > least[own], np.uint32(0xFFFFFFFF), mask[own])
        starts = []
        for j in range(LEFT + 1):
            s = p.anchor - j
            starts.append(s[(bits >> np.uint32(j) & np.uint32(1)).astype(bool) & (s >= p.low) & (s <= p.high)])
        gone = cover(np.concatenate(starts), WINDOW, len(p.buf))
        total = np.concatenate([[0], np.cumsum(gone)])
        for r in range(p.row1 - p.row0):
            s, e = p.offsets[r], p.offsets[r + 1]
            size.append(int(e - s))
            lost.append(int(total[e] - total[s]))
            if lost[-1]:
                cut = gone[s:e]
                spans.append(int(cut[0]) + int(np.count_nonzero(cut[1:] & ~cut[:-1])))
                sha.append(hashlib.sha256(p.buf[s:e][~cut].tobytes()).hexdigest())
            else:
                spans.append(0)
                sha.append(hashlib.sha256(p.buf[s:e].tobytes()).hexdigest())
    return pa.table({"doc_id": table[0].cast(pa.int64()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def dedup_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, many: int = _anchors.MANY) -> DataFrame:
    """One row per row of df: doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the kept bytes)."""
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    limits = bucket_limits(slim, partitions(df.sparkSession))
    return _anchors.exchange(slim, _spec(many), _entries(limits), _merge, partial(_digest, limits), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", block_bytes)


DIGEST_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT rid, doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT rid, doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d)),
dup AS (SELECT rid, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
gone AS (SELECT DISTINCT rid, i + o AS p FROM dup, (SELECT unnest(range(50)) AS o)),
n AS (SELECT rid, count(*) AS n_removed, count(*) FILTER (p - 1 <> coalesce(q, -2)) AS n_spans FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS q FROM gone) GROUP BY rid),
k AS (SELECT rid, string_agg(b, '' ORDER BY p) AS kept FROM (SELECT rid, substr(x, 2 * p + 1, 2) AS b, p FROM (SELECT rid, x, unnest(range(0, length(x) // 2)) AS p FROM d WHERE rid IN (SELECT rid FROM n))) ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_removed IS NULL THEN x ELSE coalesce(kept, '') END)) AS kept_sha256 FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
"""

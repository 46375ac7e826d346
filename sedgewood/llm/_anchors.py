"""First round of the suffix operator: which anchors do several documents have, and which of them have many contexts?

Any two equal windows have their minimizer in common (see ``_text.minimizer_runs``), so a window can repeat in another
document only if its anchor does.  Blocks exchange their distinct anchors, 48 bits each and front-coded in hash order;
the answer is two bits an anchor.  Only windows of shared anchors take part in the second round.

An anchor that some block finds in ``MANY`` contexts, or that more than ``MOST_BLOCKS`` blocks have, is hot: its windows
take part one by one, each by its own content, so that the texts around a common phrase do not meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sedgewood.llm._blocks import BLOCK_BYTES, bucket_labels, pack_arrays, pack_sorted, packed, partitions, squeeze, unpack_arrays, unpack_sorted, unpack_table, unsqueeze
from sedgewood.llm._text import buffers, expand, minimizer_runs, mix, pieces, powers, rolling

MANY, MOST_BLOCKS, EDGE = 16, 4096, 6
ANSWER = pa.schema([("block_id", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary())])
ENTRIES = pa.schema([("block_id", pa.int64()), ("bucket", pa.int32()), ("run", pa.binary()), ("extra", pa.binary())])
ANSWER_DDL, ENTRIES_DDL = "block_id long, bucket int, answer binary", "block_id long, bucket int, run binary, extra binary"
_U = np.uint64


@dataclass
class Piece:
    """A few whole rows of a block: their tokens and the runs of windows that share an anchor."""

    row0: int
    row1: int
    buf: np.ndarray
    offsets: np.ndarray
    tokens: object
    values: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    hash: np.ndarray
    row: np.ndarray  # of the block
    alone: np.ndarray | None = None  # which runs are single windows of hot anchors, whose hash is that of their content


@dataclass
class Spec:
    """How texts become tokens: ``tokens(buf, offsets)`` gives (anything kept, token values, first token of each row)."""

    tokens: Callable
    gram: int
    window: int
    text: str
    id: str
    many: int = MANY


def scan(table: pa.Table, spec: Spec, bits: int = 48) -> Iterator[Piece]:
    """The pieces of a table; anchors' hashes have so many bits."""
    buf, offsets = buffers(table[spec.text])
    for i, j in pieces(offsets):
        part, offs = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        kept, values, first = spec.tokens(part, offs)
        anchor, low, high, h = minimizer_runs(values, first, spec.gram, spec.window)
        row = np.searchsorted(first, low, "right") - 1 + i
        yield Piece(i, j, part, offs, kept, values, anchor, low, high, h >> _U(64 - bits), row)


def doc_ids(table: pa.Table, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Ids and which of them are set; a row without an id is not compared with any other."""
    column = table[spec.id].combine_chunks().cast(pa.int64())
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def distinct_anchors(found: list[Piece], valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct anchors of a block's rows with an id, which of them two rows have, and how often each occurs."""
    h = np.concatenate([p.hash for p in found] or [np.zeros(0, np.uint64)])
    row = np.concatenate([p.row for p in found] or [np.zeros(0, np.int64)])
    h, row = h[valid[row]], row[valid[row]]
    if not len(h):
        return h, np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.minimum.reduceat(row, at) != np.maximum.reduceat(row, at), np.diff(np.append(at, len(h)))


def bucket_edges(values: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Where the ascending values of ``bits`` bits pass from one of n equal ranges to the next: n + 1 positions."""
    limits = np.array([(b << bits) // n for b in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, limits), [len(values)]]).astype(np.int64)


def many_contexts(found: list[Piece], h: np.ndarray, count: np.ndarray, window: int, least: int = MANY) -> np.ndarray:
    """Which of the ascending distinct anchors h, which occur so often, have at least so many contexts among the runs.

    Contexts are told apart by the ``EDGE`` tokens at both ends of a run's windows.
    """
    often = np.flatnonzero(count >= least)
    out = np.zeros(len(h), bool)
    if not len(often):
        return out
    few, pairs = h[often], []
    for p in found:
        at = np.minimum(np.searchsorted(few, p.hash), len(few) - 1)
        some = np.flatnonzero(few[at] == p.hash)
        if len(some):
            edge = np.arange(EDGE)
            ends = np.concatenate([p.low[some][:, None] + edge, p.high[some][:, None] + window - 1 - edge], 1)
            context = mix(p.values[ends] * powers(2 * EDGE) + (p.anchor - p.low)[some][:, None].astype(np.uint64)).sum(1, dtype=np.uint64)
            pairs.append(np.stack([often[at[some]].astype(np.uint64), context], 1))
    every = np.concatenate(pairs)
    every = every[np.lexsort(every.T)]
    new = np.concatenate([[True], (every[1:] != every[:-1]).any(1)])
    return np.bincount(every[new, 0].astype(np.int64), minlength=len(h)) >= least


def anchor_runs(blocks: DataFrame, spec: Spec, labels: list[int]) -> DataFrame:
    n = len(labels)

    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = unpack_table(payload.as_py())
                _, valid = doc_ids(table, spec)
                found = list(scan(table, spec))
                h, _, count = distinct_anchors(found, valid)
                many = many_contexts(found, h, count, spec.window, spec.many)
                at = bucket_edges(h, 48, n)
                some = [b for b in range(n) if at[b] < at[b + 1]]
                runs = [pack_arrays(np.frombuffer(pack_sorted(h[at[b] : at[b + 1]]), np.uint8), np.packbits(many[at[b] : at[b + 1]])) for b in some]
                yield pa.record_batch([pa.array([block] * len(some), pa.int64()), pa.array([labels[b] for b in some], pa.int32()), pa.array(runs, pa.binary())], names=["block_id", "bucket", "run"])

    return blocks.mapInArrow(run, "block_id long, bucket int, run binary")


def shared(blocks: DataFrame, spec: Spec, labels: list[int]) -> DataFrame:
    """(block_id, bucket, answer): two bits for each of the block's anchors in the bucket: whether another block has it, whether it is hot."""

    def mark(table: pa.Table) -> pa.Table:
        parts = [unpack_arrays(x.as_py()) for x in table["run"]]
        runs = [unpack_sorted(x.tobytes()) for x, _ in parts]
        every, inverse, count = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
        hot = count > MOST_BLOCKS
        hot[inverse[np.concatenate([np.unpackbits(bits, count=len(r)) for r, (_, bits) in zip(runs, parts, strict=True)]).astype(bool)]] = True
        out = []
        for r in runs:
            at = np.searchsorted(every, r)
            out.append(squeeze(np.packbits(np.concatenate([count[at] > 1, hot[at]])).tobytes(), 1))
        return pa.table([table["block_id"], table["bucket"], pa.array(out, pa.binary())], schema=ANSWER)

    return anchor_runs(blocks, spec, labels).groupBy("bucket").applyInArrow(mark, ANSWER_DDL)


def answers(table: pa.Table, labels: list[int]) -> dict[int, bytes]:
    """A block's answers by bucket; that of its echo has the key -1."""
    bucket = {x: b for b, x in enumerate(labels)}
    return {bucket[b] if b >= 0 else -1: unsqueeze(x.as_py()) for b, x in zip(table["bucket"].to_pylist(), table["answer"], strict=True)}


def shared_masks(h: np.ndarray, local: np.ndarray, table: pa.Table, labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors are shared, and which are hot."""
    at, out, hot = bucket_edges(h, 48, len(labels)), local.copy(), np.zeros(len(h), bool)
    for b, raw in answers(table, labels).items():
        m = at[b + 1] - at[b]
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=2 * m).astype(bool)
        out[at[b] : at[b + 1]] |= bits[:m]
        hot[at[b] : at[b + 1]] = bits[m:]
    return out, hot


def echo(block: int, masks: tuple[np.ndarray, np.ndarray], n: int) -> dict:
    """A row that the second round hands back unchanged, so that the last step need not ask for shared anchors again."""
    return {"block_id": block, "bucket": -1 - block % n, "run": squeeze(np.packbits(np.concatenate(masks)).tobytes(), 1), "extra": pack_arrays()}


def keep_shared(found: list[Piece], h: np.ndarray, masks: tuple[np.ndarray, np.ndarray], valid: np.ndarray, window: int) -> list[Piece]:
    """The pieces with only the runs whose anchor is shared and whose row has an id; those of hot anchors window by window."""
    mask, hot = masks
    for p in found:
        at = np.minimum(np.searchsorted(h, p.hash), max(len(h) - 1, 0))
        ok = valid[p.row] & (mask[at] if len(h) else False)
        split = ok & (hot[at] if len(h) else False)
        ok &= ~split
        start, owner = expand(p.low[split], p.high[split])
        prints = rolling(p.values, window)[start] if len(start) else np.zeros(0, np.uint64)
        p.alone = np.concatenate([np.zeros(int(ok.sum()), bool), np.ones(len(start), bool)])
        row = p.row[split][owner]
        p.anchor, p.low, p.high = (np.concatenate([x[ok], start]) for x in (p.anchor, p.low, p.high))
        p.hash, p.row = np.concatenate([p.hash[ok], prints]), np.concatenate([p.row[ok], row])
    return found


def exchange(df: DataFrame, spec: Spec, entries: Callable, merge: Callable, finish: Callable, schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Both rounds.  ``entries(found, ids, n)`` yields (bucket, run, extra) of a block's distinct entries in a fixed order;
    ``merge(table)`` answers each of a bucket's runs; ``finish(table, found, ids, answers, n)`` makes the block's result.

    A block sends a run to each bucket, so ``block_bytes`` should grow with the corpus as far as workers' memory allows:
    a worker holds some 25 times as much.
    """
    blocks = packed(df, spec.text, block_bytes)
    n = partitions(df.sparkSession)
    labels = bucket_labels(df.sparkSession, n)

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, payload in zip(left["block_id"].to_pylist(), left["payload"], strict=True):
            table = unpack_table(payload.as_py())
            ids, valid = doc_ids(table, spec)
            found = list(scan(table, spec))
            h, local, _ = distinct_anchors(found, valid)
            masks = shared_masks(h, local, right, labels)
            out.append(echo(block, masks, n))
            found = keep_shared(found, h, masks, valid, spec.window)
            out += [{"block_id": block, "bucket": labels[b], "run": r, "extra": x} for b, r, x in entries(found, ids, n)]
        return pa.Table.from_pylist(out, ENTRIES)

    def merged(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return pa.table([table["block_id"], table["bucket"], table["run"]], schema=ANSWER)
        return pa.table([table["block_id"], table["bucket"], pa.array(merge(table), pa.binary())], schema=ANSWER)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for payload in left["payload"]:
            table = unpack_table(payload.as_py())
            ids, valid = doc_ids(table, spec)
            found = list(scan(table, spec))
            h, _, _ = distinct_anchors(found, valid)
            told = answers(right, labels)
            raw = told.pop(-1)
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=2 * len(h)).astype(bool)
            out.append(finish(table, keep_shared(found, h, (bits[: len(h)], bits[len(h) :]), valid, spec.window), ids, told, n))
        return pa.concat_tables(out)

    marks = shared(blocks, spec, labels)
    asked = blocks.groupBy("block_id").cogroup(marks.groupBy("block_id")).applyInArrow(candidates, ENTRIES_DDL)
    replies = asked.groupBy("bucket").applyInArrow(merged, ANSWER_DDL)
    return blocks.groupBy("block_id").cogroup(replies.groupBy("block_id")).applyInArrow(last, schema)

"""Substring dedup by a relative Lempel-Ziv parse over words.

The reference index holds phrases of all blocks.  A 50-word window's anchor is its least 8-gram (``_text.minimizer_runs``),
so equal windows have equal anchors; for each anchor that two documents have, the document of the smallest id gives its
phrase: the windows around its first occurrence there, one after the other.  Every document is then factored from left
to right.  At the next window whose anchor is indexed, the phrase is laid over the text at the anchor, and a factor grows
window by window, that is word by word, as long as both agree; it goes on into the next phrase where that is of the same
reference document.  A factor of a document with a larger id than the reference's has 50 words at least, and is a
duplicate span.

Where a factor ends inside a phrase, the windows of that anchor that the phrase does not hold are looked up one by one:
they cross a factor's boundary, or follow the anchor into another text.  Blocks send these open windows, and the smallest
id that has one decides.  Windows of a phrase itself need no look-up, as its document is the smallest that has the anchor.
So a window is removed if and only if it also starts in a document with a smaller id.

A block sends a row for each distinct anchor (with its smallest and largest id), and for each distinct open window; a
phrase goes to each block that has its anchor.  Rows grow with the data alone, and equal ones are counted within blocks,
so a passage in a third of all documents costs one row a block.  Texts travel once, compressed, in blocks of about 2 MB.
Windows are compared by 64-bit hashes where their anchors' are equal too.

Defined cases: a null text has no words; a null id is neither reference nor removed; rows of equal id do not remove
each other; an empty table gives an empty result.  Other columns are carried along by ``dedup_stage`` and not looked
at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sedgewood.llm import _anchors
from sedgewood.llm._blocks import BLOCK_BYTES, packed, squeeze, unpack_table, unsqueeze
from sedgewood.llm._text import buffers, cover, expand, pieces, rolling, words

WINDOW, GRAM = 50, 8


def _tokens(buf: np.ndarray, offsets: np.ndarray):
    w = words(buf, offsets)
    return w, w.hash, w.first


def _spec(id_col: str, text_col: str, window: int) -> _anchors.Spec:
    return _anchors.Spec(_tokens, min(GRAM, window), window, text_col, id_col)


@dataclass
class Runs:
    """The runs of a block's windows by anchor, of rows with an id, and the windows' hashes, over all its words."""

    hash: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    id: np.ndarray
    windows: list[np.ndarray]
    base: np.ndarray  # first word of each piece, with the number of words appended
    piece: np.ndarray

    def prints(self, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Hashes of the windows at these places of the block, which lie in these pieces."""
        out = np.zeros(len(at), np.uint64)
        for k in np.unique(piece):
            own = piece == k
            out[own] = self.windows[k][at[own] - self.base[k]]
        return out


def runs_of(table: pa.Table, spec: _anchors.Spec, prints: bool = True) -> Runs:
    ids, valid = _anchors.doc_ids(table, spec)
    found: list[list[np.ndarray]] = [[] for _ in range(6)]
    windows, base = [], [0]
    for k, p in enumerate(_anchors.scan(table, spec, 64)):
        ok = valid[p.row]
        parts = p.hash[ok], p.anchor[ok] + base[-1], p.low[ok] + base[-1], p.high[ok] + base[-1], ids[p.row[ok]], np.full(int(ok.sum()), k)
        for x, part in zip(found, parts, strict=True):
            x.append(part)
        windows.append(rolling(p.tokens.hash, spec.window) if prints else np.zeros(0, np.uint64))
        base.append(base[-1] + len(p.tokens.hash))
    h, anchor, low, high, own, piece = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.uint64 if i == 0 else np.int64) for i, x in enumerate(found))
    return Runs(h, anchor, low, high, own, windows, np.array(base), piece)


_ANCHORS = "h long, block_id long, least long, greatest long"
_PHRASES = pa.schema([("h", pa.int64()), ("reference", pa.int64()), ("lead", pa.int32()), ("prints", pa.binary())])
_PARSED = pa.schema([("block_id", pa.int64()), ("h", pa.int64()), ("w", pa.int64()), ("least", pa.int64()), ("greatest", pa.int64()), ("masks", pa.binary())])


def _least_greatest(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct row of key (a matrix), its place among the rows, and the smallest and largest id."""
    order = np.lexsort(key.T)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
    return order[at], np.minimum.reduceat(ids[order], at), np.maximum.reduceat(ids[order], at)


def anchors(blocks: DataFrame, spec: _anchors.Spec) -> DataFrame:
    """A row for each distinct anchor of a block, with the smallest and largest id that has it there."""

    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                r = runs_of(unpack_table(payload.as_py()), spec, prints=False)
                if len(r.hash):
                    at, least, greatest = _least_greatest(r.hash[:, None], r.id)
                    yield pa.record_batch([pa.array(r.hash[at].view(np.int64)), pa.array([block] * len(at), pa.int64()), pa.array(least), pa.array(greatest)], names=["h", "block_id", "least", "greatest"])

    return blocks.mapInArrow(run, _ANCHORS)


def phrases(table: pa.Table, wanted: pa.Table, spec: _anchors.Spec) -> pa.Table:
    """The phrase of each wanted(h, reference) anchor: the windows of its first run in the document of the reference's id."""
    r = runs_of(table, spec)
    h, reference = (wanted[c].to_numpy() for c in ("h", "reference"))
    order = np.argsort(h.view(np.uint64), kind="stable")
    keys, reference = h.view(np.uint64)[order], reference[order]
    place = np.minimum(np.searchsorted(keys, r.hash), len(keys) - 1)
    mine = np.flatnonzero((keys[place] == r.hash) & (reference[place] == r.id))
    _, first = np.unique(place[mine], return_index=True)
    runs = mine[first]
    at, owner = expand(r.low[runs], r.high[runs])
    prints = r.prints(at, r.piece[runs][owner]).astype("<u8").tobytes()
    edge = np.concatenate([[0], np.cumsum(r.high[runs] - r.low[runs] + 1)]) * 8
    rows = [prints[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return pa.table([pa.array(r.hash[runs].view(np.int64)), pa.array(r.id[runs]), pa.array((r.anchor - r.low)[runs], pa.int32()), pa.array(rows, pa.binary())], schema=_PHRASES)


@dataclass
class Parse:
    """Factors (first word, words and reference of each) of a block, in text order, and its open windows."""

    start: np.ndarray
    length: np.ndarray
    reference: np.ndarray
    open: np.ndarray  # places
    open_run: np.ndarray
    open_print: np.ndarray


def parse(r: Runs, index: pa.Table, window: int) -> Parse:
    """Factors the texts of a block against the phrases index(h, reference, lead, prints)."""
    none = np.zeros(0, np.int64)
    if not index.num_rows or not len(r.hash):
        return Parse(none, none, none, none, none, none.astype(np.uint64))
    h = index["h"].to_numpy().view(np.uint64)
    order = np.argsort(h, kind="stable")
    h, reference, lead = h[order], index["reference"].to_numpy()[order], index["lead"].to_numpy()[order].astype(np.int64)
    column = index["prints"].combine_chunks().take(pa.array(order))
    raw, offsets = buffers(column)
    prints, edge = np.frombuffer(raw.tobytes(), "<u8"), offsets // 8
    place = np.minimum(np.searchsorted(h, r.hash), len(h) - 1)
    indexed = np.flatnonzero(h[place] == r.hash)
    at, owner = expand(r.low[indexed], r.high[indexed])
    run = indexed[owner]
    own, k = r.prints(at, r.piece[run]), place[run]
    # where the window lies in the phrase, if it does
    to = edge[k] + lead[k] - (r.anchor[run] - at)
    inside = (to >= edge[k]) & (to < edge[k + 1])
    agrees = inside & (prints[np.where(inside, to, 0)] == own)
    hit = agrees & (r.id[run] > reference[k])
    order = np.argsort(at[hit], kind="stable")
    start, source = at[hit][order], reference[k][hit][order]
    grows = np.zeros(len(start), bool)
    grows[1:] = (start[1:] == start[:-1] + 1) & (source[1:] == source[:-1])
    first = np.flatnonzero(~grows)
    length = np.diff(np.append(first, len(start))) + window - 1
    left = ~agrees
    return Parse(start[first], length, source[first], at[left], run[left], own[left])


def _bits(places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[places] = True
    return np.packbits(out)


def _parsed(left: pa.Table, right: pa.Table, spec: _anchors.Spec) -> pa.Table:
    """A block's open windows, and a row that hands its factors and the places of these windows to the last step."""
    out = []
    for block, payload in zip(left["block_id"].to_pylist(), left["payload"], strict=True):
        r = runs_of(unpack_table(payload.as_py()), spec)
        n, f = int(r.base[-1]), parse(r, right, spec.window)
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, f.start, 1)
        np.add.at(step, f.start + f.length, -1)
        masks = squeeze(np.packbits(np.cumsum(step[:-1]) > 0).tobytes() + _bits(f.open, n).tobytes(), 1)
        out.append(pa.table([pa.array([x], t) for x, t in zip((block, block, None, None, None, masks), _PARSED.types, strict=True)], schema=_PARSED))
        if len(f.open):
            key = np.stack([f.open_print, r.hash[f.open_run]], 1)
            at, least, greatest = _least_greatest(key, r.id[f.open_run])
            m = len(at)
            out.append(pa.table([pa.array([block] * m, pa.int64()), pa.array(key[at, 1].view(np.int64)), pa.array(key[at, 0].view(np.int64)), pa.array(least), pa.array(greatest), pa.nulls(m, pa.binary())], schema=_PARSED))
    return pa.concat_tables(out)


def removed(table: pa.Table, told: pa.Table, spec: _anchors.Spec) -> list[tuple[_anchors.Piece, np.ndarray | None]]:
    """The pieces of a block (without runs), each with the mask of its words that go, or None where all stay."""
    ids, valid = _anchors.doc_ids(table, spec)
    buf, offsets = buffers(table[spec.text])
    masks = [x for x in told["masks"].to_pylist() if x is not None]
    raw = np.frombuffer(unsqueeze(masks[0]), np.uint8) if masks else np.zeros(0, np.uint8)
    half = len(raw) // 2
    n = 8 * half
    gone, still = np.unpackbits(raw[:half]).astype(bool), np.unpackbits(raw[half:]).astype(bool)
    w, least = told["w"].drop_null().to_numpy().view(np.uint64), told["smallest"].drop_null().to_numpy()
    order = np.argsort(w, kind="stable")
    w, least = w[order], least[order]
    out, at = [], 0
    for i, j in pieces(offsets):
        part, offs = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        t = words(part, offs, hashed=bool(len(w)))
        size = len(t.start)
        mask = gone[at : at + size] if n else np.zeros(size, bool)
        if len(w):
            starts = np.flatnonzero(still[at : at + size])
            if len(starts):
                own = rolling(t.hash, spec.window)[starts]
                place = np.minimum(np.searchsorted(w, own), len(w) - 1)
                row = np.searchsorted(t.first, starts, "right") - 1 + i
                late = (w[place] == own) & valid[row] & (ids[row] > least[place])
                if late.any():
                    mask = mask | cover(starts[late], spec.window, size)
        out.append((_anchors.Piece(i, j, part, offs, t, t.hash, *[np.zeros(0, np.int64)] * 5), mask if mask.any() else None))
        at += size
    return out


def _deduplicated(df: DataFrame, spec: _anchors.Spec, finish: Callable, schema, block_bytes: int) -> DataFrame:
    """``finish(table, pieces)`` of each block of df, one plan over exchanges that hold what may be read again."""
    blocks = packed(df, spec.text, block_bytes)
    by_anchor = Window.partitionBy("h")
    marks = (
        anchors(blocks, spec)
        .withColumn("first", F.min(F.struct("least", "block_id")).over(by_anchor)).withColumn("last", F.max("greatest").over(by_anchor))
        .where("last > first.least").select("h", "block_id", F.col("first.least").alias("reference"), F.col("first.block_id").alias("holder"))
    )

    def give(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [phrases(unpack_table(x.as_py()), right, spec) for x in left["payload"] if right.num_rows]
        return pa.concat_tables(out) if out else _PHRASES.empty_table()

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for payload in left["payload"]:
            table = unpack_table(payload.as_py())
            out.append(finish(table, removed(table, right, spec)))
        return pa.concat_tables(out)

    def grouped(rows: DataFrame, f: Callable, ddl) -> DataFrame:
        return blocks.groupBy("block_id").cogroup(rows.groupBy("block_id")).applyInArrow(f, ddl)

    index = grouped(marks.where("block_id = holder").select("block_id", "h", "reference"), give, "h long, reference long, lead int, prints binary")
    sent = marks.select("h", "block_id").join(index, "h")
    opened = grouped(sent, lambda a, b: _parsed(a, b, spec), "block_id long, h long, w long, least long, greatest long, masks binary")
    # rows with masks have no window and are alone
    smallest = F.min("least").over(Window.partitionBy("h", "w"))
    told = opened.withColumn("smallest", smallest).where("masks is not null or smallest < greatest").select("block_id", "w", "smallest", "masks")
    return grouped(told, last, schema)


def _digest(table: pa.Table, found: list) -> pa.Table:
    count, lost, spans, sha = [], [], [], []
    for p, mask in found:
        raw, first = p.buf.tobytes(), p.tokens.first
        for r in range(p.row1 - p.row0):
            kept = raw[p.offsets[r] : p.offsets[r + 1]].split()
            count.append(len(kept))
            cut = mask[first[r] : first[r + 1]] if mask is not None else None
            if cut is not None and cut.any():
                lost.append(int(cut.sum()))
                spans.append(int(cut[0]) + int(np.count_nonzero(cut[1:] & ~cut[:-1])))
                kept = compress(kept, (~cut).tolist())
            else:
                lost.append(0)
                spans.append(0)
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return pa.table({"doc_id": table[0].cast(pa.int64()), "n_words": pa.array(count, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "n_spans": pa.array(spans, pa.int64())})


def dedup_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_removed, kept_sha256 (of the kept words, one space apart) and n_spans."""
    spec = _spec("id", "text", window)
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _deduplicated(slim, spec, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long", block_bytes)


def dedup_stage(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df with duplicate spans cut out of its texts; a text from which nothing is cut is unchanged.

    A span is cut with the white space after it.  Rows of which every word is cut are dropped, rows that had no words stay.
    """

    def finish(table: pa.Table, found: list) -> pa.Table:
        texts, keep = table[text_col].to_pylist(), np.ones(table.num_rows, bool)
        for p, mask in found:
            if mask is None:
                continue
            first = p.tokens.first
            for r in range(p.row1 - p.row0):
                cut = mask[first[r] : first[r + 1]]
                if cut.any():
                    starts = np.append(p.tokens.start[first[r] : first[r + 1]], p.offsets[r + 1])
                    starts[0] = p.offsets[r]
                    gone_bytes = np.repeat(cut, np.diff(starts))
                    body = p.buf[p.offsets[r] : p.offsets[r + 1]][~gone_bytes]
                    texts[p.row0 + r] = body.tobytes().decode("utf-8", "replace")
                    keep[p.row0 + r] = not cut.all()
        at = table.schema.get_field_index(text_col)
        return table.set_column(at, table.schema.field(at), pa.array(texts, table.schema.field(at).type)).filter(pa.array(keep))

    return _deduplicated(df, _spec(id_col, text_col, window), finish, df.schema, block_bytes).select(*df.columns)


DIGEST_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i : i + 49], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
dup AS (SELECT rid, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
gone AS (SELECT DISTINCT rid, i + o AS p FROM dup, (SELECT unnest(range(50)) AS o)),
n AS (SELECT rid, count(*) AS n_removed, count(*) FILTER (p - 1 <> coalesce(q, -1)) AS n_spans FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS q FROM gone) GROUP BY rid),
k AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
"""

"""Toxicity by a factorization machine over hashed terms.

A text is read in windows of 50 words, so that one insult counts the same in a long text as in a short one.  The terms of
a window are its different lower-cased words and the five-byte pieces of its words (with a blank at both ends), which
words of one stem share; they are hashed into buckets.  The machine adds a weight for each term and, for each pair, the
product of the terms' factors, so an insult beside the mention of a group can weigh more than both by themselves.  A
text's score is that of its worst window.

The machine is fitted on the windows of at most ``LABELS`` labelled documents (in hash order of their ids, the bound is a
parameter), of each at most ``WINDOWS`` windows, also in hash order.  Tasks run AdaGrad over their own windows, and each
round's models are averaged (iterative parameter mixing, McDonald et al. 2010).  Labels are of documents, so the first
round finds the windows that give a toxic document away, and the others take these alone as examples of toxic ones.
Terms in fewer than ``RARE`` of the documents fitted on are left out, and so are those whose share of toxic documents
chance would explain (log-likelihood ratio below ``TELLING``, one in a thousand).  The model, a row for each bucket at
most, is of fixed size and goes to every task; every row is then scored where it is read.

Rows whose crc32 of the id, as text, is 1 modulo 3 are held out: their labels are never read.

Defined cases: a null or empty text is one window without terms; a null id is not held out and has no label; null labels
are none; an id with several labels is toxic if one says so; repeated rows score equal; without toxic or without other
labels every text gets the share of toxic ones (0 without labels); an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sedgewood.llm._state import settle
from sedgewood.llm._text import BASE, MIX, buffers, expand, mix, pieces, powers

WINDOW, GRAM, BUCKET_BITS, SEED = 50, 5, 17, 42
BUCKETS = 1 << BUCKET_BITS
LABELS, WINDOWS, RARE, TELLING = 20_000, 12, 5, 10.83
FACTORS, START, ROUNDS, PASSES, STEP, DECAY, TOXIC = 4, 0.1, 5, 4, 0.3, 1e-5, 0.7
#: Tasks that fit, and windows in a step.
TASKS, BLOCK = 8, 256
_U = np.uint64
#: Lower case and one kind of blank.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 0x20
_INVERSE = np.ones(1, np.uint64)


def _inverses(n: int) -> np.ndarray:
    """Inverses of the powers of the base, modulo 2**64."""
    global _INVERSE
    if len(_INVERSE) < n:
        _INVERSE = powers(max(n, 1024), _U(pow(int(BASE), -1, 1 << 64)))
    return _INVERSE[:n]


def terms(buf: np.ndarray, offsets: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows and their different terms: first window of each row (with their number appended), window and slot of each term.

    ``slot`` has the number of each bucket, negative if it is not used.
    """
    rows = len(offsets) - 1
    # a blank before, between and after the rows
    low = np.insert(_LOWER[buf], offsets, 0x20)
    starts = offsets[:-1] + np.arange(rows) + 1
    inside = low != 0x20
    opens = inside[1:] & ~inside[:-1]
    start = np.flatnonzero(opens) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    row = np.searchsorted(starts, start, "right") - 1
    first_word = np.searchsorted(row, np.arange(rows + 1))
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-np.diff(first_word) // WINDOW)))])
    if not len(start):
        return first, start, start
    window = first[row] + (np.arange(len(row)) - first_word[row]) // WINDOW
    value = low.astype(np.uint64)
    n = len(value)
    sums = np.cumsum((value + _U(1)) * powers(n))
    whole = mix((sums[end - 1] - sums[start - 1]) * _inverses(n)[start])
    # pieces hold blanks at their ends only
    m = n - GRAM + 1
    inner = inside[1 : 1 + m].copy()
    for k in range(2, GRAM - 1):
        inner &= inside[k : k + m]
    at = np.flatnonzero(inner)
    piece = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        piece = (piece << _U(8)) | value[at + k]
    bucket = np.concatenate([whole, piece * MIX]) >> _U(64 - BUCKET_BITS)
    own = slot[bucket.astype(np.int64)]
    used = np.flatnonzero(own >= 0)
    word = np.cumsum(opens, dtype=np.int32)
    grams = used[used >= len(whole)] - len(whole)
    of = np.concatenate([window[used[used < len(whole)]], window[word[at[grams]] - 1]])
    code = np.unique(of * len(slot) + own[used])
    return first, code // len(slot), code % len(slot)


@dataclass
class Machine:
    """Scores windows from the slots of their terms."""

    slot: np.ndarray
    intercept: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, window: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Intercept, weights and pairs of the terms of n windows."""
        out = self.intercept + np.bincount(window, weights=self.linear[term], minlength=n)
        squares = np.bincount(window, weights=(self.factors**2).sum(1)[term], minlength=n)
        for f in range(self.factors.shape[1]):
            squares -= np.bincount(window, weights=self.factors[term, f], minlength=n) ** 2
        return out - 0.5 * squares


def held_out(id_col: str | Column) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """doc, toxic, window and its buckets: the windows to learn from."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    used = known.where(~held_out("doc")).orderBy(F.xxhash64("doc", F.lit(SEED)), "doc").limit(most)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(used), "doc")
    every = np.arange(BUCKETS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column(batch.schema.get_field_index("text")))
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("doc", "toxic")]
            for i, j in pieces(offsets):
                first, window, term = terms(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], every)
                row = np.repeat(np.arange(i, j), np.diff(first))
                place = np.arange(len(row)) - first[row - i]
                # of each row the windows whose hash is least
                draw = ((place.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)) >> _U(11)
                order = np.lexsort((draw, row))
                kept = np.sort(order[np.arange(len(order)) - first[row[order] - i] < WINDOWS])
                starts = np.searchsorted(window, np.arange(first[-1] + 1))
                lists = [term[starts[k] : starts[k + 1]] for k in kept.tolist()]
                yield pa.record_batch([own[0].take(pa.array(row[kept])), own[1].take(pa.array(row[kept])), pa.array(place[kept]), pa.array(lists, pa.list_(pa.int32()))], names=["doc", "toxic", "window", "terms"])

    return rows.mapInArrow(read, "doc long, toxic int, window long, terms array<int>")


@dataclass
class Windows:
    """A task's examples: document, label and terms (as slots) of each window, documents in order."""

    doc: np.ndarray
    toxic: np.ndarray
    first: np.ndarray
    term: np.ndarray

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch], slot: np.ndarray) -> Windows:
        held = [b for b in batches if b.num_rows]
        if not held:
            return cls(*(np.zeros(n, np.int64) for n in (0, 0, 1, 0)))
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table["terms"].combine_chunks()
        own = slot[lists.flatten().to_numpy()]
        first = np.concatenate([[0], np.cumsum(own >= 0)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return cls(table["doc"].to_numpy(), table["toxic"].to_numpy(), first, own[own >= 0])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window (as its place in ``which``) and slot of the terms of some windows."""
        at, owner = expand(self.first[which], self.first[which + 1] - 1)
        return owner, self.term[at]


def likelihood_ratio(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Dunning's ratio for each term, from its documents (other, toxic) and all of both kinds."""
    out = np.zeros(seen.shape[1])
    for cells, sums in ((seen, seen.sum(0)), (total[:, None] - seen, total.sum() - seen.sum(0))):
        expected = np.maximum(sums[None] * (total / total.sum())[:, None], 1e-300)
        out += np.where(cells > 0, cells * np.log(np.maximum(cells, 1e-300) / expected), 0).sum(0)
    return 2 * out


def spread(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by index."""
    return np.stack([np.bincount(index, weights=values[:, c], minlength=n) for c in range(values.shape[1])], 1)


def train(w: Windows, model: Machine, rng: np.random.Generator, passes: int, telling: bool) -> np.ndarray:
    """The model's parameters (intercept, weights, factors) after some passes over a task's windows, by AdaGrad.

    With ``telling``, a toxic document's examples are the windows that the model gives 0.5 and the highest of them.
    """
    n, size, k = len(w.toxic), len(model.linear), model.factors.shape[1]
    use = np.arange(n)
    if telling and n:
        z = np.concatenate([model.logits(*w.take(use[i : i + BLOCK]), len(use[i : i + BLOCK])) for i in range(0, n, BLOCK)])
        opens = np.flatnonzero(np.concatenate([[True], w.doc[1:] != w.doc[:-1]]))
        top = np.repeat(np.maximum.reduceat(z, opens), np.diff(np.append(opens, n)))
        use = use[(w.toxic == 0) | (z >= 0) | (z == top)]
    table = np.concatenate([model.linear[:, None], model.factors], 1)
    past, bias, bias_past = np.full_like(table, 1e-6), model.intercept, 1e-6
    for _ in range(passes):
        order = rng.permutation(use)
        for i in range(0, len(order), BLOCK):
            some = order[i : i + BLOCK]
            window, term = w.take(some)
            if not len(term):
                continue
            active, at = np.unique(term, return_inverse=True)
            own = table[active]
            sums = spread(window, own[at], len(some))
            z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - np.bincount(window, weights=(own[:, 1:] ** 2).sum(1)[at], minlength=len(some)))
            miss = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - w.toxic[some]) / len(some)
            grad = spread(at, (miss[:, None] * np.concatenate([np.ones((len(some), 1)), sums[:, 1:]], 1))[window], len(active))
            grad[:, 1:] -= grad[:, :1] * own[:, 1:]
            grad += DECAY * own
            past[active] += grad**2
            table[active] = own - STEP * grad / np.sqrt(past[active])
            bias_past += miss.sum() ** 2
            bias -= STEP * miss.sum() / np.sqrt(bias_past)
    return np.concatenate([[bias], table.reshape(-1)])


def fit(found: DataFrame, factors: int = FACTORS, rounds: int = ROUNDS, rare: int = RARE) -> Machine | float:
    """The machine of the windows of ``examples``; the share of toxic documents where there is nothing to tell apart.

    Windows stay in the tasks; each round sends the model out and averages what the tasks made of it, a term by the tasks
    that have it.
    """
    found = settle(found.repartition(TASKS, "doc").sortWithinPartitions("doc", "window"))
    docs = found.groupBy("doc").agg(F.max("toxic").alias("toxic")).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not docs["n"] or docs["toxic"] in (0, docs["n"]):
        return docs["toxic"] / docs["n"] if docs["n"] else 0.0

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows.of(batches, np.arange(BUCKETS))
        place = np.unique(w.doc, return_inverse=True)[1] * 2 + w.toxic
        every = np.unique(np.repeat(place, np.diff(w.first)) * BUCKETS + w.term)
        for toxic in (0, 1):
            own = every[(every // BUCKETS) % 2 == toxic] % BUCKETS
            yield pa.record_batch([pa.array([toxic]), pa.array([np.bincount(own, minlength=BUCKETS).astype(np.int32).tobytes()], pa.binary())], names=["toxic", "n"])

    seen = np.zeros((2, BUCKETS))
    for r in found.mapInArrow(documents, "toxic long, n binary").collect():
        seen[r["toxic"]] += np.frombuffer(r["n"], np.int32)
    kept = np.flatnonzero((seen.sum(0) >= rare) & (likelihood_ratio(seen, np.array([docs["n"] - docs["toxic"], docs["toxic"]])) >= TELLING))
    slot = np.full(BUCKETS, -1, np.int64)
    slot[kept] = np.arange(len(kept))
    rng = np.random.default_rng(SEED)
    model = Machine(slot, float(np.log(docs["toxic"] / (docs["n"] - docs["toxic"]))), np.zeros(len(kept)), rng.normal(0, START, (len(kept), factors)))
    for r in range(rounds):

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = Windows.of(batches, model.slot)
            made = train(w, model, np.random.default_rng(SEED + r), PASSES, r > 0)
            share = np.bincount(w.term, minlength=len(kept)).astype(np.float32)
            yield pa.record_batch([pa.array([made.astype(np.float32).tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary()), pa.array([float(len(w.doc))])], names=["made", "seen", "n"])

        parts = found.mapInArrow(step, "made binary, seen binary, n double").collect()
        made = np.stack([np.frombuffer(p["made"], np.float32) for p in parts]).astype(float)
        share = np.stack([np.frombuffer(p["seen"], np.float32) for p in parts]).astype(float)
        share /= np.maximum(share.sum(0), 1)
        n = np.array([p["n"] for p in parts])
        table = (made[:, 1:].reshape(len(parts), len(kept), factors + 1) * share[:, :, None]).sum(0)
        model = Machine(slot, float((made[:, 0] * n).sum() / n.sum()), table[:, 0], table[:, 1:])
    return model


def scores(docs: DataFrame, model: Machine | float, id_col: str = "doc_id", text_col: str = "text", toxic_at: float = TOXIC) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    decided = (F.col("score") >= toxic_at).cast("int").alias("predicted")
    if not isinstance(model, Machine):
        return slim.select("doc_id", "held_out", F.lit(float(model)).alias("score")).select("*", decided)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column(2))
            out = np.zeros(batch.num_rows)
            for i, j in pieces(offsets):
                first, window, term = terms(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model.slot)
                out[i:j] = np.maximum.reduceat(model.logits(window, term, int(first[-1])), first[:-1])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(out, -700, 700))))], names=["doc_id", "held_out", "score"])

    return slim.mapInArrow(score, "doc_id long, held_out boolean, score double").select("*", decided)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labels: int = LABELS) -> DataFrame:
    return scores(docs, fit(examples(docs, labels, id_col, text_col, most_labels)), id_col, text_col)

"""Best-fit packing with large-item matching.

Documents become token ids; one longer than a sequence is cut into full pieces and a rest.  How pieces share sequences
depends on their lengths alone, so the packing is planned once on the histogram of lengths, which has at most as many
rows as a sequence has tokens, whatever the corpus: lengths above a third of the capacity are matched greedily, the
longest with the longest that still fits, two a sequence; then each smaller length, from the longest, goes to the
smallest gap that holds it.  The plan is a short table of ranges: pieces number r to s of a length fill sequences b to
e from some offset.  Every piece finds its place by its number within its length.

Tokens: a text's words are looked up in a bounded table of words already encoded, and only new words go through the
tokenizer.  The tokenizer's patterns never span white space, so this gives the ids of the whole text.

Defined cases: a null or empty text is its closing id alone; repeated rows are packed each; null ids stay null; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sedgewood.llm._blocks import partitions
from sedgewood.llm._state import settle
from sedgewood.llm._text import buffers, pieces, words
from sedgewood.llm.sharding import numbered

CAPACITY, END_ID = 4096, 1
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words that a worker remembers before it starts anew.
REMEMBERED = 500_000


_SIMPLE = np.zeros(256, bool)  # bytes of words whose tokens can be counted without the tokenizer
_SIMPLE[33:127] = True
_SIMPLE[[ord("'"), ord("<")]] = False  # contractions and special tokens
_KIND = np.full(256, 3, np.int8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


class WordEncoder:
    """Token ids of texts by way of their words.

    New words are encoded many at a time, as one text.  Where one word's ids end is known from the number of parts the
    tokenizer's pattern cuts it into (runs of letters, single digits, runs of the rest), each of which ends in a token
    that closes a word; words for which that number is not plain from their bytes are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for word, i in vocabulary.items():
            self.closes[i] = word.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.count, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _room(self, name: str, n: int) -> np.ndarray:
        have = getattr(self, name)
        if len(have) < n:
            have = np.concatenate([have, np.zeros(max(n, 2 * len(have)) - len(have), have.dtype)])
            setattr(self, name, have)
        return have

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, spelled: list[str], parts: np.ndarray, simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each has."""
        easy = np.flatnonzero(simple)
        joined = self._ids([" ".join(spelled[i] for i in easy[a : a + 1000]) for a in range(0, len(easy), 1000)])
        flat = np.fromiter(chain.from_iterable(joined), np.uint32)
        ends = np.flatnonzero(self.closes[flat])
        wanted = np.cumsum(parts[easy])
        if len(easy) and (len(ends) != wanted[-1] or (parts[easy] < 1).any()):
            simple, easy, flat, wanted = np.zeros(len(spelled), bool), easy[:0], flat[:0], wanted[:0]
        count = np.zeros(len(spelled), np.int64)
        if len(easy):
            count[easy] = np.diff(ends[wanted - 1] + 1, prepend=0)
        hard = np.flatnonzero(~simple)
        if not len(hard):
            return flat, count
        rest = self._ids([spelled[i] for i in hard])
        count[hard] = [len(x) for x in rest]
        out = np.empty(int(count.sum()), np.uint32)
        is_easy = np.repeat(simple, count)
        out[is_easy] = flat
        out[~is_easy] = np.fromiter(chain.from_iterable(rest), np.uint32)
        return out, count

    def _learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> None:
        after = np.append(buf[1:], np.uint8(0))
        lead = (buf == 0xC3) & (after >= 0x80) & (after != 0x97) & (after != 0xB7)
        plain = _SIMPLE[buf] | lead
        plain[1:] |= lead[:-1]
        kind = _KIND[buf]
        part = kind == 2
        part[1:] |= kind[1:] != kind[:-1]
        odd, parts = np.concatenate([[0], np.cumsum(~plain)]), np.concatenate([[0], np.cumsum(part)])
        # a word's first byte begins a part whatever stands before it
        n = parts[end] - parts[start + 1] + 1
        raw, a, b = buf.tobytes(), start.tolist(), end.tolist()
        spelled = [raw[x:y].decode("utf-8", "replace") for x, y in zip(a, b, strict=True)]
        ids, count = self._encode_new(spelled, n, odd[end] == odd[start])
        base = len(self.keys)
        self._room("pool", self.used + len(ids))[self.used : self.used + len(ids)] = ids
        self._room("first", base + len(keys))[base : base + len(keys)] = self.used + np.cumsum(count) - count
        self._room("count", base + len(keys))[base : base + len(keys)] = count
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.entry = np.insert(self.entry, at, base + np.arange(len(keys)))

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in one array, and where each row's ids start, with their number appended."""
        w = words(buf, offsets)
        if not len(w.hash):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        every, at, place = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.keys) + len(every) > REMEMBERED:
            self.forget()
        found = np.searchsorted(self.keys, every)
        new = np.ones(len(every), bool)
        inside = found < len(self.keys)
        new[inside] = self.keys[found[inside]] != every[inside]
        if new.any():
            self._learn(buf, w.start[at[new]], w.end[at[new]], every[new])
            found = np.searchsorted(self.keys, every)
        which = self.entry[found][place]
        count = self.count[which]
        end = np.cumsum(count)
        ids = self.pool[np.repeat(self.first[which] - (end - count), count) + np.arange(int(end[-1]))]
        return ids, np.concatenate([[0], end])[w.first]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """A worker's encoder, with the words it knows from earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each row: doc_id, piece, start, length and the checksum of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, close = encoder(tokenizer_path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            buf, offsets = buffers(batch.column(1))
            docs = batch.column(0).to_pylist()
            for i, j in pieces(offsets, 1 << 20):
                ids, first = own.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                raw, out = ids.astype("<u4").tobytes(), []
                for r in range(j - i):
                    a, b = int(first[r]), int(first[r + 1])
                    total = b - a + 1
                    for k, s in enumerate(range(0, total, capacity)):
                        e = min(s + capacity, total)
                        crc = zlib.crc32(raw[4 * (a + s) : 4 * min(a + e, b)])
                        out.append((docs[i + r], k, s, e - s, zlib.crc32(close, crc) if e == total else crc))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES_DDL)


class _Plan:
    """Ranges of bins by the gap they have left, and the placements made."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.gaps: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.placed: list[tuple[int, int, int, int, int, int]] = []
        self.taken: dict[int, int] = {}

    def add(self, bin0: int, n: int, gap: int) -> None:
        if n and gap:
            if gap not in self.open:
                insort(self.gaps, gap)
                self.open[gap] = []
            self.open[gap].append((bin0, n))

    def place(self, length: int, n: int, bin0: int, per_bin: int, offset: int) -> None:
        """The next n pieces of a length go into bins from bin0, ``per_bin`` in each, from ``offset``."""
        if n:
            rank = self.taken.get(length, 0)
            self.placed.append((length, rank, n, bin0, per_bin, offset))
            self.taken[length] = rank + n

    def fresh(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def fill(self, length: int, n: int, bin0: int, bins: int, gap: int) -> int:
        """Put up to n pieces into bins that have ``gap`` left, each filled before the next; returns how many are left."""
        q = gap // length
        full = min(bins, n // q)
        self.place(length, full * q, bin0, q, self.capacity - gap)
        self.add(bin0, full, gap - q * length)
        n -= full * q
        if full < bins:
            if n:
                self.place(length, n, bin0 + full, n, self.capacity - gap)
                self.add(bin0 + full, 1, gap - n * length)
                full, n = full + 1, 0
            self.add(bin0 + full, bins - full, gap)
        return n


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Placements (length, rank, n, bin, per_bin, offset) of all pieces, and the number of bins."""
    plan, left = _Plan(capacity), {k: v for k, v in histogram.items() if v}
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1
        if i < 0:
            n = left[a]
            plan.place(a, n, b := plan.fresh(n), 1, 0)
            plan.add(b, n, capacity - a)
        elif large[i] == a:  # with its like; an odd one is matched with the next shorter
            n = left[a] // 2
            if n:
                plan.place(a, 2 * n, b := plan.fresh(n), 2, 0)
                plan.add(b, n, capacity - 2 * a)
            if left[a] % 2:
                plan.place(a, 1, b := plan.fresh(1), 1, 0)
                if i:
                    plan.place(large[i - 1], 1, b, 1, a)
                    left[large[i - 1]] -= 1
                    plan.add(b, 1, capacity - a - large[i - 1])
                    if not left[large[i - 1]]:
                        large.pop(i - 1)
                else:
                    plan.add(b, 1, capacity - a)
        else:
            c = large[i]
            n = min(left[a], left[c])
            plan.place(a, n, b := plan.fresh(n), 1, 0)
            plan.place(c, n, b, 1, a)
            plan.add(b, n, capacity - a - c)
            left[c] -= n
            if not left[c]:
                large.pop(i)
            left[a] -= n
            if left[a]:
                continue
        large.remove(a)
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[s]
        while n:
            i = bisect_left(plan.gaps, s)
            if i == len(plan.gaps):
                bins = -(-n // (capacity // s))
                n = plan.fill(s, n, plan.fresh(bins), bins, capacity)
                continue
            gap = plan.gaps[i]
            bin0, bins = plan.open[gap].pop()
            if not plan.open[gap]:
                del plan.open[gap]
                plan.gaps.pop(i)
            n = plan.fill(s, n, bin0, bins, gap)
    return plan.placed, plan.bins


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every row with its sequence and the place there."""
    spark = df.sparkSession
    made = settle(token_pieces(df, tokenizer_path, id_col, text_col, capacity))
    # at most ``capacity`` rows reach the driver, and at most a few times as many are sent back
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed, _ = plan_packing(histogram, capacity)
    ranges = spark.createDataFrame(placed, "at_length long, rank long, n long, bin long, per_bin long, base long")
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(spark))).cast("int")
    ranked = numbered(made.withColumn("part", part), "length", "part", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")])
    t = F.col("slot") - F.col("rank")
    return (
        ranked.join(F.broadcast(ranges), (F.col("length") == F.col("at_length")) & (F.col("slot") >= F.col("rank")) & (F.col("slot") < F.col("rank") + F.col("n")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin") + F.floor(t / F.col("per_bin"))).cast("long").alias("sequence_id"), (F.col("base") + (t % F.col("per_bin")) * F.col("length")).alias("offset"))
    )

"""Benchmark decontamination by template canonicalisation.

Words lose punctuation and case; numbers (digits or number words), units after a number, and names (capitalised within a
sentence, a run of them as one) become typed placeholders.  A document and a benchmark item that share a window of 13
such tokens (a shorter item: all of them) at least 7 of which (of a shorter item: half, and 5) are words, may hold the
same question with other parameters; an operator counts as two words.  A number is split from letters after it (``12x``)
and at operators; an operator after a number or a letter belongs to the token that follows.  The windows of one pair that follow each other on one diagonal are then laid over each
other, and the slots must agree: one value of the item always faces one value of the document, and the reverse.  Such
runs are leaks.  Windows that agree word for word are leaks too, however few of their tokens are words and whatever the
slots around them say, so every item has an exact way; an item of one or two tokens is one only as a whole document.

Whether a capitalised word is a name cannot always be seen, so windows are made in five forms: all tokens as they are;
with numbers and units masked, and names as words (which finds texts in another case); and with names masked too, where
capitalised words that begin a sentence are words, or names if the text also has them as a name, or all names.

Windows of benchmark and documents meet in a hash join.  Documents only send windows that pass a Bloom filter of the
benchmark's, whose size follows the benchmark up to ``MOST_BITS``; beyond that it lets more windows through, and the
join still decides.  Each window carries its slots' values, so slots are compared on what the join returns, a row for
each window that matched.  No benchmark text reaches the driver.  Tokens are compared by 64-bit hashes.

Defined cases: a null text has no tokens and matches nothing; null ids are carried along; repeated rows are reported
each, items without an id as one item; empty tables give an empty result; other columns are carried along by
``decontaminate_stage``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sedgewood.llm._blocks import partitions
from sedgewood.llm._state import fresh, settle
from sedgewood.llm._text import IS_SPACE, MIX, Words, buffers, mix, pieces, rolling, span_hash, words

WINDOW, SHORTEST, MIN_WORDS, SHORT_WORDS, OPERATOR_WORDS = 13, 3, 7, 5, 2
#: Bits of the filter for each benchmark window, and the fewest and most bits that it has.
BITS, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 28

#: Units, in lower case.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "ton", "tons", "lb", "lbs",
    "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes",
    "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent",
    "degree", "degrees", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilogram", "kilograms", "mph", "kmh", "hz", "w", "kw", "v", "j", "n",
)

#: Number words, in lower case, with their digits.
NUMBERS = (
    ("zero", "0"), ("one", "1"), ("two", "2"), ("three", "3"), ("four", "4"), ("five", "5"), ("six", "6"), ("seven", "7"), ("eight", "8"), ("nine", "9"),
    ("ten", "10"), ("eleven", "11"), ("twelve", "12"), ("thirteen", "13"), ("fourteen", "14"), ("fifteen", "15"), ("sixteen", "16"), ("seventeen", "17"),
    ("eighteen", "18"), ("nineteen", "19"), ("twenty", "20"), ("thirty", "30"), ("forty", "40"), ("fifty", "50"), ("sixty", "60"), ("seventy", "70"),
    ("eighty", "80"), ("ninety", "90"), ("hundred", "100"), ("thousand", "1000"), ("million", "1000000"),
)

_U = np.uint64
NUM, UNIT, NAME = (mix(np.array([x], np.uint64))[0] for x in (1, 2, 3))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xE0)]] = True
_OPERATOR, _NARROW = np.zeros(256, bool), np.zeros(256, bool)
_OPERATOR[[ord(c) for c in "+-*/=^<>%"]] = True
_NARROW[[ord(c) for c in "-/"]] = True  # operators only between digits, within a word
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True


@dataclass
class Tokens:
    """Canonical tokens of a piece: template value, own hash, type (0 word, 1 number, 2 unit, 3 name), row and first of each row."""

    template: np.ndarray
    leading: np.ndarray  # 1 for a capitalised word that begins a sentence, 2 if the row has it as a name elsewhere, else 0
    value: np.ndarray
    kind: np.ndarray
    word: np.ndarray  # number of the raw word within its row
    row: np.ndarray
    first: np.ndarray
    operator: np.ndarray  # hash of the operator before it, else 0


def _segments(buf: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and word of the parts of words: cut at operators beside digits, and between a number and the letters after it."""
    digit, alnum = _DIGIT[buf], _ALNUM[buf]
    p = np.flatnonzero(_OPERATOR[buf])
    p = p[(p > 0) & (p < len(buf) - 1)]
    p = p[alnum[p - 1] & alnum[p + 1] & np.where(_NARROW[buf[p]], digit[p - 1] & digit[p + 1], digit[p - 1] | digit[p + 1])]
    q = np.flatnonzero(digit[:-1] & _LETTER[buf[1:]]) + 1
    if len(q):
        before = np.flatnonzero(~digit)  # the byte before the run of digits must be no letter
        at = np.searchsorted(before, q) - 1
        own = w.start[np.searchsorted(w.start, q, "right") - 1]
        q = q[(at < 0) | (before[at] < own) | ~alnum[before[at]]]
    if not len(p) and not len(q):
        return w.start, w.end, np.arange(len(w.start))
    start = np.unique(np.concatenate([w.start, p, p + 1, q]))
    word = np.searchsorted(w.start, start, "right") - 1
    return start, np.minimum(np.append(start[1:], len(buf)), w.end[word]), word


def _lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin-1 letters."""
    low = _LOWER[buf]
    if len(buf) > 1:
        latin = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[1:][latin] += 0x20
    return low


def _hash_of(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return span_hash(raw, np.ones(len(raw), bool), np.array([0]), np.array([len(raw)]))[0]


_UNIT_HASHES = np.sort(np.array([_hash_of(u) for u in UNITS], np.uint64))
_NUMBER_HASHES, _NUMBER_VALUES = (np.array(x, np.uint64) for x in zip(*sorted((int(_hash_of(w)), int(_hash_of(d))) for w, d in NUMBERS), strict=True))


def tokens(buf: np.ndarray, offsets: np.ndarray) -> Tokens:
    w = words(buf, offsets, hashed=False)
    rows = len(offsets) - 1
    if not len(w.start):
        z = np.zeros(0, np.int64)
        return Tokens(np.zeros(0, np.uint64), z, np.zeros(0, np.uint64), z, z, z, np.zeros(rows + 1, np.int64), np.zeros(0, np.uint64))
    start, end, word = _segments(buf, w)
    own_row = w.row[word]
    low, keep = _lowered(buf), _ALNUM[buf] & ~IS_SPACE[buf]
    value = span_hash(low, keep, start, end)
    kept = np.concatenate([[0], np.cumsum(keep)])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    letters, digits = kept[end] - kept[start], digit[end] - digit[start]
    number = (letters > 0) & (digits == letters)
    head = buf[start]
    upper = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (low[np.minimum(start + 1, len(buf) - 1)] != buf[np.minimum(start + 1, len(buf) - 1)]))
    second = buf[np.minimum(start + 1, len(buf) - 1)]
    upper &= ~((end - start > 1) & (second >= 65) & (second <= 90))  # all capitals is no name
    upper[1:] &= word[1:] != word[:-1]  # nor are letters after a number
    inside = np.zeros(len(head), bool)  # not the first word of a row or sentence
    inside[1:] = (own_row[1:] == own_row[:-1]) & ~_STOP[buf[end[:-1] - 1]]
    some = letters > 0
    index = word - w.first[own_row]
    # an operator between a number or a letter and another token
    signs = np.flatnonzero((end - start == 1) & _OPERATOR[head])
    signs = signs[(signs > 0) & (signs < len(head) - 1)]
    signs = signs[(letters[signs + 1] > 0) & (own_row[signs + 1] == own_row[signs]) & (own_row[signs - 1] == own_row[signs]) & (number | (letters == 1))[signs - 1]]
    operator = np.zeros(len(head), np.uint64)
    operator[signs + 1] = mix(head[signs].astype(np.uint64) + _U(1000))
    leads = (upper & ~inside)[some]
    value, number, name, row, index = value[some], number[some], (upper & inside)[some], own_row[some], index[some]
    place = np.minimum(np.searchsorted(_NUMBER_HASHES, value), len(_NUMBER_HASHES) - 1)
    spelled = _NUMBER_HASHES[place] == value
    value = np.where(spelled, _NUMBER_VALUES[place], value)
    number, name, leads = number | spelled, name & ~spelled, leads & ~spelled
    place = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
    unit = np.zeros(len(value), bool)
    unit[1:] = number[:-1] & (row[1:] == row[:-1])
    unit &= _UNIT_HASHES[place] == value
    kind = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))
    template = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, value)))
    leading = (leads & (kind == 0)).astype(np.int64)
    led, named = np.flatnonzero(leading), kind == 3
    leading[led] += np.isin(mix(value[led] ^ (row[led].astype(np.uint64) * MIX)), mix(value[named] ^ (row[named].astype(np.uint64) * MIX)))
    return Tokens(template, leading, value, kind, index, row, np.searchsorted(row, np.arange(rows + 1)), operator[some])


@dataclass
class Form:
    """One reading of a piece: template and value of each token, whether it is a slot, raw word, row, and first of each row."""

    template: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    word: np.ndarray
    row: np.ndarray
    first: np.ndarray
    weight: np.ndarray  # how many words each token counts for
    literal: bool = False


def _masked(t: Tokens, name: np.ndarray) -> Form:
    """Numbers and units as slots, and the given tokens as names, a run of them as one."""
    slot = ((t.kind == 1) | (t.kind == 2)) | name
    template = np.where(name, NAME, np.where(t.kind == 3, t.value, t.template)) ^ t.operator
    weight = ~slot + OPERATOR_WORDS * (t.operator != 0)
    follows = np.zeros(len(name), bool)
    # a word that leads a sentence begins a run of its own
    follows[1:] = name[1:] & name[:-1] & (t.row[1:] == t.row[:-1]) & (t.leading[1:] == 0)
    if not follows.any():
        return Form(template, t.value, slot, t.word, t.row, t.first, weight)
    keep = np.flatnonzero(~follows)
    depth = np.arange(len(name)) - np.repeat(keep, np.diff(np.append(keep, len(name))))
    value = np.add.reduceat(np.where(depth == 0, t.value, mix(t.value + depth.astype(np.uint64) * MIX)), keep)
    row = t.row[keep]
    return Form(template[keep], value, slot[keep], t.word[keep], row, np.searchsorted(row, np.arange(len(t.first))), weight[keep])


def forms(t: Tokens) -> list[Form]:
    """The readings of a piece that differ: literal, names as words, and names with leading words as words, as known, as names."""
    none = np.zeros(len(t.kind), bool)
    out = [Form(t.value ^ t.operator, t.value, none, t.word, t.row, t.first, ~none + 0, True), _masked(t, none)]
    last = none
    for least in (3, 2, 1):
        name = (t.kind == 3) | (t.leading >= least)
        if (name != last).any():
            out.append(_masked(t, name))
        last = name
    return out


def _salt(size: int, kind: int) -> np.uint64:
    """Windows of one size and kind (0 template, 1 literal, 2 whole text) have hashes of their own."""
    return _U((size * 3 + kind) * int(MIX) & (1 << 64) - 1)


@dataclass
class Windows:
    """Windows of a piece: hash, row, place in the row's tokens, size, whether literal, raw word, and the values and offsets of their slots."""

    hash: np.ndarray
    row: np.ndarray
    place: np.ndarray
    size: np.ndarray
    literal: np.ndarray
    word: np.ndarray
    slots: list[np.ndarray]
    offsets: list[np.ndarray]


def _taken(form: Form, at: np.ndarray, size: int, h: np.ndarray) -> tuple:
    cells = at[:, None] + np.arange(size)
    slot = form.slot[cells]
    cut = np.cumsum(slot.sum(1))[:-1]
    values, offsets = form.value[cells][slot], np.nonzero(slot)[1]
    row = form.row[at]
    return h, row, at - form.first[row], np.full(len(at), size), np.full(len(at), form.literal), form.word[at], np.split(values, cut) if len(at) else [], np.split(offsets, cut) if len(at) else []


def _gathered(parts: list[tuple]) -> Windows:
    if not parts:
        z = np.zeros(0, np.int64)
        return Windows(np.zeros(0, np.uint64), z, z, z, np.zeros(0, bool), z, [], [])
    columns = list(zip(*parts, strict=True))
    arrays = [np.concatenate(c) for c in columns[:6]]
    slots, offsets = ([x for part in c for x in part] for c in columns[6:])
    # the same window in several forms counts once
    _, first = np.unique(np.stack([arrays[0], arrays[1].astype(np.uint64), arrays[2].astype(np.uint64)], 1), axis=0, return_index=True)
    return Windows(*(x[first] for x in arrays), [slots[i] for i in first], [offsets[i] for i in first])


def item_windows(text: str) -> Windows:
    """All windows by which an item is looked for."""
    buf = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    t = tokens(buf, np.array([0, len(buf)]))
    n, parts = len(t.value), []
    if 0 < n < SHORTEST:
        return _gathered([_taken(forms(t)[0], np.zeros(1, np.int64), n, rolling(t.value, n) ^ _salt(n, 2))])
    for form in forms(t):
        m = len(form.value)
        size = min(WINDOW, m)
        if m < SHORTEST:
            continue
        fixed = np.concatenate([[0], np.cumsum(form.weight)])
        ok = (fixed[size:] - fixed[:-size] >= max(SHORT_WORDS, min(MIN_WORDS, -(-size // 2)))) | form.literal
        readings = [(form, ok)]
        if not form.literal and not form.slot[0]:
            # within a document, the item's first word may look like a name
            first = np.arange(m) == 0
            readings.append((Form(np.where(first, NAME, form.template), form.value, form.slot | first, form.word, form.row, form.first, form.weight - first), ok & (np.arange(len(ok)) == 0)))
        for reading, good in readings:
            at = np.flatnonzero(good)
            parts.append(_taken(reading, at, size, rolling(reading.template, size)[at] ^ _salt(size, int(form.literal))))
    return _gathered(parts)


def text_windows(t: Tokens, sizes: list[int], bits: np.ndarray) -> Windows:
    """The windows of a piece that pass the filter."""
    parts, lengths = [], np.diff(t.first)
    readings = forms(t)
    for size in sizes:
        if size < SHORTEST:
            row = np.flatnonzero(lengths == size)
            at = t.first[row]
            h = rolling(t.value, size)[at] ^ _salt(size, 2) if len(at) else np.zeros(0, np.uint64)
            parts.append(_taken(readings[0], at[passes(h, bits)], size, h[passes(h, bits)]))
            continue
        for form in readings:
            if len(form.value) >= size:
                h = rolling(form.template, size) ^ _salt(size, int(form.literal))
                at = np.flatnonzero(passes(h, bits))
                at = at[form.row[at] == form.row[at + size - 1]]
                if len(at):
                    parts.append(_taken(form, at, size, h[at]))
    return _gathered([p for p in parts if len(p[0])])


def _places(h: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of the filter for each hash."""
    return h & _U(n_bits - 1), (h >> _U(32)) * _U(0x9E3779B1) >> _U(3) & _U(n_bits - 1)


def passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    one, two = _places(h, 8 * len(bits))
    out = (bits[(one >> _U(3)).astype(np.int64)] >> (one & _U(7)).astype(np.uint8) & 1).astype(bool)
    some = np.flatnonzero(out)
    two = two[some]
    out[some] = (bits[(two >> _U(3)).astype(np.int64)] >> (two & _U(7)).astype(np.uint8) & 1).astype(bool)
    return out


def filter_of(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    bits = np.zeros(n_bits, bool)
    for place in _places(hashes, n_bits):
        bits[place.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def agreed(place: np.ndarray, size: np.ndarray, literal: np.ndarray, offsets: list, mine: list, theirs: list) -> Iterator[tuple[int, int, int, int]]:
    """(index of the first window, windows, slots, changed slots) of each run of a pair's windows on one diagonal that agrees.

    Windows come by place.  A run ends where a token lies in none of its windows.
    """
    new = np.ones(len(place), bool)
    new[1:] = place[1:] > np.maximum.accumulate(place + size)[:-1]
    edge = np.append(np.flatnonzero(new), len(place))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        for own in (range(a, b), [i for i in range(a, b) if literal[i]]):  # all windows, else the literal ones alone
            if not own:
                continue
            pairs = {int(place[i]) + int(o): (m, v) for i in own for o, m, v in zip(offsets[i], mine[i], theirs[i], strict=True)}
            forth, back = dict(pairs.values()), {v: m for m, v in pairs.values()}
            if all(forth[m] == v and back[v] == m for m, v in pairs.values()):
                yield own[0], len({int(place[i]) for i in own}), len(pairs), sum(m != v for m, v in pairs.values())
                break


_ITEM_DDL = "h long, item_id long, place int, size int, literal boolean, offsets array<int>, mine array<long>"
_TEXT_DDL = "h long, rid long, doc_id long, text_hash long, at int, word int, theirs array<long>"
_FOUND = "doc_id long, item_id long, text_hash long, first_word long, n_windows long, n_slots long, n_changed long"


def _lists(parts: list[np.ndarray], dtype) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(dtype)))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """A row for each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = item_windows(text or "")
                if len(w.hash):
                    yield pa.record_batch(
                        [pa.array(w.hash.view(np.int64)), pa.array([item] * len(w.hash), pa.int64()), pa.array(w.place, pa.int32()), pa.array(w.size, pa.int32()), pa.array(w.literal), _lists(w.offsets, np.int32), _lists([x.view(np.int64) for x in w.slots], np.int64)],
                        names=["h", "item_id", "place", "size", "literal", "offsets", "mine"],
                    )

    return benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, _ITEM_DDL)


def collect_filter(made: DataFrame) -> tuple[list[int], np.ndarray]:
    """The sizes of the benchmark's windows and their filter, of at most ``MOST_BITS`` bits, put together by tasks in parts of 8 kB."""
    counts = made.groupBy("size").agg(F.count("*").alias("n")).collect()  # at most WINDOW rows
    total, n_bits = sum(r["n"] for r in counts), LEAST_BITS
    while n_bits < min(BITS * total, MOST_BITS):
        n_bits *= 2

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.unique(np.concatenate(_places(h, n_bits))).astype(np.int64)
            yield pa.record_batch([pa.array(place >> 16), pa.array(place & 0xFFFF)], names=["part", "bit"])

    def join(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, bool)
        bits[table["bit"].to_numpy()] = True
        return pa.table({"part": table["part"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(n_bits >> 3, np.uint8)
    for r in made.select("h").mapInArrow(parts, "part long, bit long").distinct().groupBy("part").applyInArrow(join, "part long, bits binary").collect():
        out[r["part"] << 13 : (r["part"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return sorted(r["size"] for r in counts), out


def document_windows(docs: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """A row for each window of docs(doc_id, text_hash, text) that passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            buf, offsets = buffers(batch.column(2))
            for i, j in pieces(offsets):
                w = text_windows(tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), sizes, bits)
                if len(w.hash):
                    row = pa.array(w.row + i)
                    yield pa.record_batch(
                        [pa.array(w.hash.view(np.int64)), pa.array(base + i + w.row), batch.column(0).take(row), batch.column(1).take(row), pa.array(w.place, pa.int32()), pa.array(w.word, pa.int32()), _lists([x.view(np.int64) for x in w.slots], np.int64)],
                        names=["h", "rid", "doc_id", "text_hash", "at", "word", "theirs"],
                    )
            base += batch.num_rows

    return docs.mapInArrow(run, _TEXT_DDL)


def _judged(table: pa.Table) -> pa.Table:
    """The leaks among a group of whole document rows' matched windows: the longest agreeing run of each row and item."""
    cols = {c: table[c].to_numpy() for c in ("rid", "at", "place", "size", "literal", "word")}
    cols["item_id"] = table["item_id"].fill_null(-(1 << 63)).to_numpy()
    n_slots = np.array([len(x) for x in table["mine"].to_pylist()], np.int64)
    shift = cols["at"].astype(np.int64) - cols["place"]
    # of one window in several forms, that with the fewest slots comes first
    order = np.lexsort((n_slots, cols["place"], shift, cols["item_id"], cols["rid"]))
    key = np.stack([cols["rid"], cols["item_id"], shift], 1)[order]
    order = order[np.concatenate([[True], (key[1:] != key[:-1]).any(1) | (cols["place"][order][1:] != cols["place"][order][:-1])])]
    key = np.stack([cols["rid"], cols["item_id"], shift], 1)[order]
    place, size, literal, word = (cols[c][order] for c in ("place", "size", "literal", "word"))
    offsets, mine, theirs = (table[c].take(pa.array(order)).to_pylist() for c in ("offsets", "mine", "theirs"))
    edge = np.append(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])), len(order))
    best: dict[tuple, tuple] = {}
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        for first, n, slots, changed in agreed(place[a:b], size[a:b], literal[a:b], offsets[a:b], mine[a:b], theirs[a:b]):
            pair = int(key[a][0]), int(key[a][1])
            found = n, -int(word[a + first]), slots, changed, int(order[a + first])
            best[pair] = max(found, best.get(pair, found))
    rows = list(best.values())
    at = pa.array([r[4] for r in rows], pa.int64())
    own = [table[c].take(at) for c in ("doc_id", "item_id", "text_hash")]
    return pa.table([*own, *(pa.array(x, pa.int64()) for x in ([-r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows]))], names=["doc_id", "item_id", "text_hash", "first_word", "n_windows", "n_slots", "n_changed"])


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str | None, text_col: str, item_col: str, item_text: str) -> DataFrame:
    own = settle(benchmark_windows(benchmark, item_col, item_text))
    sizes, bits = collect_filter(own)
    doc_id = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    slim = docs.select(doc_id.alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    met = document_windows(slim, sizes, bits).join(own, "h")
    group = F.pmod(F.xxhash64("rid"), F.lit(4 * partitions(docs.sparkSession)))
    return met.withColumn("group", group).groupBy("group").applyInArrow(_judged, _FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document row and item that match, with the longest match's first_word, n_windows, n_slots, n_changed."""
    return _leaks(docs, benchmark, id_col, text_col, item_col, item_text).drop("text_hash")


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that match an item; equal texts are judged alike, by 64-bit hash."""
    h = fresh(docs, "h")
    found = _leaks(docs, benchmark, None, text_col, item_col, item_text).select(F.col("text_hash").alias(h)).distinct()
    return docs.withColumn(h, F.xxhash64(text_col)).join(found, h, "left_anti").select(*docs.columns)

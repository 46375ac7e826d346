from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import xxhash

from sedgewood.llm import _trie, near_copies, simhash, substring_dedup, suffix_dedup
from sedgewood.llm._state import connected_components


def covered(units, width, rows_of):
    """Brute force: which units of each row lie in a window that also starts in a row of smaller id."""
    first, out = {}, {}
    for i, t in sorted(units.items()):
        gone = [False] * len(t)
        for k in range(len(t) - width + 1):
            w = rows_of(t[k : k + width])
            if first.setdefault(w, i) < i:
                gone[k : k + width] = [True] * width
        out[i] = gone
    return out


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_words_match_brute_force(documents, corpus):
    units = {i: words(t) for i, t in corpus}
    gone = covered(units, 50, b" ".join)
    got = {r["doc_id"]: r for r in substring_dedup.dedup_digest(documents).collect()}
    assert len(got) == len(corpus)
    for i, w in units.items():
        kept = b" ".join(x for x, g in zip(w, gone[i]) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone[i]), hashlib.sha256(kept).hexdigest()), i
    assert sum(map(sum, gone.values())) > 500


def test_bytes_match_brute_force(documents, corpus):
    units = {i: (t or "").encode() for i, t in corpus}
    gone = covered(units, 50, bytes)
    got = {r["doc_id"]: r for r in suffix_dedup.dedup_digest(documents).collect()}
    for i, b in units.items():
        g = gone[i]
        runs = sum(x and not y for x, y in zip(g, [False, *g]))
        kept = bytes(x for x, y in zip(b, g) if not y)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), sum(g), runs, hashlib.sha256(kept).hexdigest()), i


def test_hot_phrase_is_taken_apart(spark):
    """A phrase within many different texts: its contexts are dealt by window, and nothing is lost."""
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    phrase = "the one phrase that all have in common"
    some = lambda n: letters[rng.integers(0, 27, n)].tobytes().decode()
    rows = [(i, some(60) + phrase + some(60)) for i in range(120)]
    rows += [(200 + i, some(30) + rows[i][1][45:130] + some(30)) for i in range(20)]
    gone = covered({i: t.encode() for i, t in rows}, 50, bytes)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for many in (2, 16, 10**9):
        got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup_digest(df, block_bytes=4000, many=many).collect()}
        assert got == {i: sum(g) for i, g in gone.items()}
    assert sum(map(sum, gone.values())) > 1000


def test_hot_anchors_are_found():
    import pyarrow as pa

    table = pa.table({"id": pa.array(range(40)), "text": [f"{i:045d}the one phrase that all have{i:045d}" for i in range(40)]})
    found = list(suffix_dedup._anchors.scan(table, suffix_dedup._spec()))
    h, _, count = suffix_dedup._anchors.distinct_anchors(found, np.ones(40, bool))
    many = suffix_dedup._anchors.many_contexts(found, h, count, 50)
    assert 0 < many.sum() < 20
    masks = np.ones(len(h), bool), many
    kept = suffix_dedup._anchors.keep_shared(found, h, masks, np.ones(40, bool), 50)
    alone = np.concatenate([p.alone for p in kept])
    assert alone.any() and all((p.low[p.alone] == p.high[p.alone]).all() for p in kept)


def test_bytes_of_periodic_texts(spark):
    rows = [(1, "x" * 400_000), (2, "ab" * 100_000), (3, "ba" * 500), (4, "x" * 200), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup_digest(df).collect()}
    assert got == {1: (400_000, 0), 2: (200_000, 0), 3: (1_000, 1_000), 4: (200, 200), 5: (0, 0)}


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_awkward_rows(operator, awkward, nothing):
    rows = operator.dedup_digest(awkward).collect()
    assert len(rows) == 6
    lost = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"] > 0) for r in rows)
    # rows without id and rows of equal id are left alone; the later id loses its text
    assert lost == [(False, 7, False), (False, 7, False), (False, 8, True), (False, 9, False), (True, 0, False), (True, 0, False)]
    assert operator.dedup_digest(nothing).collect() == []


def test_substring_stage(documents, corpus, awkward, nothing):
    out = substring_dedup.dedup_stage(documents)
    assert out.columns == documents.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    gone = covered({i: words(t) for i, t in corpus}, 50, b" ".join)
    for i, t in corpus:
        w = words(t)
        if w and all(gone[i]):
            assert i not in got
        elif any(gone[i]):
            assert words(got[i]) == [x for x, g in zip(w, gone[i]) if not g]
        else:
            assert got[i] == t
    assert substring_dedup.dedup_stage(nothing).count() == 0
    assert substring_dedup.dedup_stage(awkward).count() == 5


def block_of(rows):
    import pyarrow as pa

    return pa.table({"id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})


def test_factors_of_a_parse():
    """Factors are copied from their reference, are maximal, and leave only what crosses their boundaries open."""
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"u{x}" for x in rng.integers(0, 1 << 40, n)]
    first, second, third = fresh(300), fresh(260), fresh(120)
    # a passage of each earlier text, a changed word in the second, and a short one that is no factor
    late = [*fresh(30), *first[40:200], *second[10:100], "changed", *second[101:180], *fresh(20), *third[:45], *fresh(10)]
    rows = [(1, " ".join(first)), (2, " ".join(second)), (3, " ".join(third)), (9, " ".join(late))]
    spec = substring_dedup._spec("id", "text", 50)
    table = block_of(rows)
    r = substring_dedup.runs_of(table, spec)
    import pyarrow as pa

    least = {}
    for h, i in zip(r.hash.view(np.int64).tolist(), r.id.tolist()):
        least.setdefault(h, set()).add(i)
    wanted = pa.table({"h": pa.array([h for h, i in least.items() if len(i) > 1], pa.int64()), "reference": pa.array([min(i) for i in least.values() if len(i) > 1], pa.int64())})
    f = substring_dedup.parse(r, substring_dedup.phrases(table, wanted, spec), 50)
    at = len(first) + len(second) + len(third)
    got = [(s - at, n, ref) for s, n, ref in zip(f.start.tolist(), f.length.tolist(), f.reference.tolist())]
    assert got == [(30, 160, 1), (190, 90, 2), (281, 79, 2)]
    for s, n, ref in got:
        source = {1: first, 2: second, 3: third}[ref]
        k = source.index(late[s])
        assert late[s : s + n] == source[k : k + n] and late[s - 1] != source[k - 1] and late[s + n] != source[k + n : k + n + 1]
    # open windows have an indexed anchor and lie in no factor
    assert len(f.open) and not any(s + at <= o and o + 50 <= s + at + n for o in f.open.tolist() for s, n, _ in got)


def test_windows_beyond_the_smallest_documents_phrase(spark):
    """An anchor of three texts: the first goes on otherwise, so the others' window is found by look-up."""
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"u{x}" for x in rng.integers(0, 1 << 40, n)]
    core = fresh(30)
    left, right = fresh(25), fresh(25)
    rows = [(i, " ".join([*fresh(40), *a, *core, *b, *fresh(40)])) for i, (a, b) in enumerate([(fresh(25), fresh(25)), (left, right), (left, right), (left, fresh(25)), (fresh(25), right)], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_digest(df).collect()}
    gone = covered({i: words(t) for i, t in rows}, 50, b" ".join)
    assert got == {i: sum(g) for i, g in gone.items()} == {1: 0, 2: 0, 3: 80, 4: 55, 5: 55}


def test_periodic_texts(spark):
    rows = [(1, "x " * 300_000), (2, "ab cd ef " * 60_000), (3, "cd ef ab " * 1_000), (4, "y" * 500_000), (5, "x " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_digest(df).collect()}
    assert got == {1: (300_000, 0), 2: (180_000, 0), 3: (3_000, 3_000), 4: (1, 0), 5: (200, 200)}


def test_loser_tree_merges_and_counts_prefixes():
    rng = np.random.default_rng(3)
    width = suffix_dedup.WIDTH
    runs = []
    for n in (0, 1, 40, 17, 5):
        keys = sorted({bytes(rng.integers(97, 99, width, dtype=np.uint8)[: rng.integers(1, 6)]).ljust(width, b"\1") for _ in range(n)})
        shared = [0] + [next((k for k in range(width) if a[k] != b[k]), width) for a, b in zip(keys, keys[1:])]
        runs.append((keys, shared[: len(keys)]))
    source, prefix = suffix_dedup.merge_runs(runs)
    at = [0] * len(runs)
    merged = []
    for s in source:
        merged.append(runs[s][0][at[s]])
        at[s] += 1
    assert merged == sorted(k for r in runs for k in r[0])
    for a, b, p in zip(merged, merged[1:], prefix[1:]):
        assert p == next((k for k in range(width) if a[k] != b[k]), width)


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin((fps[a] ^ fps[b]) & (1 << 64) - 1).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def fingerprint(text):
    up = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(up)) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [1_000_000, 2])
def test_simhash_matches_brute_force(documents, corpus, hot):
    fps = {i: fingerprint(t) for i, t in corpus}
    expected = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.components(documents, hot=hot).collect()}
    assert got == {i: (f"{fps[i]:016x}", expected[i]) for i in fps}
    assert len(set(expected.values())) < len(expected)


def test_simhash_awkward(awkward, nothing, documents):
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in simhash.components(awkward).collect())
    assert rows == [(False, 7, 7), (False, 7, 7), (False, 8, 7), (False, 9, 9), (True, 0, 7), (True, 0, 9)]
    assert simhash.components(nothing).count() == 0
    kept = simhash.dedup_stage(awkward)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 7), (False, 9), (True, 0), (True, 0)]
    assert simhash.dedup_stage(documents).columns == documents.columns


def five_word_sets(corpus):
    out = {}
    for i, t in corpus:
        w = (t or "").lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def edited(rng, text, edits):
    w = text.split()
    for k in rng.choice(len(w), edits, replace=False):
        w[k] = "edited"
    return " ".join(w)


def test_near_copies_match_brute_force(spark, corpus, nothing):
    rng = np.random.default_rng(5)
    rows = [(i, t) for i, t in corpus if i != 400]
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 150)) for _ in range(12)]
    for k, text in enumerate(base):
        rows += [(1000 + 20 * k, text)] + [(1001 + 20 * k + j, edited(rng, text, 1 + j % 4)) for j in range(12)]
    sets = five_word_sets(rows)
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.components(df).collect()}
    assert got == {i: root(i) for i in sets}
    kept = {r["doc_id"] for r in simhash.dedup_stage(df).collect()}
    assert kept == {i for i in sets if root(i) == i}
    # three bits of 64 do not reach these copies
    fps = brute_components({i: fingerprint(t) for i, t in rows})
    assert len({fps[i] for i in sets if i >= 1000}) > len({root(i) for i in sets if i >= 1000})
    assert near_copies.components(nothing).count() == 0


def test_rows_of_one_id_with_other_texts_stay(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    df = spark.createDataFrame([(5, one, "x"), (5, two, "x"), (5, one, "x"), (6, two, "x"), (7, one + " end", "x"), (None, one, "x")], "doc_id long, text string, h string")
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in simhash.dedup_stage(df).collect()))) == sorted(map(repr, [(5, one), (5, two), (None, one)]))


def test_trie_join_equals_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    near = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 48, 40).astype(np.uint64)) for _ in range(6)])
    values = np.unique(near)
    label = _trie.join(values, np.zeros(len(values), np.int64), 64, 3)
    expected = brute_components({i: int(v) for i, v in enumerate(values)})
    assert [expected[i] for i in range(len(values))] == [int(min(j for j in range(len(values)) if label[j] == label[i])) for i in range(len(values))]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_near_copy_stage_joins_fingerprints(spark, monkeypatch):
    """The stage's groups come from SimHash first: a long text with one word changed is within its three bits."""
    words = [f"w{i * i % 9973}x{i}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:1500], "changed", *words[1501:]])), (3, " ".join(f"other{i}" for i in range(500)))]
    found, stars = [], simhash.stars

    def spy(fps):
        links = stars(fps)
        found.append((fps.count(), links.count()))
        return links

    monkeypatch.setattr(simhash, "stars", spy)
    kept = simhash.dedup_stage(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert found in ([(3, 1)], [(2, 0)])  # two near fingerprints, or equal ones

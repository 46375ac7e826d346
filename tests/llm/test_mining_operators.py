from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sedgewood.llm import filter_audit, phrases, toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def sql(text, **frames):
    c = duckdb.connect()
    for name, frame in frames.items():
        c.register(name, frame.toPandas().astype({"doc_id": "Int64"}))
    return sorted(map(repr, c.sql(text).fetchall()))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def mixed(spark, corpus):
    """Texts in several languages, null and empty ones, ids that are null or repeated, copies in other languages."""
    langs = ["en", "de", None, "", "en", "en"]
    rows = [(i, t, langs[(i or 0) % 6], "s", 0) for i, t in corpus if i != 400]
    rows += [(None, rows[3][1], "en", "s", 0), (None, "only here", "fr", "s", 0), (None, "only here", "fr", "s", 0), (12, rows[2][1], "de", "s", 0), (12, rows[2][1], "de", "s", 0)]
    rows += [(900, "ALL CAPS # " * 60, "en", "s", 0), (901, "Red red; RED red!\tred  red\x0bred red", "en", "s", 0)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="module")
def marks(spark):
    rows = [(i, i % 2, int(i % 5 == 0)) for i in range(10, 60)] + [(10, 1, 1), (100, None, 1), (101, 1, None), (None, 1, 1), (7777, 1, 1)]
    return spark.createDataFrame(rows, LABELS)


def test_audit_matches_sql(spark, mixed, marks, awkward, nothing):
    for docs in (mixed, awkward.select("doc_id", "text", "lang")):
        out = filter_audit.audit(filter_audit.cells(docs, marks))
        assert got(out) == sql(filter_audit.AUDIT_SQL, documents=docs, labels=marks)
        assert out.count() == 600 * docs.selectExpr("coalesce(lang, '')").distinct().count()
    clash = mixed.withColumn("mask", mixed.doc_id).withColumn("n", mixed.doc_id).withColumn("part", mixed.lang).withColumn("digest", mixed.text)
    assert got(filter_audit.audit(filter_audit.cells(clash, marks))) == got(filter_audit.audit(filter_audit.cells(mixed, marks)))
    assert filter_audit.audit(filter_audit.cells(nothing, marks)).count() == 0
    assert filter_audit.audit(filter_audit.cells(mixed, marks.limit(0))).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_sums(mixed, marks):
    """What an order removes and keeps is all there is; a filter's total is that of its steps."""
    rows = filter_audit.audit(filter_audit.cells(mixed, marks)).collect()
    docs = Counter("" if r["lang"] is None else r["lang"] for r in mixed.collect())
    removed, totals = defaultdict(int), defaultdict(int)
    for r in rows:
        removed[r["part"], r["filter_order"]] += r["removed"]
        totals[r["part"], r["filter_order"][r["step"] - 1]] += r["removed"]
    last = {(r["part"], r["filter_order"]): r["kept"] for r in rows if r["step"] == 5}
    assert all(removed[k] + last[k] == docs[k[0]] for k in last) and len(last) == 120 * len(docs)
    assert all(r["shapley"] == totals[r["part"], r["filter_order"][r["step"] - 1]] for r in rows)


def test_phrases_match_sql(spark, mixed, nothing, monkeypatch):
    expected = sql(phrases.COLLOCATIONS_SQL, documents=mixed)
    assert len(expected) > 50 and got(phrases.collocations(mixed)) == expected
    # many stretches, small batches and other partitions do not change the counts
    monkeypatch.setattr(phrases, "STRETCH", 300)
    monkeypatch.setattr(phrases, "BATCH", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        clash = mixed.withColumn("path", mixed.text).withColumn("a", mixed.doc_id).withColumn("words", mixed.doc_id)
        assert got(phrases.collocations(clash)) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert phrases.collocations(nothing).count() == 0


def brute(rows, longest, least):
    f = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            for i in range(len(words)):
                for m in range(1, min(longest, len(words) - i) + 1):
                    f[lang or "und"][" ".join(words[i : i + m])] += 1
    return sorted((lang, p, a) for lang, c in f.items() for p, a in c.items() if a >= least)


def test_growth_against_brute_force(spark):
    """Words with characters below the joint, prefixes of one another, long pieces, and a word that is half of the text."""
    rng = random.Random(3)
    vocabulary = ["a", "a\x01", "a\x00b", "\x02", "ab", "abc", "É", "日本", "the"] + ["the"] * 6
    rows = [(rng.choice(["en", "x\x01y", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randint(0, 200)))) for _ in range(40)]
    rows += [("en", None), ("en", ""), ("en", ". .,"), ("en", "word " * 5000)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    for longest, least in ((3, 4), (5, 2)):
        found = phrases.frequent(df, longest=longest, least=least).where("words > 0").collect()
        out = []
        for r in found:
            lang, _, path = r["path"].partition(phrases.JOINT)
            out.append((phrases.plain(lang), phrases.plain(path), r["a"]))
        assert sorted(out) == brute(rows, longest, least)


def test_growth_keeps_what_may_go_on():
    found = pa.array(["en\x01a\x01b", "en\x01a\x01c", "en\x01b", "en\x01c"])
    edge = np.array([True, False, False, True])
    assert dict((p, n) for p, _, n in phrases.grow(found, np.array([1, 1, 1, 1]), edge, 2, 3)) == {"en": 4, "en\x01a": 2, "en\x01a\x01b": 1, "en\x01c": 1}


@pytest.fixture(scope="module")
def judged(spark):
    """An insult counts only beside the mention of a group, in short and in long texts."""
    rng = random.Random(5)
    filler = [f"{a}{b}{c}" for a in ("lor", "mip", "sed") for b in ("an", "ul", "et") for c in ("as", "or", "im", "ex")]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(filler) for _ in range(rng.choice([12, 40, 400]))]
        kind = i % 4
        at = rng.randrange(len(words) - 6)
        if kind in (1, 3):
            words.insert(at, rng.choice(["rotten", "filthy"]))
        if kind in (2, 3):
            words.insert(at + 1, rng.choice(["marsians", "venusians"]))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(kind == 3)))
    return spark.createDataFrame(rows, DOCUMENTS).repartition(4), spark.createDataFrame(labels, LABELS)


def test_toxicity_learns_pairs(spark, judged):
    docs, labels = judged
    rows = toxicity.judge(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows) and len(held) > 200
    right = [r["predicted"] == (r["doc_id"] % 4 == 3) for r in held]
    assert sum(right) / len(right) >= 0.9
    # additive weights cannot do that: both words alone are harmless
    assert sum(r["predicted"] for r in held if r["doc_id"] % 4 != 3) <= 0.1 * len(held)
    # held-out labels are never read
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    assert got(toxicity.judge(docs, flipped)) == sorted(repr(tuple(r)) for r in rows)


def test_toxicity_odd_input(spark, judged, awkward, nothing):
    docs, labels = judged
    odd = awkward.union(spark.createDataFrame([(70, "rotten marsians " + "x" * 200_000, "en", "s", 0), (71, "lor " * 60_000, None, None, None)], DOCUMENTS))
    every = docs.union(odd).withColumn("toxic", docs.doc_id).withColumn("terms", docs.text).withColumn("score", docs.doc_id)
    rows = toxicity.judge(every, labels.union(spark.createDataFrame([(None, 1, 1), (8, 1, None)], LABELS))).collect()
    assert len(rows) == 908 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False, False]
    assert len({r["score"] for r in rows if r["doc_id"] == 7 and r["held_out"] is not None}) <= 2
    assert toxicity.judge(nothing, labels).count() == 0
    assert {r["score"] for r in toxicity.judge(docs.limit(5), labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.judge(docs.limit(40), labels.where("toxic = 1")).collect()} == {1.0}


def test_terms_against_plain_python():
    texts = ["The idiot,  the\tCLOWN", "", "a ab abc abcd " * 40, None, "É" * 9]
    from sedgewood.llm._text import buffers

    buf, offsets = buffers(pa.array(texts))
    first, window, term = toxicity.terms(buf, offsets, np.arange(toxicity.BUCKETS))
    assert np.diff(first).tolist() == [1, 1, 4, 1, 1]
    for k, text in enumerate(texts):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        words = raw.split()
        for w in range(max(1, -(-len(words) // 50))):
            own = words[50 * w : 50 * w + 50]
            grams = {(b" " + x + b" ")[i : i + 5] for x in own for i in range(len(x) - 2)}
            assert np.sum(window == first[k] + w) == len(grams) + len(set(own)) or len(grams) + len(set(own)) > 300

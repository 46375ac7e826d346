from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from sedgewood.llm import decontamination, importance, packing, quality_rules, queries, sharding, substring_dedup, suffix_dedup


def sql(view, frame, text):
    c = duckdb.connect()
    c.register(view, frame.toPandas().astype({"doc_id": "Int64"}))
    return sorted(map(repr, c.sql(text).fetchall()))


def test_quality_matches_sql(documents, awkward, nothing):
    for frame in (documents.select("doc_id", "text"), awkward.select("doc_id", "text")):
        got = sorted(repr(tuple(r)) for r in quality_rules.judge(frame).collect())
        assert got == sql("documents", frame, quality_rules.JUDGE_SQL)
    assert quality_rules.judge(nothing).count() == 0
    # columns of like names are not looked at
    own = documents.withColumnRenamed("block_id", "q_t").withColumnRenamed("payload", "q_marks")
    assert sorted(map(repr, quality_rules.judge(own).collect())) == sorted(map(repr, quality_rules.judge(documents.select("doc_id", "text")).collect()))
    assert quality_rules.clean_stage(own).columns == own.columns and quality_rules.clean_stage(own).count() == quality_rules.judge(own).where("kept").count()


def test_boilerplate_decides(spark):
    """A license line says nothing against a text; where most of a text is boilerplate, in any of the languages, it is rejected."""
    text = "The first line says something here. It goes on for a while, and then some more.\nThe second line ends well, too."
    notices = ["Alle Rechte vorbehalten.", "Tous droits réservés. Mentions légales.", "Aviso legal. Haz clic aquí.", "Read our cookie notice and the privacy policy."]
    rows = [(1, text), (2, text + "\n" + notices[0]), (3, "\n".join(notices) + "\nAnd one line of text that is its own.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["lost_chars"], r["removed_chars"] > 0) for r in quality_rules.judge(df).collect()}
    assert got == {1: (True, 0, False), 2: (True, 0, True), 3: (False, 0, True)}
    assert {r["doc_id"]: r["text"] for r in quality_rules.clean_stage(df).collect()} == {1: text, 2: text}


@pytest.mark.parametrize(("run", "text"), [(substring_dedup.dedup_digest, substring_dedup.DIGEST_SQL), (suffix_dedup.dedup_digest, suffix_dedup.DIGEST_SQL), (sharding.assign, sharding.ASSIGN_SQL)])
def test_digests_match_sql(documents, awkward, run, text):
    for frame in (documents.where("doc_id < 400").select("doc_id", "text"), awkward.select("doc_id", "text")):
        assert sorted(repr(tuple(r)) for r in run(frame).collect()) == sql("documents", frame, text)


def test_quality_verdicts(spark):
    clean = "The first line says something here. It goes on for a while.\nThe second line ends well too."
    rows = [
        (1, clean), (2, clean + "\nReleased under the MIT License."), (3, "\n".join(["home | about | contact | more"] * 3) + "\n" + clean),
        (4, "THIS IS ALL SHOUTED!! EVERY WORD OF IT!! TO THE END!!"), (5, "too short."), (6, "again and again we go " * 10), (7, "word*** other%%% thing$$$ more### than&&& that*** is%%% no$$$ text&&& at### all***."),
    ]
    df = spark.createDataFrame([(i, t, len(t), "x") for i, t in rows], "doc_id long, text string, n_chars long, q string")
    assert {r["doc_id"]: r["kept"] for r in quality_rules.judge(df).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}
    out = {r["doc_id"]: r for r in quality_rules.clean_stage(df).collect()}
    assert set(out) == {1, 2} and out[1]["text"] == clean and out[2]["text"] == clean and out[2]["n_chars"] == len(clean)
    # a filter on the result does not change what is computed
    assert quality_rules.judge(df).where("n_repeat_words > 0").count() == 2


def test_boilerplate_is_lines_not_documents(spark):
    recipe = "Cream the butter with the sugar. Roll each cookie flat and set it on the tray. " + "Leave them to cool on a rack near the open window. Then dust all of them with the rest of the sugar."
    program = "The page loads a script in JavaScript once the reader opens it. " + "It then asks the server for the rows that changed, and draws only these again, which is why the list stays quick."
    notice = "We use cookies here. Read our cookie notice, the privacy policy and the terms of use, and subscribe or sign up for more, or click here now to go on."
    word = "A cookiecutter of steel is what the baker took from the shelf today."
    text = "The first line says something here. It goes on for a while, and says more of it.\nThe second line ends well too, after some more words of its own.\nA third one is here as well, so that most of the text is not the notice."
    rows = [(1, recipe), (2, program), (3, text + "\n" + notice), (4, notice), (5, word), (6, "Please subscribe to our weekly letter and sign up with us today.\n\n\n"), (7, text + "\nClick here to subscribe.")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in quality_rules.clean_stage(df).collect()}
    # documents without any other text are rejected, not emptied
    assert out == {1: recipe, 2: program, 3: text, 5: word, 7: text}


def test_repeat_windows_by_hand(spark):
    df = spark.createDataFrame([(1, "a b c d e f a b c d e"), (2, "a a a a a a"), (3, "a b c d")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.judge(df).collect()} == {1: 10, 2: 6, 3: 0}


def test_shards(documents, awkward, nothing):
    rows = sharding.assign(documents).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    again = {r["doc_id"]: r["shard"] for r in sharding.assign(documents.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in rows}
    assert sharding.assign(awkward).count() == 6 and sharding.assign(nothing).count() == 0


def test_shard_weights(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    n = {r["shard"]: r["count"] for r in sharding.assign(df, weights=[1.0, 3.0]).groupBy("shard").count().collect()}
    assert 900 < n[0] < 1100


TOKENIZER = f"{queries.TOKENIZERS}/word_bpe_49k.json"


def test_packing_round_trip(documents, corpus, awkward, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    expected, total = {}, 0
    for i, text in corpus:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            expected[i, k] = (s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    rows = packing.pack(documents, TOKENIZER).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected
    check_sequences(rows, total)
    assert packing.pack(awkward, TOKENIZER).count() == 6 and packing.pack(nothing, TOKENIZER).count() == 0


def check_sequences(rows, total):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-total // 4096) + 1


def test_word_encoder_odd_words():
    from tokenizers import Tokenizer

    import numpy as np

    texts = ["it's we'll DON'T 'tis", "a<|endoftext|>b <|x|>", "3.14 1,000 ½ x²y", "…»«– naïve Straße ÉCOLE", "日本語 한국어 emoji😀😀", "a\x01b \x1cq", "é  nbsp", "İstanbul ſ K"]
    e, t = packing.WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    raw = [x.encode() for x in texts] * 2
    ids, first = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for i, x in enumerate(texts * 2):
        assert ids[first[i] : first[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    import random

    rng = random.Random(seed)
    histogram = {rng.randint(1, 4096): rng.randint(1, 40) for _ in range(200)} | {1365: 7, 1366: 9, 2048: 5, 4096: 3, 2049: 3}
    placed, bins = packing.plan_packing(histogram)
    used, large, done = defaultdict(list), defaultdict(int), defaultdict(int)
    for length, rank, n, b, q, base in placed:
        assert rank == done[length]
        done[length] += n
        for k in range(n):
            used[b + k // q].append((base + k % q * length, length))
            large[b + k // q] += 3 * length > 4096
    assert dict(done) == histogram and len(used) == bins and max(large.values()) <= 2
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert bins <= best_fit_decreasing(histogram) + 1


def best_fit_decreasing(histogram):
    """Bins that plain best fit takes, item by item."""
    from bisect import bisect_left, insort

    gaps, bins = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            i = bisect_left(gaps, length)
            gap = gaps.pop(i) if i < len(gaps) else 4096
            bins += i == len(gaps) and gap == 4096
            if gap > length:
                insort(gaps, gap - length)
    return bins


ITEM = "A train with 12 cars leaves the old city of Marburg at 7 am and travels 300 km to Kassel before the last of its 12 cars is left behind near a small lake."
OTHER = ITEM.replace("12", "40").replace("300", "85").replace("Marburg", "Fulda")
BROKEN = OTHER.replace("40 cars is", "41 cars is")


def test_decontamination(spark, nothing, awkward):
    docs = [(1, "Some text before. " + ITEM + " And after."), (2, "Some text before it " + OTHER), (3, BROKEN), (4, "nothing of the sort"), (5, None), (6, ITEM.replace(" ", "\n")), (7, "well now: short but whole thing here"), (8, ITEM.upper()), (9, ITEM.lower())]
    d = spark.createDataFrame([(i, t, "a") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(10, ITEM), (11, "Short but whole thing here"), (12, None), (13, "too few words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in decontamination.leaks(d, b).collect()}
    assert set(got) >= {(1, 10), (2, 10), (6, 10), (7, 11), (8, 10), (9, 10)} and got[1, 10] == 0 and got[2, 10] > 0
    assert not {k for k in got if k[0] in (4, 5)}
    assert (3, 10) not in got  # one value of the item faces two of the text
    kept = decontamination.decontaminate_stage(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} & {1, 2, 6, 7} == set()
    assert decontamination.leaks(nothing, b).count() == 0 and decontamination.leaks(d, b.limit(0)).count() == 0
    assert decontamination.decontaminate_stage(awkward, b).count() == 6


def matches(text, *items):
    """Slots and changed slots of the items that a text matches; windows are joined by a dictionary, without a filter."""
    import pyarrow as pa

    raw = np.frombuffer(text.encode(), np.uint8)
    index, sizes = defaultdict(list), set()
    for k, item in enumerate(items):
        w = decontamination.item_windows(item)
        sizes |= set(w.size.tolist())
        for i, h in enumerate(w.hash.tolist()):
            index[h].append((k, int(w.place[i]), int(w.size[i]), bool(w.literal[i]), w.offsets[i].tolist(), w.slots[i].view(np.int64).tolist()))
    t = decontamination.text_windows(decontamination.tokens(raw, np.array([0, len(raw)])), sorted(sizes), np.full(8, 255, np.uint8))
    rows = [
        {"rid": 0, "doc_id": 0, "text_hash": 0, "at": int(t.place[i]), "word": int(t.word[i]), "theirs": t.slots[i].view(np.int64).tolist(), "item_id": k, "place": place, "size": size, "literal": lit, "offsets": offsets, "mine": mine}
        for i, h in enumerate(t.hash.tolist()) for k, place, size, lit, offsets, mine in index.get(h, ())
    ]
    if not rows:
        return {}
    return {r["item_id"]: (r["n_slots"], r["n_changed"]) for r in decontamination._judged(pa.Table.from_pylist(rows)).to_pylist()}


def test_literal_windows_are_leaks():
    sums = "12 + 30 = 42 , 5 kg + 7 kg = 12 kg , 3 + 4 = 7 , 8 kg - 2 kg = 6 kg , 9 - 1 = 8"
    names = "the list of Anna Berg , Carl Dorn , Emil Fuchs , Greta Hahn , Ida Jung , Karl Lang , Maria Nolte"
    short = "what is 12 times 30 5 7"
    for item in (sums, names, short):
        for text in (item, item.lower(), "before it " + item + " and after"):
            assert matches(text, item), (item, text)
    # a slot that disagrees far away does not veto what agrees word for word
    long = "We saw 12 birds today. " + "then they flew over the wide green hills and down to the old mill by a river near our house " * 2 + "where all 12 of them slept."
    assert matches(long.replace("12 of", "13 of"), long)
    assert not matches(sums.replace("3 + 4 = 7", "4 + 4 = 8").replace("12 +", "13 +"), sums)
    # nor does a run of its own
    far = OTHER.replace("near a small lake", "by it") + " then something else happens for a while until it all ends here with some other words"
    item = ITEM.replace("near a small lake", "at the") + " moment then something else happens for a while until it all ends with 12 other words in 40 lines"
    assert matches(far, item)


def test_names_that_begin_sentences():
    tom = "Tom has 5 apples in a basket. Tom gives 2 of these to Ben. Tom then eats 1 of those left over. How many apples are in the basket now?"
    anna = tom.replace("Tom", "Anna").replace("Ben", "Lea").replace("5", "3").replace("2", "6")
    for text in (anna, "Some words before it. " + anna + " And after.", "A question: " + anna):
        assert matches(text, tom)[0][1] >= 4, text
    assert not matches(anna.replace("Anna then", "Carl then").replace("Anna gives", "Emil gives").replace("1 of", "4 of"), tom)  # one name faces three
    # known from within a sentence, so that the other leading words stay words
    short = "Tom has 5 red apples and 3 of Tom's are bad. Tom eats them all. Every day Tom buys 2. Who sells them to him so cheap?"
    assert matches(short.replace("Tom", "Anna").replace("5", "9"), short)
    # the leading words of sentences that share nothing else are no leak
    assert not matches("The cat sat there. A dog ran off. It was late now. So we went home. Then we slept well.", tom)


def test_every_item_has_a_way():
    sums = "12 + 30 + 5 + 7 + 9 + 11 + 4 + 8 + 2 + 6 + 3"
    for item in ("Who wrote Hamlet?", sums, "Berlin", "Anna Berg"):
        assert matches(item, item) and matches(item.upper(), item) and matches(item.title(), item), item
    assert matches("We ask: who wrote Hamlet? And when?", "Who wrote Hamlet?")
    # one or two words are an item only as a whole text
    assert not matches("We met Anna Berg in Berlin today.", "Berlin", "Anna Berg")
    # runs of names are one slot, number words are numbers
    text = "A baker called John Smith sells 12 loaves to the old mill, and John Smith then bakes 12 more for the next day at home."
    assert matches(text.replace("John Smith", "Mary").replace("12", "seven"), text)
    assert matches(text.replace("John Smith", "Anna Maria Berg").replace("12", "40"), text)
    assert matches(text.replace("12", "twelve").title(), text)
    assert not matches(text.replace("12 more", "30 more").replace("12 loaves", "seven loaves").replace("John Smith sells", "Mary sells"), text)


def parameterised(rng, text):
    """Two versions of a text with the same slots and other values, a slot every few words."""
    names = ["Anna", "Ben", "Carla Berg", "David", "Emma", "Fritz Lang Jones"]
    pairs = {f"S{k}": (rng.choice(names) if k % 2 else str(rng.randint(2, 900)), rng.choice(names) if k % 2 else rng.choice([str(rng.randint(2, 900)), "seven", "twelve"])) for k in range(4)}
    while len({b for _, b in pairs.values()}) < 4 or len({a for a, _ in pairs.values()}) < 4:
        return parameterised(rng, text)
    words = [w.lower().strip(".,") for w in text.split()]
    for at in range(4, len(words), 6):
        words[at] = f"S{(at - 4) // 6 % 4}"
    return tuple(" ".join(pairs[w][v] if w in pairs else w for w in words) for v in (0, 1))


def test_recall_on_changed_copies(spark):
    """Copies verbatim, in another case, and with other parameters, of all items, within documents of other words."""
    import random

    rng = random.Random(3)
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").collect()]
    pairs = [parameterised(rng, t) for t in items]
    kinds = {"verbatim": lambda a, b: a, "upper": lambda a, b: a.upper(), "title": lambda a, b: a.title(), "changed": lambda a, b: b}
    docs, wanted = [], {}
    for n, (kind, f) in enumerate(kinds.items()):
        for i, (a, b) in enumerate(pairs):
            docs.append((1000 * n + i, f"Some words stand before it here. {f(a, b)} And a few more come after."))
            wanted[1000 * n + i] = (kind, i)
    docs += [(9000 + i, f"A document of its own with {i} words that no item has at all, and then it goes on and on to {i + 3} more of these") for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    b = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(d, b).collect()}
    for kind in kinds:
        own = [(doc, i) for doc, (k, i) in wanted.items() if k == kind]
        assert sum(x in got for x in own) >= 0.9 * len(own), kind
    assert not {x for x in got if x[0] >= 9000}
    assert all(i == wanted[doc][1] for doc, i in got)


#: Items with slots by kind, the values of the item, and those of a text that asks the same.
KINDS = {
    "sums": (["What is {0} + {1} * {2} - {3}?", "Compute {0}+{1}*{2}-{3} please.", "Find ({0} / {1}) + {2} - {3} = ?", "{0} * {1} + {2} - {3} = ?"], [3, 4, 12, 7], [81, 5, 60, 19]),
    "algebra": (["Solve {0}x + {1} = {2} for x.", "Find y when {0}y - {1} = {2} holds.", "If {0}a + {1}b = {2} then what is a + b?", "Factor the expression x^2 + {0}x + {1} over the reals."], [12, 7, 31], [5, 8, 93]),
    "units": (["A car drives {0}km in {1}h, how fast is that?", "She was the {0}th of {1} runners to reach the end.", "How much do {0}kg of rice cost at {1} a bag?"], [60, 2], [95, 4]),
    "names": (["How many letters are in the name of {0} if you leave out the vowels?", "Where was the painter {0} born and when did he move to Paris?", "Which river runs through the old town of {0} today?"], ["Anna", "Ben"], ["Emma", "Carl Berg"]),
    "short": (["What is the capital city of {0}?", "How many days do {0} weeks have?", "Which sea lies north of {0} and Denmark?", "How old was the king in {0}?"], [30], [44]),
    "lower case": (["a farmer sells {0} eggs on monday and {1} on tuesday, how many in all?", "what is {0} percent of {1} in whole numbers?", "how long do {0} painters need for {1} walls of this house?"], [12, 30], [7, 81]),
}


def test_kinds_of_items():
    """Every kind alone: items asked with other values are found, within other words and by themselves; texts that only look alike are not."""
    for kind, (forms, mine, theirs) in KINDS.items():
        pairs = [(f.format(*mine), f.format(*theirs)) for f in forms]
        texts = [(k, t) for k, (_, other) in enumerate(pairs) for t in (other, f"Some words stand here. {other} And others follow.", f"Some words stand here. {pairs[k][0]} And so on.")]
        found = [(k, set(matches(t, *(a for a, _ in pairs)))) for k, t in texts]
        hits, right = sum(len(f) for _, f in found), sum(k in f for k, f in found)
        assert right >= 0.9 * len(texts) and right >= 0.9 * hits, (kind, right, hits, [t for (k, t), (_, f) in zip(texts, found, strict=True) if k not in f])


def test_clean_texts_are_no_leaks_of_short_items():
    items = ["Who wrote Hamlet?", "Has 5 cats.", "What is 3 + 4 * 12 - 7?", "Solve 12x + 7 = 31 for x.", "When was Goethe born?", "Where is Berlin?", "How many days are in 3 weeks?", "5 kg of rice"]
    clean = ["Who wrote Ulysses? Joyce did.", "He has 3 cats and 4 dogs.", "Where is Anna? She is at home.", "When was Peter born? In May.", "We saw that 3 - 4 of 12 + 7 were gone.", "She bought 3 kg of rice and 4 of beans.", "Solve it for x and 31 will be 7.", "How many are in 3 rooms?", "What is 3 * 4 + 12 - 7?", "Items: 3 + 4 = 7 and 12 - 5 = 7.", "From 2019-2020 it was 12/05/2019."]
    for text in clean:
        assert not matches(text, *items), text
    for item in items:
        assert matches(f"They ask: {item} And then?", item) and matches(item, item)


def test_numbers_are_split_within_words():
    def cut(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        t = decontamination.tokens(raw, np.array([0, len(raw)]))
        return t.kind.tolist(), (t.operator != 0).astype(int).tolist(), t.word.tolist()

    assert cut("12x + 7=31") == ([1, 0, 1, 1], [0, 0, 1, 1], [0, 0, 2, 2])
    assert cut("mp3 h2o b-5 and/or 3-4 5kg") == ([0, 0, 0, 0, 1, 1, 1, 2], [0, 0, 0, 0, 0, 1, 0, 0], [0, 1, 2, 3, 4, 4, 5, 5])
    assert cut("+5 a\n- 6 cats -") == ([1, 0, 1, 0], [0, 0, 1, 0], [0, 1, 3, 4])
    assert cut("") == ([], [], [])


def test_join_matches_all_pairs(spark, monkeypatch):
    """Windows that meet in the filtered hash join are those whose tokens are equal, pair by pair."""
    items = [(i, f"item {i} has words that are only its own like {'abcdefghij'[i % 10] * 5} and {'klmnopqrst'[i % 10] * 4} in Number Ten of 12 km or more") for i in range(10)]
    docs = [(i, f"Before it: {t} and after. {items[(i + 1) % 10][1]}") for i, t in items] + [(50 + i, t.replace(f"item {i}", f"item {i + 7}")) for i, t in items]

    def sequences(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        for form in decontamination.forms(decontamination.tokens(raw, np.array([0, len(raw)]))):
            yield form.literal, form.template.tolist(), form.slot.tolist()

    expected = set()
    for d, text in docs:
        for i, item in items:
            for lit, seq, _ in sequences(text):
                for own, mine, slot in sequences(item):
                    size = min(13, len(mine))
                    for k in range(len(mine) - size + 1):
                        if own == lit and (lit or sum(not x for x in slot[k : k + size]) >= 7) and any(seq[a : a + size] == mine[k : k + size] for a in range(len(seq) - size + 1)):
                            expected.add((d, i))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    own = decontamination.benchmark_windows(b, "item_id", "text")
    for bits in (1 << 8, 1 << 20):  # a full filter lets more through, and changes nothing
        monkeypatch.setattr(decontamination, "LEAST_BITS", max(bits, 1 << 16))
        monkeypatch.setattr(decontamination, "MOST_BITS", max(bits, 1 << 16))
        sizes, flags = decontamination.collect_filter(own)
        slim = d.selectExpr("doc_id", "xxhash64(text) as text_hash", "text")
        met = decontamination.document_windows(slim, sizes, flags).join(own, "h").select("doc_id", "item_id").distinct()
        assert {tuple(r) for r in met.collect()} == expected
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(d, b).collect()}
    assert got <= expected and got >= {(i, i) for i, _ in items} | {(i, (i + 1) % 10) for i, _ in items}


def test_decontamination_of_odd_rows(spark):
    long = "words of a long text that goes on " * 30_000
    docs = [(1, long + ITEM), (2, ITEM), (2, ITEM), (None, ITEM), (3, ""), (4, None)]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, h string, text_hash int")
    b = spark.createDataFrame([(7, ITEM), (None, "an item without any id of its own, but with a text of some words"), (8, None)], "item_id long, text string")
    got = sorted(repr((r["doc_id"], r["item_id"])) for r in decontamination.leaks(d, b).collect())
    assert got == sorted(repr(x) for x in [(1, 7), (2, 7), (2, 7), (None, 7)])
    assert [(r["doc_id"], r["text"]) for r in decontamination.decontaminate_stage(d, b).orderBy("doc_id").collect()] == [(3, ""), (4, None)]


def test_importance(spark, corpus, nothing, awkward):
    junk = [(1000 + i, " ".join(f"zz{i * j % 17}###" for j in range(60))) for i in range(30)]
    docs = spark.createDataFrame([*corpus, *junk], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10, 60)] + [(1000 + i, 0, 0) for i in range(25)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in importance.select(docs, labels).collect()}
    assert all(rows[i]["kept"] for i in range(10, 60)) and not any(rows[1000 + i]["kept"] for i in range(30))
    assert rows[2]["log_weight"] == 0 and rows[1]["n_grams"] == 0
    assert importance.select(nothing, labels).count() == 0
    assert all(r["kept"] for r in importance.select(docs, labels.limit(0)).collect())
    assert importance.select(awkward, labels).count() == 6


def test_importance_matches_brute_force(spark, corpus, monkeypatch):
    """n-grams by a regular expression, counts and weights by dictionaries, and the k largest keys by sorting."""
    import math
    import re
    from collections import Counter

    texts = {i: t or "" for i, t in corpus if i != 400} | {900: "naïve, text -- with (odd) runs_1!  Ünder\tline\n\n#5"}
    grams = {}
    for i, t in texts.items():
        runs = re.findall(r"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff \t-\r]+", t.encode().decode("latin-1"))
        raw = np.frombuffer(t.encode(), np.uint8)
        bucket, row = importance.ngrams(raw, np.array([0, len(raw)]))
        assert len(bucket) == len(runs) + max(0, len(runs) - 1) and not row.any()
        pairs = [(r,) for r in runs] + list(zip(runs, runs[1:]))
        names = dict(zip(pairs, bucket.tolist()))
        assert [names[p] for p in pairs] == bucket.tolist()  # one bucket for each n-gram
        grams[i] = Counter(bucket.tolist())
    labelled = {i: int(i % 3 > 0) for i in list(texts)[:50]}
    good = [i for i in labelled if labelled[i]]
    raw, target = sum(grams.values(), Counter()), sum((grams[i] for i in good), Counter())

    def p(counts, b):
        return (counts[b] + importance.SMOOTHING) / (sum(counts.values()) + importance.SMOOTHING * importance.BUCKETS)

    weight = {i: sum(n * math.log(p(target, b) / p(raw, b)) for b, n in g.items()) / math.sqrt(max(1, sum(g.values()))) for i, g in grams.items()}
    docs = spark.createDataFrame([(i, t or None) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(labelled.items()), "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in importance.select(docs, labels).collect()}
    assert {i: r["n_grams"] for i, r in rows.items()} == {i: sum(g.values()) for i, g in grams.items()}
    assert all(abs(rows[i]["log_weight"] - w) < 1e-9 for i, w in weight.items())
    k = round(len(good) / len(labelled) * len(texts))
    best = sorted((r["gumbel_key"] for r in rows.values()), reverse=True)[:k]
    assert {i for i, r in rows.items() if r["kept"]} == {i for i, r in rows.items() if r["gumbel_key"] >= best[-1]}
    # the noise is Gumbel's: its mean is Euler's constant, over many ids
    many = spark.range(20_000).selectExpr("id as doc_id", "'' as text")
    noise = [r["gumbel_key"] for r in importance.select(many, labels.limit(0)).collect()]
    assert abs(np.mean(noise) - 0.5772) < 0.05 and abs(np.var(noise) - np.pi**2 / 6) < 0.1


def test_kth_largest(spark):
    values = [0.5, 0.5, 1.0, -3.0, 7.25, 7.25, 7.25, 1e-9, 2e-9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, len(values) + 1):
        assert importance.kth_largest(df, "x", k, bins=2) == sorted(values, reverse=True)[k - 1]


def test_importance_on_held_out_labels(spark):
    """Fitted on every second labelled document, judged on the others."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r["doc_id"]: r["kept"] for r in importance.select(docs, labels.where("doc_id % 2 = 0")).collect()}
    rest = labels.where("doc_id % 2 = 1").collect()
    good = [kept[r["doc_id"]] for r in rest if r["quality"] and not r["toxic"]]
    bad = [kept[r["doc_id"]] for r in rest if not r["quality"]]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sedgewood.operators import chunking, evaluation, graph_analytics as A, graph_build as B, graph_retrieval as G, jobs, retrieval, tables


@pytest.mark.parametrize(
    ("chunk", "expected"),
    [
        ("Text with [TABLE_0_2].", ["Text with [TABLE_0_0].", "Text with [TABLE_0_1].", "Text with [TABLE_0_2]."]),
        ("A [TABLE_1_1] and B [TABLE_2_0].", ["A [TABLE_1_0] and B [TABLE_2_0].", "A [TABLE_1_1] and B [TABLE_2_0]."]),
        ("No tables here.", ["No tables here."]),
        ("[TABLE_1_10] twice [TABLE_1_10]", [f"[TABLE_1_{i}] twice [TABLE_1_{i}]" for i in range(11)]),
        ("[TABLE_a1_1] [TABLE_a1_0]", ["[TABLE_a1_0] [TABLE_a1_0]", "[TABLE_a1_1] [TABLE_a1_0]"]),
    ],
)
def test_expansions(spark, chunk, expected):
    assert spark.createDataFrame([(chunk,)], "c string").select(chunking.expansions(F.col("c")).alias("x")).first()["x"] == expected


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_recursive_chunks_keep_size_and_order(text, size, overlap):
    chunks = chunking.split_recursive(text, size, overlap)
    assert all(c and c == c.strip() and len(c) <= size for c in chunks)
    at = 0
    for c in chunks:  # each chunk stands in the text, not before the one before it
        at = text.index(c, max(0, at - overlap - size))
    assert sorted(set("".join(chunks).replace(" ", "").replace("\n", ""))) == sorted(set(text.replace(" ", "").replace("\n", "")))


def test_recursive_splitter_by_hand():
    assert chunking.split_recursive("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert chunking.split_recursive("one\n\ntwo three\n\nfour", 12, 0) == ["one", "two three", "four"]
    assert chunking.split_recursive("abcdefgh", 3, 0) == ["abc", "def", "gh"]
    assert chunking.placeholder_length(500)("x [TABLE_1_2]") == 513
    assert chunking.restored_length({"TABLE_1_0": "ab", "TABLE_1_1": "c"})("x[TABLE_1_1]") == 1 + len("\n\nab\n\nc\n\n")


def next_fit_by_hand(sizes, budget):
    out, part, used = [], 0, 0
    for s in sizes:
        if used and used + s > budget:
            part, used = part + 1, 0
        used += s
        out.append(part)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_next_fit(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 30, 99, 100, 101, 250]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long").repartition(5)
    got = [r["part"] for r in jobs.next_fit(df, ["id"], "size", 100).orderBy("id").collect()]
    assert got == next_fit_by_hand(sizes, 100)


def test_next_fit_of_nothing(spark):
    assert jobs.next_fit(spark.createDataFrame([], "id long, size long"), ["id"], "size", 10).count() == 0


def test_tables(spark):
    rows = [[["h", None, "x"], ["a\nb", " ", "1"], ["c", None, None]]]
    df = spark.createDataFrame([(rows[0], ["g", "g", None])], "r array<array<string>>, c array<string>")
    out = df.select(tables.markdown(F.col("r")).alias("m"), tables.markdown(tables.drop_blank_columns(F.col("r")), tables.header_rows(F.col("c"))).alias("d"), tables.markdown(F.expr("cast(array() as array<array<string>>)")).alias("e")).first()
    assert out["m"] == "| h |  | x |\n| --- | --- | --- |\n| a b |   | 1 |\n| c |  |  |\n"
    assert out["d"] == "| h | x |\n| a b | 1 |\n| --- | --- |\n| c |  |\n" and out["e"] == ""


def test_blank_columns_of_long_tables(spark):
    """The kept columns are found once a table, not once a row: twenty thousand rows took minutes."""
    n = 20_000
    rows = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array(i.cast("string"), F.lit(" "), F.when(i == n, F.lit("x"))))
    df = spark.range(1).select(rows.alias("r"))
    began = time.monotonic()
    out = df.select(tables.drop_blank_columns(F.col("r")).alias("t")).first()["t"]
    assert time.monotonic() - began < 20
    assert len(out) == n and out[0] == ["1", None] and out[-1] == [str(n), "x"]


def test_table_without_body_is_one_part(spark):
    df = spark.createDataFrame([(1, [["h"]], []), (2, [["h"]], [["word " * 50], ["b"], ["c"]])], "k int, header array<array<string>>, rows array<array<string>>")
    got = sorted(map(tuple, tables.split_parts(df, ["k"], budget=30).collect()))
    assert got == [(1, 0, 0, 0), (2, 0, 0, 1), (2, 1, 1, 2)]


def test_dense_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, vector array<double>").repartition(4)
    q = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    expected = {}
    for i in range(0, 200, 50):
        s = np.round((x @ x[i]) / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i]), 9)
        expected[i] = sorted(range(200), key=lambda j: (-s[j], j))[:4]
    for block in (4096, 1):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        got = {}
        for r in retrieval.dense_topk(df, q, 4).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == expected


def test_bm25_fills_up_with_zeros(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "d"), (4, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "d d zz"), (2, "nothing")], "query_id long, text string")
    got = {}
    for r in retrieval.bm25_topk(docs, asked, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"] > 0))
    assert got == {1: [(3, True), (1, False), (2, False)], 2: [(1, False), (2, False), (3, False)]}


def test_fusion_counts_a_repeated_content_twice(spark):
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y")], "query_id long, rank long, content string")
    got = {r["content"]: r["score"] for r in retrieval.fuse([(hits, 1.0)], "content").collect()}
    assert got == {"x": round(1 / 61 + 1 / 62, 9), "y": round(1 / 63, 9)}


def test_hit_and_rank(spark):
    q = spark.createDataFrame([(1, "  needle \n"), (2, "   "), (3, "absent")], "query_id long, truth string")
    h = spark.createDataFrame([(1, 1, "hay"), (1, 2, "a needle here"), (2, 1, "x"), (3, 1, "x")], "query_id long, rank long, content string")
    assert {r["query_id"]: (r["hit"], r["reciprocal_rank"]) for r in evaluation.hit_and_rank(q, h).collect()} == {1: (1.0, 0.5), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_parse_responses(spark):
    body = '{"custom_id":"%s","response":{"status_code":%d,"body":{"choices":[{"message":{"content":%s,"tool_calls":%s}}]}}}'
    payload = '"{\\"entities\\":[{\\"name\\":\\"A\\",\\"type\\":null,\\"description\\":\\"d\\"}],\\"relationships\\":[]}"'
    call = '[{"function":{"name":"GraphExtraction","arguments":%s}},{"function":{"name":"Other","arguments":"{}"}}]' % payload
    fenced = payload.replace('"{', '"```json\\n{', 1)[:-1] + '\\n```"'
    lines = [body % ("tool", 200, "null", call), body % ("fence", 200, fenced, "null"), body % ("bad", 500, fenced, "null"), "", "{broken", body % ("text", 200, '"no json"', "null")]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = B.entity_rows(B.parse_responses(df)).collect()
    assert sorted((r["custom_id"], r["name"], r["type"], r["description"]) for r in got) == [("fence", "A", None, "d"), ("tool", "A", None, "d")]
    assert [r["value"] for r in B.corrupt_lines(df).collect()] == ["{broken"]


def test_unknown_endpoints_are_not_upgraded(spark):
    e = spark.createDataFrame([(1, "A", "T", "first"), (2, "A", "U", "second"), (5, "B", "T", "late"), (6, " ", "T", "x"), (7, None, "T", "x"), (8, "C", "", None)], "seq long, name string, type string, description string")
    r = spark.createDataFrame([(3, "A", "B"), (4, "B", "D")], "seq long, source string, target string")
    got = {x["name"]: (x["type"], x["description"]) for x in B.upsert_nodes(e, r).collect()}
    assert got == {"A": ("T", "first"), "B": ("UNKNOWN", ""), "C": ("UNKNOWN", ""), "D": ("UNKNOWN", "")}
    assert {x["name"]: x["type"] for x in B.upsert_nodes(e, wins="last").collect()} == {"A": "U", "B": "T", "C": "UNKNOWN"}


def test_gleaning_stops_when_nothing_is_new(spark):
    a, b = spark.createDataFrame([("x",)], "n string"), spark.createDataFrame([("x",), ("y",), ("y",)], "n string")
    assert sorted(r["n"] for r in B.glean(a, [b, a, spark.createDataFrame([("z",)], "n string")], ["n"]).collect()) == ["x", "y"]


def clique(names):
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def test_communities_find_cliques(spark):
    links = clique("abcde") + clique("vwxyz") + [("e", "v")]
    e = spark.createDataFrame(links, "src string, dst string")
    got = {r["id"]: r["community"] for r in A.communities(e).collect()}
    assert len({got[c] for c in "abcde"}) == 1 and len({got[c] for c in "vwxyz"}) == 1 and got["a"] != got["z"]
    assert A.modularity(e, A.communities(e)).first()["modularity"] > 0.4


def test_hierarchy_limits_sizes(spark):
    links = [x for k in range(6) for x in clique([f"{k}{c}" for c in "abcdefgh"])] + [(f"{k}a", f"{k + 1}a") for k in range(5)]
    rows = A.hierarchy(spark.createDataFrame(links, "src string, dst string"), [0.1, 0.2, 0.3, 0.4], [10, 20, 100, None]).collect()
    finest = max(r["level"] for r in rows)
    sizes = {}
    for r in rows:
        if r["level"] == finest:
            sizes[r["community"]] = sizes.get(r["community"], 0) + 1
    assert finest == 3 and max(sizes.values()) <= 10 and sum(sizes.values()) == 48
    again = A.hierarchy(spark.createDataFrame(links, "src string, dst string"), [0.1, 0.2, 0.3, 0.4], [10, 20, 100, None]).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_components_of_paths(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z2"), ("q", "q")]
    ids = spark.createDataFrame([(x,) for x in sorted({x for e in links for x in e} | {"alone"})], "id string")
    got = {r["id"]: r["component"] for r in A.components(ids, spark.createDataFrame(links, "src string, dst string")).collect()}
    assert got["n060"] == "n000" and got["z2"] == "z1" and got["q"] == "q" and got["alone"] == "alone"


def test_degree_of_a_loop(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {r["id"]: r["degree"] for r in A.degrees(ids, spark.createDataFrame([("a", "a")], "src string, dst string")).collect()} == {"a": 2, "b": 0}


def test_context_has_a_sentinel(spark):
    assert spark.createDataFrame([("",), (None,), ("x",)], "c string").select(G.or_else(F.col("c"), "none").alias("o")).collect() == [("none",), ("none",), ("x",)]


def test_generation_goes_on_until_the_target(spark):
    from sedgewood.functions.models import generate_until

    made = []

    def generate(n, done):
        made.append((n, done))
        return spark.createDataFrame([(f"q{done + i}",) for i in range(n)], "question string")

    out = generate_until(generate, spark.createDataFrame([("q0",)], "question string"), 10, 4, "question")
    assert out.count() == 10 and out.distinct().count() == 10 and made[0] == (4, 1)
    stuck = generate_until(lambda n, done: spark.createDataFrame([("q0",)], "question string"), out.limit(0), 5, 2, "question")
    assert stuck.count() == 1


def test_next_fit_summaries_compose():
    import random

    from sedgewood.operators import jobs

    rng = random.Random(1)
    for _ in range(200):
        budget = rng.randint(3, 30)
        blocks = [np.array([rng.randint(0, 12) if rng.random() < 0.9 else rng.randint(20, 50) for _ in range(rng.randint(1, 9))], np.int64) for _ in range(3)]
        parts = [jobs.summary_of(b, budget) for b in blocks]
        whole = jobs.composed(jobs.composed(parts[0], parts[1], budget), parts[2], budget)
        for start in ((-1, 0), (4, rng.randint(1, budget))):
            state = start
            for p in parts:
                state = jobs.advanced(*state, p, budget)
            assert jobs.advanced(*start, whole, budget) == state
            part, used = start
            for s in np.concatenate(blocks).tolist():
                if part < 0 or used + s > budget:
                    part, used = part + 1, 0
                used += s
            assert (part, used) == state


def test_next_fit_over_many_blocks(spark, monkeypatch):
    import random

    from sedgewood.operators import jobs

    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 5, 9, 40])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, size long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(jobs, "CHAINED", 2)
    try:
        got = {r["id"]: r["part"] for r in jobs.next_fit(df, ["id"], "size", 30).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    part, used = -1, 0
    for i, s in rows:
        if part < 0 or used + s > 30:
            part, used = part + 1, 0
        used += s
        assert got[i] == part


def test_running_parts_of_one_large_group(spark):
    from sedgewood.operators import jobs

    rows = [("a" if i % 10 else None, i, i % 7) for i in range(2000)]
    got = {(r["g"], r["id"]): r["part"] for r in jobs.running_parts(spark.createDataFrame(rows, "g string, id long, size long"), ["id"], "size", 50, ["g"]).collect()}
    so_far = {}
    for g, i, s in rows:
        assert got[g, i] == so_far.get(g, 0) // 50
        so_far[g] = so_far.get(g, 0) + s


def test_names_that_contain_names(spark):
    import itertools

    from sedgewood.operators import graph_retrieval as G

    names = ["", "a", "ab", "abc", "abcd", "xabcy", "bcd", "ABCD", "zz", "müller", "ü"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {tuple(r) for r in G.containing(df, df.withColumnRenamed("n", "t")).select("n", "t").collect()}
    assert got == {(n, t) for n, t in itertools.product(names, names) if t and t in n}
    nodes = spark.createDataFrame([(n or "", i) for i, n in enumerate(names[1:] + [""])], "id string, ordinal int")
    targets = spark.createDataFrame([(i, t) for i, t in enumerate(["bc", "abcde", "", "q", "zz"])], "query_id long, target string")
    found = {r["target"]: r["id"] for r in G.first_match(targets, nodes).collect()}
    assert found == {"bc": "abc", "abcde": "a", "": "", "q": "", "zz": "zz"}
    plan = G.entry_points(targets, nodes)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_underscores_in_placeholders(spark):
    from sedgewood.operators import chunking

    df = spark.createDataFrame([("see [TABLE_doc_3_1] and [TABLE_a_0] not [table_1_2]",)], "t string")
    assert df.select(chunking.expansions(F.col("t")).alias("x")).first()["x"] == [f"see [TABLE_doc_3_{i}] and [TABLE_a_0] not [table_1_2]" for i in range(2)]


def test_rebuild_fetches_what_is_not_cached(spark):
    from sedgewood.operators import jobs

    cached = spark.createDataFrame([("a", "1"), ("a", "2"), ("c", "3")], "file string, line string")
    log = spark.createDataFrame([("a", "processed"), ("b", "processed"), ("b", "processed"), ("d", "failed")], "file string, status string")
    out = jobs.rebuild(cached, log, lambda missing: missing.select("file", F.lit("fetched").alias("line")))
    assert sorted(map(tuple, out.collect())) == [("a", "1"), ("a", "2"), ("b", "fetched"), ("c", "3")]


def test_tokens_of_a_vocabulary(spark):
    import pytest

    from sedgewood.functions import text

    path = text.vocabulary()
    if path is None:
        pytest.skip("no public vocabulary here")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    texts = ["", "It's one of 12 words.", "naïve Straße\n\nand more", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["n"] for r in df.select("id", text.encoded_tokens(F.col("text"), path).alias("n")).collect()}
    assert got == {i: None if x is None else len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert df.where("id = 1").select(text.encoded_tokens(F.col("text"), None).alias("n")).first()["n"] == 8


def test_modes_and_judges_keep_failures_to_their_rows(spark):
    df = spark.createDataFrame([(1, "one"), (2, "boom"), (3, None)], "id int, question string")

    def fails(q):
        if q == "boom":
            raise RuntimeError("no")
        return q.upper()

    got = {(r["mode"], r["id"]): (r["answer"], r["error"], r["latency"] >= 0) for r in evaluation.run_modes(df, {"a": fails, "b": str}).collect()}
    assert got["a", 1] == ("ONE", None, True) and got["a", 2] == (None, "RuntimeError: no", True) and got["a", 3][1].startswith("AttributeError")
    assert got["b", 2] == ("boom", None, True) and len(got) == 6
    scores = {r["id"]: r["s"] for r in evaluation.judged(df, {"s": (lambda q: 1 / (len(q) - 4), ["question"])}).collect()}
    assert scores == {1: -1.0, 2: None, 3: None}

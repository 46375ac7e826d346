from __future__ import annotations

import json

from pyspark.sql import functions as F

from sedgewood.sources import readers, writers
from sedgewood.streaming import events


def test_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\fTwo\f \fthree")
    (tmp_path / "b.pdf").write_bytes(b"BROKEN")
    (tmp_path / "c.txt").write_bytes(b"not a pdf")

    def parse(content):
        if content == b"BROKEN":
            raise ValueError("unreadable")
        return content.decode().split("\f")

    pages = readers.read_paged(spark, str(tmp_path), parse)
    assert sorted((r["filename"], r["page"], r["page_content"]) for r in pages.collect()) == [("a.pdf", 1, "one"), ("a.pdf", 2, "Two"), ("a.pdf", 4, "three")]
    merged = readers.merge_pages(pages, "filename", "page", "page_content", 1, 4).first()
    assert merged["page_content"] == "one\n\nTwo" and merged["n_pages"] == 2


def test_artifacts_need_both_files(spark, tmp_path):
    for name, files in {"doc_a": ["t.txt", "t.json"], "doc_b": ["t.txt"], "other": ["t.txt", "t.json"]}.items():
        (tmp_path / name).mkdir()
        for f in files:
            (tmp_path / name / f).write_text('{"TABLE_0_0": {"markdown": "m"}}' if f.endswith("json") else "text")
    got = readers.read_artifacts(spark, str(tmp_path), "t.txt", "t.json", "map<string, struct<markdown: string>>", "doc_").collect()
    assert [(r["folder"], r["text"], r["tables"]["TABLE_0_0"]["markdown"]) for r in got] == [("doc_a", "text", "m")]


def test_json_forms(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps(["x", "y"]))
    (tmp_path / "map.json").write_text(json.dumps({"7": "s", "8": "t"}))
    (tmp_path / "rows.json").write_text(json.dumps([{"q": "a"}, {"q": "b"}, {"q": "c"}]))
    (tmp_path / "lines.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    assert [tuple(r) for r in readers.read_json_list(spark, f"{tmp_path}/list.json").collect()] == [(0, "x"), (1, "y")]
    assert {r["key"]: r["value"] for r in readers.read_json_map(spark, f"{tmp_path}/map.json").collect()} == {"7": "s", "8": "t"}
    assert [r["q"] for r in readers.read_records(spark, f"{tmp_path}/rows.json", "q string", 2).orderBy("ordinal").collect()] == ["a", "b"]
    good, bad = readers.read_jsonl(spark, f"{tmp_path}/lines.jsonl", "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 1


def test_csv_with_mark_and_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes('﻿question,answer\n"a\nb","say ""hi"""\n'.encode())
    df = readers.read_csv(spark, f"{tmp_path}/q.csv")
    assert df.columns == ["question", "answer"] and tuple(df.first()) == ("a\nb", 'say "hi"')
    assert readers.first_existing(df, "user_input", "question") == "question"


def test_gexf(spark, tmp_path):
    (tmp_path / "g.gexf").write_text(
        '<gexf><graph><nodes><node id="a" label="A"><attvalues><attvalue for="0" value="x"/></attvalues></node><node id="b" label="B"/></nodes>'
        '<edges><edge id="0" source="a" target="b"/></edges></graph></gexf>'
    )
    nodes, edges = readers.read_gexf(spark, f"{tmp_path}/g.gexf")
    assert {r["id"]: r["attributes"] for r in nodes.collect()} == {"a": {"0": "x"}, "b": {}}
    assert [(r["source"], r["target"]) for r in edges.collect()] == [("a", "b")]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, version int")
    writers.build_once(old, f"{tmp_path}/index")
    writers.build_once(old.limit(0), f"{tmp_path}/index")
    assert spark.read.parquet(f"{tmp_path}/index").count() == 2
    writers.upsert_table(spark.createDataFrame([(2, "c", 2), (3, "d", 1)], old.schema), f"{tmp_path}/index", f"{tmp_path}/next", "id", "version")
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/next").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    writers.append(old, f"{tmp_path}/index")
    assert spark.read.parquet(f"{tmp_path}/index").count() == 4
    writers.replace(old, f"{tmp_path}/index")
    assert spark.read.parquet(f"{tmp_path}/index").count() == 2
    writers.write_jsonl_parts(old.withColumn("line", F.to_json(F.struct("id"))), f"{tmp_path}/parts", "version", "line")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/parts/version=1").collect()) == ['{"id":1}', '{"id":2}']
    for kind, suffix in (("csv", "csv"), ("json", "json"), ("markdown", "txt")):
        writers.write_report(old, f"{tmp_path}/{kind}", kind)
        assert list((tmp_path / kind).glob(f"*.{suffix}"))
    assert writers.drop_communities(old.withColumn("community_level_0", F.lit(1))).columns == old.columns


def test_streams_agree_with_batches(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = events.read_events(spark, f"{tmp_path}/in")
    for name, view, late in (("windowed", events.windowed, "60 days"), ("latest", events.latest_status, None)):
        made = view(stream, late=late) if late else view(stream)
        q = made.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
        batch = view(spark.read.schema(events.EVENTS).parquet(f"{tmp_path}/in"))
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, batch.collect()))
    q = events.sessions(stream, late="60 days").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("sessions").agg(F.sum("n")).first()[0] == source.count()
    assert events.first_seen(source.union(source)).count() == source.count()


def test_whole_graph_files(spark, tmp_path):
    import glob
    from xml.etree import ElementTree

    nodes = spark.createDataFrame([(f"n{i}", f'a <b> & "{i}"') for i in range(50)], "id string, label string").repartition(4)
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(49)], "src string, dst string").repartition(3)
    for kind, ns in (("gexf", "{http://gexf.net/1.2draft}"), ("graphml", "{http://graphml.graphdrawing.org/xmlns}")):
        writers.write_graph(nodes, edges, f"{tmp_path}/{kind}", kind)
        (file,) = glob.glob(f"{tmp_path}/{kind}/part-*")
        root = ElementTree.parse(file).getroot()
        assert root.tag == ns + kind
        assert {n.get("id") for n in root.iter(ns + "node")} == {f"n{i}" for i in range(50)}
        assert {(e.get("source"), e.get("target")) for e in root.iter(ns + "edge")} == {(f"n{i}", f"n{i + 1}") for i in range(49)}
    back, ways = readers.read_gexf(spark, f"{tmp_path}/gexf")
    assert back.count() == 50 and ways.count() == 49 and back.where("id = 'n7'").first()["label"] == 'a <b> & "7"'

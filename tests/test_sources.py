"""Readers and writers on small files, the stream, and the views' corpus."""

import json

import pytest
from pyspark.sql import functions as F

from scoutline.sources import files
from scoutline.streaming import event_windows


def test_csv_with_and_without_mark(spark, tmp_path):
    for name, mark in (("plain", b""), ("marked", b"\xef\xbb\xbf")):
        (tmp_path / f"{name}.csv").write_bytes(mark + 'id,name\n1,"a ""b"""\n2,"x\ny"\n3,\n'.encode())
        rows = files.read_csv(spark, f"file://{tmp_path}/{name}.csv", "id bigint, name string").collect()
        assert [tuple(r) for r in rows] == [(1, 'a "b"'), (2, "x\ny"), (3, None)]
    df = spark.createDataFrame([(1, 'q"u'), (2, None)], "id bigint, name string")
    files.write_csv(df, f"file://{tmp_path}/out")
    assert sorted(map(tuple, files.read_csv(spark, f"file://{tmp_path}/out", "id bigint, name string").collect())) == [(1, 'q"u'), (2, None)]


def test_json_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"q": "x", "n": 1}, {"q": "ş", "n": 2}]))
    assert sorted((r["q"], r["n"]) for r in files.read_json(spark, f"file://{tmp_path}/a.json").collect()) == [("x", 1), ("ş", 2)]
    df = spark.createDataFrame([(["a", "b"], "x")], "tokens array<string>, source string")
    files.write_jsonl(df, f"file://{tmp_path}/lines")
    assert [r["tokens"] for r in files.read_jsonl(spark, f"file://{tmp_path}/lines").collect()] == [["a", "b"]]


def test_label_maps(spark, tmp_path):
    ids = spark.createDataFrame([("b", 1), ("a", 0)], "label string, label_id int")
    files.write_json(spark, files.label_map(ids), f"file://{tmp_path}/map.json")
    assert json.loads((tmp_path / "map.json").read_text()) == {"label2id": {"a": 0, "b": 1}, "id2label": {"0": "a", "1": "b"}}
    assert sorted(map(tuple, files.read_label_map(spark, f"file://{tmp_path}/map.json").collect())) == [(0, "a"), (1, "b")]


def test_vector_index(spark, tmp_path):
    df = spark.createDataFrame([("7_1", [3.0, 4.0]), ("8_2", [0.0, 0.0])], "key string, vec array<double>")
    files.write_vector_index(df, f"file://{tmp_path}/index")
    got = {r["loc_id"]: r["vec"] for r in files.read_vector_index(spark, f"file://{tmp_path}/index").collect()}
    assert got == {7: [0.6, 0.8], 8: [0.0, 0.0]}


def test_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("1_2.jpg", b"\xff\xd8\xff\xe0rest"), ("3_4.PNG", b"\x89PNG\r\n\x1a\nrest"), ("5_6.jpg", b"not an image"), ("note.txt", b"\xff\xd8\xff"), ("7_8.webp", b"RIFF1234WEBPxx")):
        (tmp_path / "in" / name).write_bytes(content)
    assert sorted(r["key"] for r in files.read_images(spark, f"file://{tmp_path}/in").collect()) == ["1_2", "3_4", "7_8"]


def test_fetch_leaves_out_failures(spark):
    def get(url):
        if "bad" in url:
            raise OSError(url)
        return url.encode()

    rows = spark.createDataFrame([("a", "http://x/1"), ("b", "http://bad/2"), ("c", "http://x/3"), ("d", None)], "key string, url string")
    got = files.fetch(rows, spark.createDataFrame([("c",)], "key string"), get).collect()
    assert [(r["key"], bytes(r["content"])) for r in got] == [("a", b"http://x/1")]


def test_resumed_work(spark, tmp_path):
    path, rows = f"file://{tmp_path}/done", spark.range(7).withColumnRenamed("id", "row")
    double = lambda df: df.select("row", (F.col("row") * 2).alias("twice"))
    double(rows.where("row < 2")).write.parquet(path)
    asked = []

    def work(df):
        asked.append(df.count())
        return double(df)

    assert sorted(map(tuple, files.resumed(rows, "row", path, work, every=3).collect())) == [(k, 2 * k) for k in range(7)]
    assert asked == [3, 2] and files.resumed(rows, "row", path, work).count() == 7 and asked == [3, 2]


def test_external_scores(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "row int")
    for scores in ("0, 1.5, x", "0\n1.5\nx\n"):
        assert sorted((r["row"], r["score"]) for r in files.external_scores(df, "row", scores).collect()) == [(1, 0.0), (2, 1.5), (3, None)]
    with pytest.raises(ValueError):
        files.external_scores(df, "row", "1,2")


def test_late_events_are_left_out(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, event_type string, value double"
    folder = f"file://{tmp_path}/events"
    at = lambda *rows: spark.createDataFrame([(k, t, "click", 1.0) for k, t in rows], "event_id bigint, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    (tmp_path / "events").mkdir()
    counts = event_windows.windowed_counts(event_windows.read_events(spark, folder, schema))
    at((1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:20:00")).coalesce(1).write.mode("append").parquet(folder)

    def run():
        q = counts.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    at((3, "2024-01-01 05:00:00")).coalesce(1).write.mode("append").parquet(folder)
    run()
    at((4, "2024-01-01 00:30:00"), (5, "2024-01-01 09:00:00")).coalesce(1).write.mode("append").parquet(folder)  # event 4 comes after its hour is closed
    run()
    got = {str(r["start"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["2024-01-01 00:00:00"] == 2 and got.get("2024-01-01 05:00:00", 1) == 1


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a <b> & c", 1.5), (2, None, None), (3, " ş ", 2.0)], "id int, text string, score double")
    files.write_xlsx(df.orderBy("id"), f"file://{tmp_path}/book.xlsx")
    got = files.read_xlsx(spark, f"file://{tmp_path}/book.xlsx").collect()
    assert [tuple(r) for r in got] == [("1", "a <b> & c", "1.5"), ("2", None, None), ("3", " ş ", "2.0")]
    with pytest.raises(ValueError):
        files.write_xlsx(df, f"file://{tmp_path}/more.xlsx", most=2)
    (tmp_path / "book.csv").write_text("id,text\n1,x\n")
    assert [tuple(r) for r in files.read_xlsx(spark, f"file://{tmp_path}/book.csv").collect()] == [("1", "x")]

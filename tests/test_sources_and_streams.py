import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from normloom.sources import files, records
from normloom.streaming import incremental as S


def test_records(spark, rows):
    n = spark.createDataFrame([("Thông tư số 12/2024/TT-ABC, ngày",), ("số 7/QĐ-XY",), ("không",), (None,)], "t string")
    assert [r[0] for r in n.select(records.document_number(F.col("t"))).collect()] == ["12/2024/TT-ABC", "7/QĐ-XY", None, None]
    rss = "<rss><channel><item><title>Số 1/2024/TT-A</title><link>u1</link><guid>g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 +0700</pubDate></item><item><title>x</title></item></channel></rss>"
    got = records.feed_items(spark.createDataFrame([("p", rss), ("q", None)], "page string, content string")).collect()
    assert [(r["page"], r["number"]) for r in got] == [("p", "1/2024/TT-A"), ("p", None)] and got[0]["published"] == datetime(2024, 1, 1, 3)
    html = "<table><tr><th>a</th></tr><tr><td>One <b>two</b></td><td><a href='f.pdf'>3 Jan 2024</a></td></tr></table><a href='/v?id=ABCDEF12'>First</a><a href='/v?id=ABCDEF12'>Again</a>"
    page = spark.createDataFrame([("p", html)], "page string, content string")
    row = records.table_rows(page).where("row_no = 1").first()
    assert row["cells"] == ["One two", "3 Jan 2024"] and row["link"] == "f.pdf" and str(row["dated"]) == "2024-01-03"
    assert [tuple(r) for r in records.anchors(page).collect()] == [("ABCDEF12", "/v?id=ABCDEF12", "First")]
    names = ["Phu luc I.docx", "Biểu mẫu 1.doc", "Văn bản gốc.pdf", "Thông tư.doc", "Thông tư.DOCX", "Danh mục.pdf", "trang.html"]
    f = spark.createDataFrame([([(n, f"u{i}") for i, n in enumerate(names)],), ([("a.docx", " ")],), ([],)], "f array<struct<name:string,url:string>>")
    got = [[(x["url"], x["kind"]) for x in r[0]] for r in f.select(records.preferred_files(F.col("f"))).collect()]
    assert got == [[("u4", "main"), ("u3", "main"), ("u0", "appendix"), ("u1", "appendix"), ("u5", "appendix"), ("u2", "original_scan")], [], []]
    assert [r[0] and r[0]["url"] for r in f.select(records.best_file(F.col("f"))).collect()] == ["u4", None, None]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "sub/b.html").write_text("<p>y</p>")
    (tmp_path / "c.exe").write_text("z")
    (tmp_path / ".hidden/d.md").write_text("z")
    (tmp_path / "a.md.meta.json").write_text(json.dumps({"number": "N1", "title": ""}))
    lib = files.library(spark, str(tmp_path))
    assert sorted(r["name"] for r in lib.collect()) == ["a.md", "b.html"]
    got = {r["name"]: r["meta"] for r in files.with_sidecars(lib, spark, str(tmp_path)).collect()}
    assert got["a.md"]["number"] == "N1" and got["b.html"] is None
    (tmp_path / "a.md.meta.json").write_text(json.dumps({"odd": 1}))
    with pytest.raises(Exception, match="sidecar"):
        files.with_sidecars(lib, spark, str(tmp_path)).collect()
    blobs = lib.select("content").union(lib.select("content"))
    none = spark.createDataFrame([], "key string")
    assert files.new_blobs(blobs, none).count() == 2 and files.new_blobs(blobs, files.new_blobs(blobs, none)).count() == 0
    case = {"id": "1", "question": "q", "expected": [{"doc_number": "n", "segments": None}]}
    (tmp_path / "g.json").write_text(json.dumps([case, {"id": "2", "question": "q", "expect_abstain": True}]))
    assert files.golden(spark, str(tmp_path / "g.json")).count() == 2
    (tmp_path / "g.json").write_text(json.dumps([case, case]))
    with pytest.raises(ValueError):
        files.golden(spark, str(tmp_path / "g.json"))


def test_discovery_stream(spark, tmp_path):
    src, schema = tmp_path / "in", "external_id string, content_hash string"
    process = lambda df: df.withColumn("state", F.when(F.col("external_id") == "bad", "failed").otherwise("indexed"))
    path, mark = str(tmp_path / "ledger"), str(tmp_path / "mark")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))
        S.discover(spark.readStream.schema(schema).json(str(src)), path, mark, process)
        return sorted((r["external_id"], r["state"], r["batch"]) for r in S.ledger(spark, path).collect())

    assert run([("a", "1"), ("a", "1"), ("bad", "1")]) == [("a", "indexed", 0), ("bad", "failed", 0)]
    assert run([("a", "1"), ("bad", "1"), ("a", "2")]) == [("a", "indexed", 0), ("a", "indexed", 1), ("bad", "failed", 0), ("bad", "failed", 1)]


def test_due_events_wait_for_event_time(spark, tmp_path):
    schema = "target_id string, kind string, event_date timestamp, seen_at timestamp, base_status string"
    d = lambda n: datetime(2024, 1, n)
    batches = [[("x", "amended", d(2), d(1), None), ("x", "repealed", d(10), d(1), None), ("r", "amended", d(2), d(1), "repealed"), ("a", "amended", d(2), d(1), "amended")], [("y", "amended", d(5), d(6), "not_yet_effective")], [("y", None, d(5), d(20), None)], [("z", None, d(1), d(21), None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # one file a batch, in the order of writing
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.status_stream(stream).writeStream.format("memory").queryName("statuses").outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["id"], r["status"]) for r in spark.sql("select * from statuses order by changed, id").collect()]
    assert got == [("x", "amended"), ("y", "amended"), ("x", "repealed")]


def test_windows(spark, tmp_path):
    schema = "event_id int, ts timestamp, event_type string, value double"
    d = lambda h, m: datetime(2024, 1, 1, h, m)
    spark.createDataFrame([(1, d(1, 5), "a", 1.0), (2, d(1, 50), "a", 2.0), (2, d(1, 50), "a", 2.0), (3, d(2, 0), "a", 4.0), (4, d(9, 0), "b", 1.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.deduplicated(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = S.windowed(stream, lateness=None).writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["start"].hour, r["n"], r["total"]) for r in spark.sql("select * from win").collect()} >= {(1, 2, 3.0)}

"""Round trips of sources and sinks; streams give what the batch gives."""

import zipfile

import pytest
from pyspark.sql import functions as F

from ranksmith.sources import exports, files
from ranksmith.streaming import windows


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.pdf").write_text("no pdf")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    got = files.validated(files.read_files(spark, str(tmp_path)))
    errors = {r.path.rpartition("/")[2]: r.error for r in got.collect()}
    assert errors == {"a.txt": None, "b.txt": None, "c.pdf": "content does not match type", "d.docx": None}
    empty = got.limit(1).select(F.lit("txt").alias("extension"), F.lit(0).alias("length"), F.lit(b"").alias("content"))
    assert files.validated(empty).first().error == "empty file"
    good, bad = files.split_by_error(got)
    assert bad.count() == 1
    parsed = {r.path.rpartition("/")[2]: r.parsed for r in files.parsed(good).collect()}
    assert parsed["a.txt"].text == "héllo" and parsed["d.docx"].text == "One\nx | y" and parsed["b.txt"].error.startswith("UnicodeDecodeError")
    assert files.batch_error(got).first().error is None


def test_status_payload(spark):
    df = spark.createDataFrame([('{"compositeScore": 0.5, "status": "graded"}',), ('{"score": 70}',)], "payload string")
    assert [(r.composite_score, r.is_graded) for r in files.status_payload(df).collect()] == [(50.0, True), (70.0, False)]


CANDIDATE = "rank_position int, candidate string, email string, final_score double, recommendation string, confidence double, skills_score double, experience_score double, matched_skills array<string>, missing_skills array<string>, is_knocked_out boolean"


def candidates(spark, n):
    rows = [(i, f"Ann {i} (x)", None if i % 2 else "a@b.c", 90.5 - i, "SHORTLIST", 100.0, 80.0, 70.0, ["a", "b"], ["c"] if i % 2 else [], i == 2) for i in range(n, 0, -1)]
    return spark.createDataFrame(rows, CANDIDATE).repartition(3)


def test_csv_is_one_file_in_order(spark, tmp_path):
    exports.export(candidates(spark, 5), "csv", f"{tmp_path}/csv")
    files_ = sorted((tmp_path / "csv").glob("*.csv"))
    assert len(files_) == 1
    lines = files_[0].read_text(encoding="utf-8").splitlines()
    assert lines[0] == "\ufeff" + ",".join(exports.HEADER)
    assert [x.split(",")[0] for x in lines[1:]] == ["1", "2", "3", "4", "5"] and '"a, b"' in lines[1] and lines[2].endswith("KNOCKED_OUT")
    exports.write_csv(candidates(spark, 40), f"{tmp_path}/many", most=10)
    parts = [f.read_text(encoding="utf-8").splitlines() for f in sorted((tmp_path / "many").glob("*.csv"))]
    assert all(p[0] == lines[0] for p in parts) and [int(x.split(",")[0]) for p in parts for x in p[1:]] == list(range(1, 41))
    exports.write_csv(candidates(spark, 1).limit(0), f"{tmp_path}/none")


def test_workbook_pages_and_outbox(spark, tmp_path):
    rows = candidates(spark, 3)
    summary = spark.createDataFrame([(3, 88.5, 89.5, 87.5, None, 1)], "total_candidates int, average_score double, highest_score double, lowest_score double, average_confidence double, knocked_out_count int")
    exports.export(rows, "xlsx", f"{tmp_path}/r.xlsx", summary=summary)
    book = zipfile.ZipFile(tmp_path / "r.xlsx")
    names = book.read("xl/workbook.xml").decode()
    assert all(f'name="{n}"' in names for n in exports.SHEETS)
    first, skills, figures = (book.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2, 3))
    assert first.index("Ann 1 (x)") < first.index("Ann 2 (x)") and 'sqref="D2:D4"' in first and 'type="colorScale"' in first and 'state="frozen"' in first and 'autoFilter ref="A1:K4"' in first
    assert "Matched" in skills and "66.67" in skills and "colorScale" not in skills and "Knocked Out Count" in figures
    exports.export(rows, "pdf", f"{tmp_path}/r.pdf", title="Work", summary=summary)
    pdf = (tmp_path / "r.pdf").read_bytes()
    assert pdf.startswith(b"%PDF-") and b"Ann 1 \\(x\\)" in pdf and b"Work - Candidate Report" in pdf and b"Knocked Out Count: 1" in pdf
    exports.export(rows, "json", f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 3
    sent = exports.outbox(rows.select("email", "candidate"), "email", "invite")
    assert sent.where("recipient = 'a@b.c'").count() == 1 and sent.select("idempotency_key").distinct().count() == 3
    with pytest.raises(ValueError):
        exports.export(rows, "doc", f"{tmp_path}/x")


def test_store_round_trip_and_root(spark, tmp_path):
    root = f"{tmp_path}/store"
    rows = [("in/a.TXT", b"one"), ("in/b.txt", b"one"), ("c", b""), ("d.bin", bytes(3 << 20)), ("e.pdf", None)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(2)
    for _ in range(2):  # a second run writes nothing new
        kept = {r.path: r for r in files.store_files(df, root).collect()}
    assert kept["in/a.TXT"].stored_path == kept["in/b.txt"].stored_path and kept["e.pdf"].error == "no content" and kept["d.bin"].size == 3 << 20
    assert sum(1 for p in (tmp_path / "store").rglob("*") if p.is_file()) == 3
    (tmp_path / "secret.txt").write_text("no")
    paths = [kept["in/a.TXT"].stored_path, kept["d.bin"].stored_path, f"{root}/../secret.txt", f"{tmp_path}/secret.txt", "secret.txt", f"{root}/none", f"{root}2/x", root, None, f"{root}/x/../../store/aa"]
    got = {r.stored_path: (r.content and len(r.content), r.error) for r in files.read_stored(spark, spark.createDataFrame([(p,) for p in paths], "stored_path string"), root).collect()}
    out = "path is outside the storage root"
    assert got == {paths[0]: (3, None), paths[1]: (3 << 20, None), paths[2]: (None, out), paths[3]: (None, out), paths[4]: (None, out), paths[5]: (None, "no such file"), paths[6]: (None, out), root: (None, out), None: (None, out), paths[9]: (None, "no such file")}


def test_polled_upsert_is_idempotent(spark, tmp_path):
    """Batches join the known candidates by reference, mail or name; a batch that is run again, and late rows, change nothing."""
    from ranksmith.operators.joins import priority_join

    known = spark.createDataFrame([("c1", "r1", "a@x", "Ann"), ("c2", None, "b@x", "Bob"), ("c3", None, None, "Cem")], "id string, ref string, mail string, name string")
    schema = "ref string, mail string, name string, score double, polled long"

    def prepare(batch):
        keys = [(F.col(k), F.col(k)) for k in ("ref", "mail", "name")]
        return priority_join(batch, known, keys, {"id": "candidate"}).where("candidate IS NOT NULL").select("candidate", "score", "polled")

    def poll(rows, i):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = windows.upsert_partitioned(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", ["candidate"], "polled", f"{tmp_path}/{i}", buckets=8, prepare=prepare)
        q.start().awaitTermination()
        return sorted((r.candidate, r.score, r.polled) for r in spark.read.parquet(f"{tmp_path}/t/rows").collect())

    assert poll([("r1", None, None, 1.0, 1), (None, "b@x", "Zoe", 2.0, 1), (None, None, "nobody", 9.0, 1)], "c") == [("c1", 1.0, 1), ("c2", 2.0, 1)]
    files_ = {str(p) for p in (tmp_path / "t" / "rows").rglob("*.parquet")}
    assert poll([(None, None, "Cem", 3.0, 2), ("r1", None, None, 0.5, 0)], "c") == [("c1", 1.0, 1), ("c2", 2.0, 1), ("c3", 3.0, 2)]
    assert files_ & {str(p) for p in (tmp_path / "t" / "rows").rglob("*.parquet")}  # an untouched partition keeps its file
    # a new checkpoint runs every batch again
    assert poll([("r1", None, None, 4.0, 3)], "again") == [("c1", 4.0, 3), ("c2", 2.0, 1), ("c3", 3.0, 2)]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, "view" if i % 2 else "signup", float(i)) for i in range(100)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windows.with_event_time(windows.read_events(spark, f"{tmp_path}/in", events.schema), late="1 hour")
    q = windows.tumbling(stream, "ts", "10 minutes", "event_type").writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = windows.tumbling(windows.with_event_time(events), "ts", "10 minutes", "event_type")
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, batch.collect()))


def test_state_and_upsert(spark, tmp_path):
    events = spark.createDataFrame([(1, "view"), (1, "signup"), (1, "click"), (2, "error")], "user_id long, event_type string")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = windows.furthest_status(stream).writeStream.format("memory").queryName("status").outputMode("update").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.user_id, r.status, r.n) for r in spark.table("status").collect()) == [(1, "signup", 3), (2, None, 1)]
    u = windows.upsert_stream(stream, f"{tmp_path}/t", ["user_id"], f"{tmp_path}/c2").start()
    u.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/t/batch=0").count() == 2

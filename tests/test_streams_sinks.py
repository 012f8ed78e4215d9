from datetime import datetime

from gistmill.operators import mail as M
from gistmill.sources import parts
from gistmill.streaming import streams
from pyspark.sql import functions as F


def test_only_new_mail_is_read(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    (source / "a.eml").write_bytes(b"From: A <a@x.example>\r\nSubject: one\r\n\r\nhi")
    told = []
    listener = streams.Progress(spark, told.append)
    spark.streams.addListener(listener)
    assert [r.subject for r in streams.new_mail(spark, str(source), folder).collect()] == ["one"]
    (source / "b.eml").write_bytes(b"From: A <a@x.example>\r\nSubject: two\r\n\r\nhi")
    assert sorted(r.subject for r in streams.new_mail(spark, str(source), folder).collect()) == ["one", "two"]
    spark.streams.removeListener(listener)
    assert any("batch" in t for t in told)


def test_repeats_of_a_stream(spark, tmp_path):
    rows = [("a", 1, datetime(2024, 1, 1, 10, 0)), ("a", 2, datetime(2024, 1, 1, 10, 1)), ("b", 3, datetime(2024, 1, 1, 10, 1))]
    frame = spark.createDataFrame(rows, "key string, idx long, at timestamp")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    assert sorted(r.key for r in streams.near_repeats_stream(stream, str(tmp_path / "out")).collect()) == ["a", "b"]


def test_caches_and_log(spark, tmp_path):
    assert parts.load_cache(spark, str(tmp_path), "mail") is None
    one = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-03-01"), (3, None)], "k long, last_used string")
    parts.save_cache(one, str(tmp_path), "mail")
    parts.save_cache(parts.evicted(parts.load_cache(spark, str(tmp_path), "mail"), "2024-03-10"), str(tmp_path), "mail")
    assert sorted(r.k for r in parts.load_cache(spark, str(tmp_path), "mail").collect()) == [2, 3]
    assert parts.run_log({"emails": 3}, {"read": 1.25}, ["old.txt"], ["x"]) == "emails: 3\nread: 1.2 s\nremoved: old.txt\nnote: x\n"
    assert parts.part_names("a/b", 2, "24-01-01", "24-02-01", filters=("RFI: 12",))[0] == "a b 24-01-01 to 24-02-01 (RFI 12) part 1 of 2.txt"


def test_time_of_sending(spark):
    rows = [("2024-03-04T10:12:00.5+01:00", datetime(2025, 1, 1)), ("4 March", datetime(2025, 1, 1)), (None, None), ("2024-03-04T10:12:00Z", None)]
    out = spark.createDataFrame(rows, "d string, m timestamp_ntz").select(M.sent_at(F.col("d"), F.col("m")).alias("t"))
    assert [r.t for r in out.collect()] == [datetime(2024, 3, 4, 9, 12, 0, 500_000), datetime(2025, 1, 1), None, datetime(2024, 3, 4, 10, 12)]

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from flowlake import session
from flowlake.operators import clean, encode
from flowlake.sources import readers
from flowlake.sources.durable import Slots, counted_broadcast, fresh_path
from flowlake.sources.state import Processor
from flowlake.streaming import capture


def test_mixed_messages_become_the_union_of_their_keys(spark):
    lines = [{"a": 1, "b.c": "x"}, {"a": 2, "tags": [1, 2]}, {"flag": True}]
    df = spark.createDataFrame([(json.dumps(r),) for r in lines], "value string")
    got = readers.json_table(df, "value")
    assert got.columns == ["a", "b.c", "flag", "tags"]
    assert got.where("a = '2'").first()["tags"] == "[1,2]"
    kept = clean.drop_columns(got, ["b.c", "absent"])
    assert kept.columns == ["a", "flag", "tags"]


def test_bad_payloads_keep_both_ends(spark):
    long = "[" + "x" * 3000
    df = spark.createDataFrame([('[{"a": 1}, {"b": 2}]',), (long,), ("[{]",)], "value string")
    good, bad = readers.payload_records(df, "value")
    assert good.count() == 2
    rows = {r["n_chars"]: r for r in bad.collect()}
    assert set(rows) == {3001, 3}
    assert rows[3001]["head"] == long[:1000] and rows[3001]["tail"] == long[-1000:]


def test_dirty_columns(spark):
    rows = [("0x000b", " ", 2, "  DoS "), ("80", "3", 0, None), (None, None, None, "Normal")]
    df = spark.createDataFrame(rows, "port string, cmd string, login int, cat string")
    got = clean.binarized(clean.blanks_to_int(clean.coerced_int(df, ["port"]), ["cmd"]), ["login"])
    got = clean.tidy_text(clean.fill_constants(got, {"cat": "normal"}), ["cat"])
    assert [tuple(r) for r in got.collect()] == [(0, 0, 1, "dos"), (80, 3, 0, "normal"), (0, None, 0, "normal")]


def test_unseen_values_become_minus_one_per_row(spark):
    train = spark.createDataFrame([(0, "tcp"), (1, "udp"), (2, "tcp"), (3, None)], "id int, proto string")
    codes = encode.fit_codes(train, ["proto"], order="id")
    new = spark.createDataFrame([("udp",), ("icmp",), (None,)], "proto string")
    assert sorted(r["proto"] for r in encode.encode(new, codes, ["proto"]).collect()) == [-1, -1, 1]


def test_class_names(spark):
    got = spark.range(-1, 13).select(encode.class_name("id").alias("n")).collect()
    names = [r["n"] for r in got]
    assert names[0] == "unknown_-1" and names[1] == "Normal" and names[11] == "Shellcode" and names[12] == "unknown_11"


def test_processor_state_is_only_overwritten_on_request(spark):
    df = spark.createDataFrame([(i, float(i), "ab"[i % 2]) for i in range(10)], "id int, dur double, attack_cat string")
    fitted = Processor.fit(df, numbers=["dur"])
    path = fresh_path(spark, "state")
    fitted.save(path)
    with pytest.raises(Exception, match="already exists"):
        fitted.save(path)
    fitted.save(path, force=True)
    out = Processor.load(spark, path).transform(df)
    assert out.columns == ["dur", "label"] and {r["label"] for r in out.select("label").collect()} == {0, 1}


def test_integer_caps_truncate(spark):
    df = spark.createDataFrame([(1, 1.0), (100, 100.0), (None, None)], "i int, d double")
    got = clean.cap_outliers(df, {"i": 50.9, "d": 50.9}).collect()
    assert [tuple(r) for r in got] == [(1, 1.0), (50, 50.9), (None, None)]


def test_drain_resumes_where_it_stopped(spark):
    inbox, out, mark = (fresh_path(spark, n) for n in ("inbox", "out", "mark"))

    def send(first):
        rows = [(json.dumps({"event_id": i, "v": i % 3 or None, "mem": 1}),) for i in range(first, first + 50)]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(inbox)

    def run():
        stream = capture.message_stream(spark, "files", path=inbox)
        capture.capture_once(stream, out, mark).awaitTermination()
        return capture.captured(spark, out, ["event_id"], ["event_id", "mem", "v"])

    send(0)
    first = run()
    assert first.count() == 49 and "mem" not in first.columns  # row 0 has nothing to fill from
    assert first.where("label = 1").count() == 10
    send(50)
    second = run()
    assert second.select("event_id").distinct().count() == second.count()
    assert second.count() == 99  # values are carried across drains
    assert second.where("label = 1").count() == 10


def test_a_drain_without_messages_is_an_empty_table(spark):
    inbox, out, mark = (fresh_path(spark, n) for n in ("inbox", "out", "mark"))
    spark.createDataFrame([], "value string").write.text(inbox)
    stream = capture.message_stream(spark, "files", path=inbox)
    capture.capture_once(stream, out, mark).awaitTermination()
    got = capture.captured(spark, out, ["event_id"], ["event_id", "v"])
    assert got.columns == ["event_id", "v", "label"] and got.count() == 0
    assert capture.captured(spark, out, ["event_id"]).count() == 0
    assert capture.captured(spark, fresh_path(spark, "nothing"), ["event_id"]).columns == ["event_id", "label"]


def test_a_drain_stops_by_itself_when_nothing_comes(spark):
    inbox, out, mark = (fresh_path(spark, n) for n in ("inbox", "out", "mark"))
    rows = [(json.dumps({"event_id": i, "v": i}),) for i in range(40)]
    spark.createDataFrame(rows, "value string").repartition(4).write.text(inbox)
    stream = capture.message_stream(spark, "files", path=inbox, files="1")
    assert capture.capture_until_idle(stream, out, mark, idle_seconds=4) == 40
    assert not spark.streams.active
    assert capture.captured(spark, out, ["event_id"]).count() == 40
    # nothing new: it ends again, and the table stays as it is
    assert capture.capture_until_idle(stream, out, mark, idle_seconds=2) == 0
    assert capture.captured(spark, out, ["event_id"]).count() == 40


def test_a_drain_stops_at_its_limit(spark):
    inbox, out, mark = (fresh_path(spark, n) for n in ("inbox", "out", "mark"))
    spark.createDataFrame([(json.dumps({"event_id": i}),) for i in range(60)], "value string").repartition(6).write.text(inbox)
    stream = capture.message_stream(spark, "files", path=inbox, files="1")
    taken = capture.capture_until_idle(stream, out, mark, idle_seconds=20, limit=15)
    assert 15 <= taken <= 60


def test_long_ids_are_ordered_by_their_digits(spark):
    ids = ["9" * 30, "1" + "0" * 30, "1" + "0" * 29 + "1", "12.5", "12.25", "x", None, "7"]
    df = spark.createDataFrame([(i, "a") for i in ids], "event_id string, v string")
    keys = [n.asc_nulls_last() for n in clean.numeric_order(F.col("event_id"))]
    got = [r["event_id"] for r in df.where("event_id is not null").orderBy(*keys, "event_id").collect()]
    assert got == ["7", "12.25", "12.5", "9" * 30, "1" + "0" * 30, "1" + "0" * 29 + "1", "x"]
    last = {r["event_id"] for r in clean.label_flag_last(df.where("event_id <> 'x'"), ["event_id"], 2).where("label = 1").collect()}
    assert last == {"1" + "0" * 30, "1" + "0" * 29 + "1"}


def test_latest_report_is_read_whole(spark):
    from flowlake.sources import sinks

    flat, runs = fresh_path(spark, "flat"), fresh_path(spark, "runs")
    for n, rows in ((1, 40), (2, 1000)):
        df = spark.range(rows).withColumn("v", F.lit(n)).repartition(4)
        df.write.mode("append").option("header", True).csv(flat)
        sinks.write_run(df, runs, f"2024010{n}_000000")
    for folder in (flat, runs):
        got = readers.latest_csv(spark, folder)
        assert got.count() == 1000 and [r["v"] for r in got.select("v").distinct().collect()] == [2]


def test_streaming_receive_rate_matches_batch(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").select("ts", "props")
    inbox, out, mark = (fresh_path(spark, n) for n in ("rate", "rate_out", "rate_mark"))
    events.write.parquet(inbox)
    stream = spark.readStream.schema(events.schema).parquet(inbox)
    rates = capture.receive_rate(stream, "props", "ts", "1 day", lateness="1 hour")
    query = (
        rates.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", mark).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r["window_start"]: r["n_messages"] for r in spark.read.parquet(out).collect()}
    want = {r["window_start"]: r["n_messages"] for r in capture.receive_rate(events, "props", "ts", "1 day").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert set(want) - set(got) <= set(sorted(want)[-2:])  # only windows the watermark has not closed


def test_slots_keep_two_copies(spark):
    slots = Slots(spark, "slots")
    table = slots.put(spark.range(10))
    for _ in range(4):
        table = slots.put(table.select((F.col("id") + 1).alias("id")))
    assert table.agg(F.sum("id")).first()[0] == 45 + 40


def test_broadcast_only_under_the_counted_limit(spark):
    hinted = counted_broadcast(spark.range(10), limit=10)._jdf.queryExecution().toString()
    plain = counted_broadcast(spark.range(11), limit=10)._jdf.queryExecution().toString()
    assert "broadcast" in hinted.lower() and "broadcast" not in plain.lower()


def test_shared_folder_is_the_clusters_or_an_error(spark, monkeypatch):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

    class Context:
        master, applicationId = "yarn", "app"

    class Session:
        sparkContext = Context()

        def __init__(self, value):
            self.conf = Conf(value)

    assert session.shared_folder(Session("hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        session.shared_folder(Session(None))


def test_latest_csv_in_folders_named_like_patterns(spark, tmp_path):
    for name, value in (("run 1", 1), ("run [12]", 2), ("run {1,2}*", 3)):
        spark.range(value).repartition(2).write.option("header", True).csv(str(tmp_path / name))
        newest = time.time() + 100 * value
        for part in (tmp_path / name).glob("part-*.csv"):
            os.utime(part, (newest, newest))
        assert readers.latest_csv(spark, str(tmp_path)).count() == value
    alone = tmp_path / "one [a].csv"
    alone.write_text("id\n7\n")
    os.utime(alone, (time.time() + 1000, time.time() + 1000))
    assert [r["id"] for r in readers.latest_csv(spark, str(tmp_path)).collect()] == [7]

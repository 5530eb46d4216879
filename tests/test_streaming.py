"""Streams over files that arrive one after the other, against the same in one batch."""

import os

from pyspark.sql import functions as F

from ledgerloom.streaming import ingest


def rows(spark):
    return spark.range(0, 400).selectExpr("id", "id % 7 user", "if(id % 3 = 0 and id % 7 < 6, id * 1.5D, null) unit")


def test_values_carried_from_file_to_file(spark, tmp_path):
    stream = ingest.arriving(rows(spark), F.col("id"), 5, str(tmp_path / "in"))
    got = ingest.read_up(ingest.carried_over(stream, "user", "id", "unit"), str(tmp_path / "out"))
    last, want = {}, []
    for r in rows(spark).orderBy("id").collect():
        last[r.user] = r.unit if r.unit is not None else last.get(r.user)
        want.append((r.user, r.id, last[r.user]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert len([d for d in os.listdir(tmp_path / "out") if d.startswith("batch=")]) >= 5


def test_states_do_not_grow_with_keys(spark, tmp_path):
    """Many keys, one of them null and large ones, share the states of a few parts."""
    many = spark.range(0, 6000).selectExpr("id", "if(id % 1500 = 7, null, id % 1500 + 9007199254740993) user", "if(id % 4 = 0, id * 1.5D, null) unit")
    stream = ingest.arriving(many, F.col("id"), 3, str(tmp_path / "in"))
    got = ingest.read_up(ingest.carried_over(stream, "user", "id", "unit", 16), str(tmp_path / "out"))
    last, want = {}, []
    for r in many.orderBy("id").collect():
        last[r.user] = r.unit if r.unit is not None else last.get(r.user)
        want.append((r.user, r.id, last[r.user]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert spark.read.format("statestore").load(str(tmp_path / "out-state")).count() <= 17


def test_a_batch_given_again_and_late_files(spark, tmp_path):
    """A second run goes on where the first ended, with the state that it left; a batch written again is there once."""
    kept = rows(spark)
    ingest.arriving(kept.where("id < 200"), F.col("id"), 2, str(tmp_path / "in"))
    stream = spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).option("maxFileAge", "100000d").parquet(str(tmp_path / "in"))
    carried = ingest.carried_over(stream, "user", "id", "unit")
    first = ingest.read_up(carried, str(tmp_path / "out")).count()
    kept.where("id >= 200").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.read_up(carried, str(tmp_path / "out"))
    again = ingest.read_up(carried, str(tmp_path / "out"))
    assert (first, again.count(), again.select("id").distinct().count()) == (200, 400, 400)
    assert again.where("id >= 200 and unit is null").where("user < 6").count() == 0


def test_complete_sinks(spark, tmp_path):
    events = spark.range(0, 100).selectExpr("id % 4 user_id", "timestamp_seconds(id * 600) ts", "id * 1.0D value", "if(id % 2 = 0, 'a', 'b') event_type")
    stream = lambda name: ingest.arriving(events, F.col("ts"), 3, str(tmp_path / name))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(ingest.read_up(ingest.sessions(stream("a")), str(tmp_path / "s"), "complete")) == plain(ingest.sessions(events))
    assert plain(ingest.read_up(ingest.windowed(stream("b")), str(tmp_path / "w"), "complete")) == plain(ingest.windowed(events))

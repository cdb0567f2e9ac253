"""Streams over landed files: repeats, late rows, windows, replayed batches."""

import pytest
from pyspark.sql import functions as F

from newsloom.sources.sinks import Store
from newsloom.streaming import arrivals

KIND = "keyword string, title string, source string, published_at string, link string, ord long"


def land(spark, path, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").json(str(path))


def row(title, at, link, source="A", ord_=0):
    return ("k", title, source, at, link, ord_)


@pytest.fixture
def landed(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def stream():
        return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    return tmp_path, stream


def drained(df, path, mode="append"):
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{path}/check").outputMode(mode).trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination(120)
    return df.sparkSession.read.parquet(f"{path}/out")


def test_repeats_within_the_window_go(spark, landed):
    path, stream = landed
    land(spark, path / "in", [row("One - A", "2026-01-01T00:00:00+00:00", "1"), row("ONE", "2026-01-01T05:00:00+00:00", "2"), row("One", "2026-01-01T05:00:00+00:00", "3", "B"), row("Two", "", "4")])
    got = drained(arrivals.without_repeats(stream()), path)
    assert sorted(r["source"] for r in got.collect()) == ["A", "B"]
    land(spark, path / "in", [row("one", "2026-01-01T09:00:00+00:00", "5"), row("Three", "2026-01-20T00:00:00+00:00", "6")])
    got = drained(arrivals.without_repeats(stream()), path)  # the query goes on where it stood
    assert sorted(r["link"] for r in got.collect())[1:] == ["3", "6"] and got.count() == 3
    land(spark, path / "in", [row("One", "2026-01-20T01:00:00+00:00", "7")])  # forgotten by now
    assert "7" in {r["link"] for r in drained(arrivals.without_repeats(stream()), path).collect()}


def test_counts_equal_those_of_a_batch(spark, landed):
    path, stream = landed
    rows = [row(str(i), f"2026-01-0{1 + i % 3}T{i % 24:02}:30:00+00:00", "x", "AB"[i % 2]) for i in range(60)] + [row("end", "2026-02-01T00:00:00+00:00", "x")]
    land(spark, path / "in", rows)
    land(spark, path / "in", [row("later", "2026-03-01T00:00:00+00:00", "x")])  # moves the watermark past the first file's windows
    got = drained(arrivals.counts_by_window(stream(), "source"), path)
    want = spark.createDataFrame(rows[:-1], KIND).groupBy(F.date_trunc("hour", F.to_timestamp("published_at")).alias("at"), "source").agg(F.count(F.lit(1)).alias("n"))
    at_least = {(r["at"], r["source"], r["n"]) for r in want.collect()}
    assert {(r["at"], r["source"], r["n"]) for r in got.select(F.col("window.start").alias("at"), "source", "n").collect()} >= at_least


def test_a_replayed_batch_changes_nothing(spark, landed):
    path, stream = landed
    store = Store(str(path / "store"), buckets=4)
    land(spark, path / "in", [row("One", "", "first"), row("Two", "", "second")])
    arrivals.keep(stream(), store, str(path / "check")).awaitTermination(120)
    land(spark, path / "in", [row("One", "", "third")])
    arrivals.keep(stream(), store, str(path / "check")).awaitTermination(120)
    manifest = store.manifest(spark)
    assert {(r["title"], r["link"]) for r in store.load(spark).collect()} == {("One", "third"), ("Two", "second")} and manifest["tags"] == {str(path / "check"): 1}
    for batch in (0, 1):  # as after a failure between the save and the checkpoint
        assert store.save(spark.createDataFrame([row("One", "", "first")], KIND), tag=(str(path / "check"), batch)) == 0
    assert store.manifest(spark) == manifest
    assert store.save(spark.createDataFrame([row("One", "", "other")], KIND), tag=("another stream", 0)) == manifest["version"] + 1

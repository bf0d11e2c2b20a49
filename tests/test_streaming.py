"""A stream gives what the batch gives."""

from chainweave.streaming import windows


def test_clusters_of_stream(spark, tmp_path):
    rows = [("a", 0, 0), ("a", 1, 0), ("a", 2, 2), ("b", 0, 0), ("a", 3, 1), ("b", 1, 1)]
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "doc_key string, m long, a long").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("doc_key string, m long, a long").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = windows.clusters_of_stream(stream).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from found").collect()} == {("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 0), ("b", 0, 0), ("b", 1, 1)}


def test_windows_of_stream(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = {(r["start"], r["event_type"]): r["events"] for r in windows.event_windows(spark.read.parquet(path)).collect()}
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = windows.event_windows(stream, late="1 day").writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["start"], r["event_type"]): r["events"] for r in spark.sql("select * from hours").collect()} == batch

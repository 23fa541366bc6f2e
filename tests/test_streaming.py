from edgeloom.streaming.refresh import FingerprintStream


def test_a_stream_of_listings(spark, tmp_path):
    schema = "path string, size long, mtime_ms double"
    start = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], schema)
    seen = []
    stream = FingerprintStream(start, lambda changes: seen.append({tuple(r) for r in changes.collect()}))
    for i, rows in enumerate([[("a", 1, 1.0), ("c", 5, 2.0)], [("b", None, 3.0), ("c", 6, 4.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        if not i:
            source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            run = stream.start(source, checkpointLocation=str(tmp_path / "state"))
        run.processAllAvailable()
    run.stop()
    assert [s for s in seen if s] == [{("c", "changed")}, {("b", "deleted"), ("c", "changed")}]
    assert {tuple(r) for r in stream.state.collect()} == {("a", 1, 1.0), ("c", 6, 4.0)}

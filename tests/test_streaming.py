from diffquarry.streaming import reviews


def test_late_feedback_waits(spark, tmp_path):
    schema = "key string, fingerprint string, kind string, count int"
    for i, rows in enumerate(([("k", "f", "reaction", 1), ("k", "g", "reaction", 4)], [("k", "f", "finding", 0)], [("k", "f", "reaction", 3)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    q = reviews.feedback_stream(stream).writeStream.format("memory").queryName("late").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = [tuple(r) for r in spark.sql("select fingerprint, kind, count from late").collect()]
    assert {r[0] for r in got} == {"f"} and got[-1][2] in (1, 3)


def test_unseen_stream(spark, tmp_path):
    rows = spark.sql("select * from values ('a', timestamp_ntz'2024-01-01 00:00:00'), ('a', timestamp_ntz'2024-01-01 00:01:00'), ('b', timestamp_ntz'2024-01-01 00:02:00') t(fp, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = reviews.unseen_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["fp"], "ts")
    q = stream.writeStream.format("memory").queryName("unseen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.fp for r in spark.table("unseen").collect()) == ["a", "b"]

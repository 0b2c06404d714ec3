from gridframe.streaming.batches import seal_stream


def test_out_of_order_samples_make_whole_batches(spark, tmp_path):
    folder = tmp_path / "in"
    for n, seqs in enumerate(([0, 1, 5], [2, 4, 3], [7, 6, 8, 1])):
        rows = [("a", s, f"p{s}") for s in seqs]
        spark.createDataFrame(rows, "stream_id string, sample_seq bigint, payload string").coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    stream = spark.readStream.schema("stream_id string, sample_seq bigint, payload string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    sealed = seal_stream(stream, 2).writeStream.format("memory").queryName("sealed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    sealed.awaitTermination(120)
    got = [(r["batch_id"], r["sample_idx"], r["sample_seq"], r["payload"]) for r in spark.sql("SELECT * FROM sealed ORDER BY sample_seq").collect()]
    assert got == [(s // 2, s % 2, s, f"p{s}") for s in range(8)]

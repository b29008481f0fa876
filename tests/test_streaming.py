from genospan.streaming import running_sample_counts


def test_counts_follow_new_shards(spark, tmp_path):
    shard = lambda rows, k: spark.createDataFrame(rows, "vidx long, gt array<tinyint>").write.parquet(f"{tmp_path}/in/{k}")
    shard([(0, [0, 1, None]), (1, [2, 1, 0])], "a")
    query = running_sample_counts(spark, f"{tmp_path}/in/*").writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        query.processAllAvailable()
        assert {tuple(r) for r in spark.table("running").collect()} == {(0, 1, 0, 1, 0), (1, 0, 2, 0, 0), (2, 1, 0, 0, 1)}
        shard([(2, [1, 1, 1])], "b")
        query.processAllAvailable()
        assert {tuple(r) for r in spark.table("running").collect()} == {(0, 1, 1, 1, 0), (1, 0, 3, 0, 0), (2, 1, 1, 0, 1)}
    finally:
        query.stop()

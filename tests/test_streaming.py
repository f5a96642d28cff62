"""The stream of pairs against the graph of the whole table."""

import os

import pytest
from pyspark.sql import functions as F

from graphsieve.sources.tables import user_graph
from graphsieve.streaming import pairs

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_union_of_micro_batches_is_the_graph(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id", "event_type", "ts")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    source, path = str(tmp_path / "in"), str(tmp_path / "pairs")
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: pairs.keep_pairs(stream(), path, str(tmp_path / "checkpoint"), "400 days", availableNow=True).awaitTermination()
    third = F.floor((F.unix_timestamp("ts") - F.lit(low.timestamp())) / ((high - low).total_seconds() / 3 + 1))
    for k in range(3):
        events.where((third == k) | ((F.hash("user_id", "ts") % 5 == 0) & (third == (k + 1) % 3))).coalesce(1).write.mode("append").parquet(source)
        if k != 1:
            run()  # the second time two files wait
    events.limit(0).coalesce(1).write.mode("append").parquet(source)
    events.limit(40).withColumn("user_id", F.lit(None).cast("long")).coalesce(1).write.mode("append").parquet(source)
    run()
    got = [(r.a, r.b) for r in pairs.known_pairs(spark, path).collect()]
    want = {(r.a, r.b) for r in user_graph(spark, FOLDER).undirected.collect()}
    assert len(got) == len(set(got)) and set(got) == want
    # a batch that is run again sees only those before it
    assert pairs.known_pairs(spark, path, 0).count() == 0 and pairs.known_pairs(spark, str(tmp_path / "none")) is None


def test_late_users_are_passed_over_and_state_goes(spark, tmp_path):
    rows = [[(1, "a", "2024-01-01 00:01:00"), (2, "a", "2024-01-01 00:02:00")], [(3, "a", "2024-01-01 05:00:00"), (4, "b", "2024-01-01 00:03:00")], [(5, "a", "2024-01-01 00:04:00"), (6, "a", "2024-01-01 05:01:00")]]
    source, path = str(tmp_path / "in"), str(tmp_path / "pairs")
    schema = "user_id long, event_type string, ts timestamp"
    for part in rows:
        spark.createDataFrame(part, "user_id long, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = pairs.keep_pairs(stream, path, str(tmp_path / "checkpoint"), "1 hour", availableNow=True)
        query.awaitTermination()
    assert {(r.a, r.b) for r in pairs.known_pairs(spark, path).collect()} == {(1, 2), (3, 6)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1

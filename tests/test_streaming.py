"""The stream of reports: repeated deliveries, windows, merged states."""

from pyspark.sql import functions as F

from suitelens.streaming import reports as R


def _arrivals(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "test_class string, gen int, fitness double, at timestamp")
    for i, r in enumerate(rows):
        spark.createDataFrame([r], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")


def test_windows_and_repeats(spark, tmp_path):
    import datetime as d

    t = d.datetime(2024, 1, 1, 10, 5)
    rows = [("A", 1, 0.5, t), ("A", 1, 0.5, t), ("B", 1, 0.7, t + d.timedelta(minutes=10)), ("A", 2, 0.6, t + d.timedelta(hours=1))]
    stream = _arrivals(spark, tmp_path, rows)
    out = R.run_to_table(R.windowed(stream, "at", "1 hour", ["gen"], "fitness", "2 hours"), ["start", "gen"], "t")
    assert sorted((r.gen, r.n) for r in out.collect()) == [(1, 3), (2, 1)]
    once = R.deduplicated(stream, ["test_class", "gen"], "at", "2 hours")
    path = f"{tmp_path}/once"
    once.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(path).awaitTermination()
    assert spark.read.parquet(path).count() == 3


def test_states_are_merged(spark, tmp_path):
    merge = R.upsert_states(f"{tmp_path}/s", ["test_class"], "gen")
    schema = "test_class string, gen int"
    merge(spark.createDataFrame([("A", 1), ("B", 1)], schema), 0)
    merge(spark.createDataFrame([("A", 2), ("C", 1)], schema), 1)
    merge(spark.createDataFrame([("A", 1)], schema), 2)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/s/v=2").select("test_class", "gen").collect()) == [("A", 2), ("B", 1), ("C", 1)]

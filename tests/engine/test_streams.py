import datetime

from docloom.operators import merge
from docloom.streaming import streams


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def run(spark, df, name, path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_rate_limit_keeps_state_between_batches(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp"
    for k, part in enumerate(([0, 1, 2], [10, 11, 12])):
        spark.createDataFrame([(10 * k + i, 1, at(s)) for i, s in enumerate(part)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.event_id: r.allowed for r in run(spark, streams.rate_limit_stream(src, [(2, 10.0)]), "limited", tmp_path / "cp").collect()}
    assert got == {0: True, 1: True, 2: False, 10: True, 11: True, 12: False}


def test_merge_by_batch_is_idempotent(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(str(tmp_path / "in"))
    state = {"now": spark.createDataFrame([(1, "old")], "id long, v string"), "runs": 0}

    def apply(batch, _):
        state["now"] = spark.createDataFrame(merge.upsert(state["now"], batch, ["id"]).collect(), "id long, v string")
        state["runs"] += 1

    src = spark.readStream.schema("id long, v string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = streams.stream_merge(src, apply, str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    assert state["runs"] == 1 and sorted(map(tuple, state["now"].collect())) == [(1, "a"), (2, "b")]


def test_copies_within_the_watermark(spark, tmp_path):
    rows = [("x", at(0)), ("x", at(5)), ("y", at(6))]
    spark.createDataFrame(rows, "sha256 string, ts timestamp").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("sha256 string, ts timestamp").parquet(str(tmp_path / "in"))
    assert run(spark, streams.first_in_stream(src, "sha256", "ts", "1 hour"), "firsts", tmp_path / "cp").count() == 2

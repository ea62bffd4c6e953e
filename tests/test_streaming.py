from pyspark.sql import functions as F

from trellisq.streaming import incremental as S


def events(spark, path):
    rows = spark.sql("select id as event_id, timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 7 as int)) as ts, id % 3 as user_id, if(id % 2 = 0, 'a', 'b') as event_type, double(1) as value, '{}' as props from range(100)")
    rows.repartition(4).write.parquet(path)
    return rows


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows_and_sessions(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = events(spark, path)
    stream = S.event_stream(spark, path)
    assert stream.isStreaming
    got = run(S.windowed_counts(stream, late="1 day"), "windows", "complete")
    want = rows.groupBy(F.date_trunc("hour", "ts"), "event_type").count()
    assert sorted(r.n for r in got.collect()) == sorted(r["count"] for r in want.collect()) and got.agg(F.sum("total")).first()[0] == 100
    one = S.sessions(rows.withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes")
    assert {r.user_id: r.n for r in one.collect()} == {0: 34, 1: 33, 2: 33}


def test_incremental_classification(spark, tmp_path):
    src, state, out, cp = (str(tmp_path / x) for x in ("src", "state", "out", "cp"))
    schema = "id long, v string"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = S.classify_batches(spark.readStream.schema(schema).parquet(src), state, ["id"], out, cp)
        q.awaitTermination(120)

    feed([(1, "a"), (2, "b")])
    feed([(1, "a"), (2, "B"), (3, "c")])
    got = {(r.batch, r.id): r.state for r in spark.read.parquet(out).collect()}
    assert got == {(0, 1): "new", (0, 2): "new", (1, 1): "unchanged", (1, 2): "changed", (1, 3): "new"}

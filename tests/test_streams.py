"""Streaming twins: late rows, several batches, and equality with the batch form."""

from datetime import datetime, timedelta

from framesift.plans import load_all
from framesift.session import workspace
from framesift.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_tracker_equals_batch(spark):
    q = load_all()
    batch = q["c41_face_track"].build(spark, SF)
    ids = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts")
    from framesift.plans.fixtures import series

    keyed = series(spark, SF).select("clip_id", "t", "event_id")
    a = {r["event_id"]: r["valid"] for r in batch.join(keyed, ["clip_id", "t"]).select("event_id", "valid").collect()}
    b = {r["event_id"]: r["valid"] for r in q["t4_continuity"].build(spark, SF).collect()}
    assert a == b and len(a) == ids.count()


def test_late_rows_are_dropped(spark):
    path = workspace(spark, "late")
    t0 = datetime(2024, 1, 1)

    def put(name, rows):
        df = spark.createDataFrame([(k, t0 + timedelta(minutes=m), i, v) for i, (k, m, v) in enumerate(rows)], "k string, ts timestamp, id long, value double")
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    put("in/n=0", [("a", 1, 1.0), ("a", 200, 2.0)])
    schema = "k string, ts timestamp, id long, value double"
    stream = spark.readStream.schema(schema).parquet(f"{path}/in").withWatermark("ts", "10 minutes")
    out = J.blocks(stream, "k", "60 minutes", "value", "id")
    sink = f"{path}/out"

    def go():
        q = (out.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{path}/cp")
             .foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(f"{sink}/batch={i}")).start())
        q.awaitTermination()

    go()
    put("in/n=1", [("a", 2, 9.0), ("a", 210, 3.0)])  # minute 2 is behind the watermark now
    go()
    rows = J.latest(spark.read.parquet(sink), ["k", "start"]).orderBy("start").collect()
    assert [(r["value"], r["skipped"]) for r in rows] == [(1.0, 0), (2.0, 1)]


def test_registry_over_several_batches(spark):
    path = workspace(spark, "points")
    for i in range(3):
        spark.createDataFrame([("x", [1.0, float(i)])], "k string, v array<double>").coalesce(1).write.parquet(f"{path}/n={i}")
    stream = spark.readStream.schema("k string, v array<double>").option("maxFilesPerTrigger", 1).parquet(path)
    row = J.registry_stream(stream.select("k", "v"), "k", "v", 2).first()
    assert (row["n"], list(row["s"])) == (3, [3.0, 3.0])


def test_table_as_file_or_folder(spark):
    """Both kinds of a table's path arrive whole, also when the folder holds several files."""
    path = workspace(spark, "tables")
    rows = spark.range(10).selectExpr("id AS vec_id", "CAST(id % 2 AS INT) AS label")
    rows.repartition(3).write.parquet(f"{path}/embeddings.parquet")
    folder = J.run_to_end(J.table_stream(spark, path, "embeddings"), "points", "append")
    assert sorted(r["vec_id"] for r in folder.collect()) == list(range(10))
    file = J.run_to_end(J.table_stream(spark, SF, "labels"), "points", "append")
    assert file.count() == spark.read.parquet(f"{SF}/labels.parquet").count()

"""The change feed as a stream, and lookups of ids in the store."""

from pyspark.sql import functions as F

from tidepool.operators import temporal
from tidepool.store import Store
from tidepool.streaming import changes

SCHEMA = "id long, entity_type string, updated_at long, ts timestamp"


def test_replayed_files_give_each_change_once(spark, tmp_path):
    rows = [(k % 40, ["a", "b", None][k % 3], 1_700_000_000_000 + k * 1000) for k in range(300)]

    def write(part):
        frame = spark.createDataFrame(part, "id long, entity_type string, updated_at long")
        frame.withColumn("ts", F.timestamp_millis("updated_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        made = changes.change_feed(stream, 1_700_000_050_000, "a", "5 minutes")
        query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    for part in (rows[:150], rows[100:200], rows):
        write(part)
    run()
    got = [(r.id, r.updated_at) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    entities = spark.createDataFrame(rows, "id long, entity_type string, updated_at long")
    want = {(r.id, r.updated_at) for r in temporal.changes_since(entities, 1_700_000_050_000, 1000, "a").collect()}
    assert len(got) == len(set(got)) and set(got) == want
    write([(1, "a", 1_700_009_000_000)])
    run()
    write([(2, "a", 1_700_000_060_000)])
    write([(3, "a", 1_700_009_000_001)])
    assert changes.late_rows(run()) == 1
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out")).where("updated_at > 1700000900000").collect()} == {1, 3}


def test_a_lookup_of_an_absent_id_reads_no_row(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), None, lambda: 1)
    rows = spark.range(20_000).selectExpr("concat('id', id) AS id", "'text' AS content")
    store.append("memories", rows)

    def read(own):
        frame = store.table("memories").where(F.col("id") == own)
        plan = frame._jdf.queryExecution().executedPlan()
        found = [tuple(r) for r in frame.collect()]
        scan = plan.collectLeaves().head()
        return len(found), scan.metrics().apply("numOutputRows").value()

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert read("id77")[0] == 1
        assert read("id777777") == (0, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

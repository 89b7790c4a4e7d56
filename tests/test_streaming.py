from pyspark.sql import functions as F

from vicinage.plans.fixtures import view
from vicinage.streaming import captures


def stream(spark, small, tmp_path):
    raw = view(spark, small, "raw_capture").where("captured_ms is not null").withColumn("captured_at", F.timestamp_millis("captured_ms"))
    raw.repartitionByRange(4, "captured_ms").write.parquet(f"{tmp_path}/in")
    return raw, captures.read(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_each_id_once(spark, small, tmp_path):
    raw, s = stream(spark, small, tmp_path)
    got = run(captures.first_arrivals(s, late="3650 days"), "once")
    want = raw.where("raw_id <> ''").select("qid", "raw_id").distinct().count()
    assert got.count() == want == got.select("qid", "raw_id").distinct().count()


def test_windows(spark, small, tmp_path):
    raw, s = stream(spark, small, tmp_path)
    got = run(captures.counts(s, "1 hour", late="30 days"), "per_window")
    assert got.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= raw.count()
    assert got.where("n_oriented > n").count() == 0

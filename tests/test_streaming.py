
import numpy as np
from pyspark.sql import functions as F

from driftwell.streaming import pipelines as P


def drain(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_windows_and_sessions_equal_batch(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    batch = spark.read.parquet(f"{data}/events.parquet")
    (tmp_path / "in").mkdir()
    import shutil

    shutil.copy(f"{data}/events.parquet", tmp_path / "in/a.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = drain(P.windowed(stream, time="ts", keys=["event_type"], value="value", length="1 hour"), spark, "w1").agg(F.sum("n"), F.count("*")).first()
    want = batch.groupBy(F.window("ts", "1 hour"), "event_type").count().agg(F.sum("count"), F.count("*")).first()
    # Windows that the watermark has not passed are not out yet.
    assert 0.8 * want[0] < got[0] <= want[0] and got[1] <= want[1]
    slide = drain(P.windowed(stream, time="ts", keys=[], value="value", length="2 hours", step="1 hour"), spark, "w2")
    assert slide.count() > 0
    s = drain(P.sessions(stream, time="ts", keys=["user_id"], gap="10 minutes"), spark, "s1")
    assert s.agg(F.sum("n")).first()[0] > 0.8 * batch.count()


def test_segments_fill_across_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in range(3):
        i = np.arange(part * 50, part * 50 + 50)
        spark.createDataFrame([("a", float(k) / 100, float(np.sin(2 * np.pi * k / 8))) for k in i], "ch string, t double, v double").coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema("ch string, t double, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = drain(P.segment_features(stream, key="ch", time="t", value="v", n=64), spark, "seg").orderBy("t0").collect()
    assert [round(r["t0"], 2) for r in got] == [0.0, 0.64]
    assert all(abs(r["freq"] - 12.5) < 0.5 and abs(r["rms"] - 0.7071) < 0.01 for r in got)

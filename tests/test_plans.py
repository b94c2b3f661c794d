"""What the plans of queries read and keep."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from marlstone.plans import loads, registry
from marlstone.streaming import campaigns

SF = "/root/testdata/sf0.001"
NOW = 826848000


def test_scd2_reads_stored_snapshots(spark):
    text = io.StringIO()
    df = registry.QUERIES["wh04_scd2"](spark, SF)
    with redirect_stdout(text):
        df.explain()
    assert "lineitem" not in text.getvalue()


def test_campaigns_are_kept_not_notifications(spark, monkeypatch):
    seen = []
    real = campaigns.fan_out
    monkeypatch.setattr(campaigns, "fan_out", lambda *w: real(lambda df, i: seen.append(df.columns), *w))
    assert loads.QUERIES["stm04_campaign_stream"](spark, SF).count()
    assert seen and all("client_id" not in c for c in seen)


def test_notifications_of_a_restaurant_are_dealt_to_tasks(spark, monkeypatch):
    """Few campaigns and few subscribers give many rows; a client that is null or stands twice is kept as it stands."""
    monkeypatch.setattr(campaigns, "PART", 40)
    c = spark.range(400).select(F.lit("r").alias("restaurant_id"), F.col("id").cast("string").alias("adv_campaign_id"), *(F.lit("x").alias(x) for x in campaigns.OUTPUT[2:5]), *(F.lit(NOW + x).cast("bigint").alias(y) for x, y in zip((-1, 1, -1), campaigns.OUTPUT[5:8], strict=True)))
    subs = spark.range(500).select(F.when(F.col("id") > 0, (F.col("id") % 480).cast("string")).alias("client_id"), F.when(F.col("id") < 490, "r").otherwise("none").alias("restaurant_id"))
    got = campaigns.notifications(c, subs, F.lit(NOW))
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 400 * 490 and len(parts) == 4 and max(parts) < 400 * 490 / 2
    want = c.crossJoin(subs.where("restaurant_id = 'r'").select("client_id"))
    key = ["adv_campaign_id", "client_id"]
    assert not got.select(key).exceptAll(want.select(key)).count() and not want.select(key).exceptAll(got.select(key)).count()

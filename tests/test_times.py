from datetime import datetime

from sievelight.plans import telemetry


def test_windows_of_a_minute_count_rounded_milliseconds(spark, tmp_path):
    at = [datetime(2024, 1, 1, 0, 0, 0, 600), datetime(2024, 1, 1, 0, 1, 0, 400)]  # 60,000 ms apart cut off, 59,999 rounded
    rows = [(i, t, 1, "view", 1.0) for i, t in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id: r.rate for r in telemetry.parts_per_minute(spark, str(tmp_path)).collect()} == {0: 1.0, 1: 2.0}

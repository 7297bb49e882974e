"""Running densities over arriving files."""

import datetime as dt

from drillspectra.streaming import lines


def test_closed_windows_are_appended_once_and_late_rows_refused(spark, tmp_path):
    shape = "ts timestamp, sample int, value double"
    day = lambda d, h: dt.datetime(2024, 5, d, h, tzinfo=dt.timezone.utc)

    def arrive(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
        lines.append_closed(lines.running_density(stream, "ts", "sample", 20.0), f"{tmp_path}/out", f"{tmp_path}/state")
        rows = spark.read.parquet(f"{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
        return sorted((r["start"].day, r["sample"], r["events"], r["hits"]) for r in rows)

    arrive([(day(1, 3), 1, 5.0), (day(1, 9), 1, 50.0), (day(1, 9), 2, 1.0), (day(2, 1), 1, 2.0)])
    assert run() == []  # day 1 ends within the allowed two hours of the newest row
    arrive([(day(1, 23), 1, 3.0), (day(2, 5), 2, 30.0)])
    assert run() == [(1, 1, 3, 2), (1, 2, 1, 1)]
    arrive([(day(1, 22), 2, 1.0), (day(4, 0), 1, 9.0)])  # too late for day 1
    assert run() == [(1, 1, 3, 2), (1, 2, 1, 1), (2, 1, 1, 1), (2, 2, 1, 0)]

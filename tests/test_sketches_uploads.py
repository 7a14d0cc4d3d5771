"""Kept sketches, uploads taken once and the running overview."""

import shutil

from pyspark.sql import functions as F

from custspark.operators import audit, sketches
from custspark.sources import io
from custspark.sources.adapters import audit_logs
from custspark.sources.tables import Tables
from custspark.streaming import audit_stream, upload_stream

from .conftest import SF_SMALL


def test_merged_sketches_equal_the_sketch_of_the_whole(spark, tmp_path):
    df = spark.range(60_000).select((F.col("id") % 3).alias("day"), (F.col("id") % 20_011).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") % 7).alias("b"))
    sets = [["a"], ["b"], ["a", "b"]]
    whole = {r["subset"]: r for r in sketches.merged_counts(sketches.column_sketches(df, sets)).collect()}
    path = str(tmp_path / "kept")
    for day in (0, 1, 2, 1):  # a day that comes again is replaced
        sketches.keep(sketches.column_sketches(df.where(F.col("day") == day), sets, ["day"]), path, "day")
    merged = {r["subset"]: r for r in sketches.merged_counts(sketches.kept(spark, path)).collect()}
    exact = {"a": 20_011, "b": 7, "a+b": df.select("a", "b").distinct().count()}
    for s, n in exact.items():
        assert merged[s] == whole[s] and merged[s]["rows"] == 60_000
        assert abs(merged[s]["distinct_values"] - n) <= sketches.error_bound() * n
    assert merged["b"]["distinct_values"] == 7  # nulls are no values of a column
    by_day = sketches.merged_counts(sketches.kept(spark, path), ["day"])
    assert by_day.count() == 9 and {r["rows"] for r in by_day.collect()} == {20_000}
    assert sketches.merged_counts(sketches.column_sketches(df.where("false"), sets, ["day"])).count() == 0


def test_tuples_with_nulls_are_values(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 1), (None, None)], "a int, b int")
    row = sketches.merged_counts(sketches.column_sketches(df, [["a", "b"]])).first()
    assert (row["rows"], row["distinct_values"], row["duplicates"]) == (4, 3, 1)


SCHEMA = "id long, name string"


def test_a_file_that_lands_again_adds_nothing(spark, tmp_path):
    landing, table, ckpt = (str(tmp_path / d) for d in ("landing", "table", "ckpt"))
    spark.range(50).selectExpr("id", "concat('n', id) as name").coalesce(1).write.csv(f"{landing}/one")
    shutil.copytree(f"{landing}/one", f"{landing}/copy")
    run = lambda: upload_stream.start_uploads(spark, landing, table, ckpt, SCHEMA).awaitTermination()
    rows = lambda: sorted(r["id"] for r in spark.read.parquet(table).collect())
    run()
    assert rows() == list(range(50))
    shutil.copytree(f"{landing}/one", f"{landing}/later")  # after a restart, beside a new file
    spark.range(50, 60).selectExpr("id", "concat('n', id) as name").coalesce(1).write.csv(f"{landing}/two")
    run()
    assert rows() == list(range(60))
    run()
    assert rows() == list(range(60))


def test_overview_follows_the_log(spark, tmp_path):
    events = audit_logs(Tables(spark, SF_SMALL))
    landing, table, ckpt = (str(tmp_path / d) for d in ("landing", "table", "ckpt"))
    part = F.pmod(F.xxhash64("timestamp", "user_email"), F.lit(3))
    for k in range(3):
        io.write_json(events.where(part == k), f"{landing}/{k}")
        stream = audit_stream.audit_events_stream(spark, landing + "/*")
        upload_stream.start_overview(stream, table, ckpt, lateness="10000 days").awaitTermination()
        so_far = events.where((part <= k) & F.col("organization_id").isNotNull())
        got = {r["organization_id"]: tuple(r)[1:] for r in upload_stream.read_overview(spark, table).collect()}
        for org in {r["organization_id"] for r in so_far.select("organization_id").distinct().collect()}:
            assert got[org] == tuple(audit.audit_overview(so_far.where(F.col("organization_id") == org)).first())
    compact = str(tmp_path / "compact")
    upload_stream.compact_overview(spark, table, compact)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(upload_stream.read_overview(spark, compact)) == key(upload_stream.read_overview(spark, table))

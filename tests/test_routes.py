"""Routes over tables and over streams with restart, other orders and late rows."""

import datetime
import random

import pytest

from geoquill.streaming import routes as module
from geoquill.streaming.routes import routes

SCHEMA = "user string, at timestamp, id long, lat double, lon double"
START = datetime.datetime(2024, 1, 1)


def rows(count, seed, minutes, first=0):
    rng = random.Random(seed)
    return [(rng.choice("abc"), START + datetime.timedelta(minutes=minutes + rng.uniform(0, 50)), first + k, rng.uniform(54, 58), rng.uniform(8, 16)) for k in range(count)]


def test_routes_of_a_stream_with_restart_and_late_rows(spark, tmp_path):
    spark.conf.set(module.PROVIDER, module.ROCKS)
    try:
        source = tmp_path / "in"
        put = lambda data, name: spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(source / name))
        one, two = rows(30, 1, 0), rows(30, 2, 40, 100)  # the second overlaps the first by ten minutes
        late = [("a", START - datetime.timedelta(days=1), 999, 55.0, 9.0)]
        far = [("z", START + datetime.timedelta(days=2), 1000, 55.0, 9.0), ("z", START + datetime.timedelta(days=2), 1001, None, 9.0)]

        def run():
            stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(source))
            query = routes(stream, "user", "at", late="1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()

        put(one, "one")
        run()
        put(two, "two")
        run()  # goes on from the checkpoint
        put(far, "far")
        run()
        put(late, "late")
        run()
        got = {r["id"]: (r["user"], r["leg"], r["metres"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        want = {r["id"]: (r["user"], r["leg"], r["metres"], r["n"]) for r in routes(spark.createDataFrame(one + two, SCHEMA), "user", "at").collect()}
        assert set(got) == set(want)  # neither the late row, nor the one that still waits
        for k, v in want.items():
            assert got[k][0] == v[0] and got[k][3] == v[3] and got[k][1:3] == pytest.approx(v[1:3], abs=1e-5)
    finally:
        spark.conf.unset(module.PROVIDER)


def test_routes_begin_anew_after_a_gap(spark, tmp_path):
    spark.conf.set(module.PROVIDER, module.ROCKS)
    try:
        at = lambda hours: START + datetime.timedelta(hours=hours)
        batches = [[("q", at(0), 1, 55.0, 12.0), ("q", at(1), 2, 55.1, 12.0), ("q", at(9), 3, 55.2, 12.0)], [("z", at(30), 4, 55.0, 12.0)], [("q", at(31), 5, 55.3, 12.0), ("q", at(32), 6, 55.4, 12.0)], [("z", at(60), 7, 55.0, 12.0)], [("z", at(90), 8, 55.0, 12.0)]]
        for k, batch in enumerate(batches):
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
            stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            query = routes(stream, "user", "at", idle="3 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
        got = {r["id"]: (round(r["leg"], 3), round(r["metres"], 3), r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        want = {r["id"]: (round(r["leg"], 3), round(r["metres"], 3), r["n"]) for r in routes(spark.createDataFrame(sum(batches, []), SCHEMA), "user", "at", idle="3 hours").collect()}
        assert {k: v[2] for k, v in want.items()} == {1: 1, 2: 2, 3: 1, 5: 1, 6: 2, 4: 1, 7: 1, 8: 1} and want[6][0] == want[6][1] > 0
        assert got == {k: v for k, v in want.items() if k != 8}
    finally:
        spark.conf.unset(module.PROVIDER)


def test_routes_of_tables(spark):
    data = [("a", START, 1, 55.0, 12.0), ("a", START, 2, 55.0, 12.0), ("a", START + datetime.timedelta(hours=1), 0, 49.0, 2.0), (None, START, 5, 1.0, 1.0), ("b", None, 6, 1.0, 1.0), ("b", START, 7, None, 1.0), ("c", START, 8, float("nan"), 1.0), ("d", START, 9, 1.0, 2.0)]
    got = sorted((r["user"], r["id"], round(r["leg"], 4), round(r["metres"], 4), r["n"]) for r in routes(spark.createDataFrame(data, SCHEMA), "user", "at").collect())
    assert got == [("a", 0, 956066.232, 956066.232, 3), ("a", 1, 0.0, 0.0, 1), ("a", 2, 0.0, 0.0, 2), ("d", 9, 0.0, 0.0, 1)]
    assert routes(spark.createDataFrame([], SCHEMA), "user", "at").collect() == []
    with pytest.raises(ValueError):
        routes(spark.readStream.format("rate").load().selectExpr("'a' AS user", "timestamp AS at", "value AS id", "1D AS lat", "2D AS lon"), "user", "at")

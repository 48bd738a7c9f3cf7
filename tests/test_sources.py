"""SRC3 JDBC options (nothing connects), SNK1 JSON rows, SNK2 versioned snapshots."""

import json
import uuid

from ridegrid.session import ensure_checkpoint_dir
from ridegrid.sources import jdbc
from ridegrid.sources.sinks import drop_snapshots, newest_version, read_snapshot, to_json_rows, write_snapshot


def test_jdbc_options_partition_on_the_table_key():
    opts = jdbc.jdbc_options("jdbc:mysql://db:3306/rental", "trips", user="r", password="x",
                             num_partitions=16, bounds=(1, 1_000_000))
    assert opts["dbtable"] == "Trips" and opts["partitionColumn"] == "TripID"
    assert (opts["lowerBound"], opts["upperBound"], opts["numPartitions"]) == ("1", "1000000", "16")
    plain = jdbc.jdbc_options("jdbc:mysql://db/rental", "users")
    assert "partitionColumn" not in plain and plain["dbtable"] == "Users"


def test_json_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "TripID int, Status string")
    rows = sorted(json.loads(r.json)["TripID"] for r in to_json_rows(df).collect())
    assert rows == [1, 2]
    assert {"TripID": 2, "Status": None} in [json.loads(r.json) for r in to_json_rows(df).collect()]


def test_loader_checks_declared_columns(td):
    import pytest

    assert set(td.tables()) == {"membership_plans", "users", "stations", "vehicles", "trips", "payments", "technicians",
                                "maintenance_logs", "technician_assignments", "reviews", "logs"}
    td.stations_ok = td.stations
    td.stations = lambda: td.stations_ok().drop("Capacity")
    try:
        with pytest.raises(TypeError, match="stations"):
            td.tables()
    finally:
        del td.stations


def test_cluster_needs_a_shared_folder():
    """Without a configured folder only a local master gets one of its own."""
    import pytest

    from ridegrid import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_snapshot_versions_are_idempotent(spark):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-snap-{uuid.uuid4().hex}"
    v0 = spark.createDataFrame([(1, "a")], "k int, v string")
    v1 = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    write_snapshot(v0, path, 0)
    write_snapshot(v1, path, 1)
    write_snapshot(v1, path, 1)  # a retried step rewrites only its own version
    assert sorted(tuple(r) for r in read_snapshot(spark.read, path).collect()) == [(1, "b"), (2, "c")]
    assert [tuple(r) for r in read_snapshot(spark.read, path, 0).collect()] == [(1, "a")]
    assert newest_version(spark.read, path) == 1 and newest_version(spark.read, path, 1) == 0
    drop_snapshots(spark, path, 1)
    assert spark.read.parquet(path).select("_version").distinct().count() == 1


def test_cleanup_removes_intermediate_folders(spark):
    from ridegrid.session import cleanup, materialize

    df = materialize(spark.range(3), "test")
    path = df.inputFiles()[0]
    assert df.count() == 3 and cleanup(spark) >= 1
    import os
    assert not os.path.exists(path.removeprefix("file:").replace("//", "/"))

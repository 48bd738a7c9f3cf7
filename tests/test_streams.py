"""Stream = batch, with redelivery and with a restart from the checkpoint."""

import uuid

from ridegrid.operators import commands as C
from ridegrid.session import ensure_checkpoint_dir
from ridegrid.streaming import streams as S


def test_topup_stream_equals_batch_and_restart_changes_nothing(spark, td):
    batch = {r.UserID: r.WalletBalance for r in C.wallet_topups(td.topup_requests(), td.users()).tables["users"].collect()}
    work = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-topups-{uuid.uuid4().hex}"
    first = {r.UserID: r.WalletBalance for r in S.stream_topups(spark, td.topup_requests(), td.users(), workdir=work).collect()}
    assert first == batch
    versions = spark.read.parquet(f"{work}/state/users").select("_version").distinct().count()
    assert versions <= 2  # older states are gone
    again = {r.UserID: r.WalletBalance for r in S.stream_topups(spark, td.topup_requests(), td.users(), work, []).collect()}
    assert again == batch
    resent = S.stream_topups(spark, td.topup_requests(), td.users(), work, [td.topup_requests().limit(40)])
    again = {r.UserID: r.WalletBalance for r in resent.collect()}
    assert again == batch
    assert spark.read.parquet(f"{work}/state/users").select("_version").distinct().count() <= 2


def test_redelivered_topups_change_nothing(spark, td):
    requests = td.topup_requests()
    batch = {r.UserID: r.WalletBalance for r in C.wallet_topups(requests, td.users()).tables["users"].collect()}
    twice = requests.union(requests.where("RequestID % 4 = 1"))
    streamed = {r.UserID: r.WalletBalance for r in S.stream_topups(spark, twice.repartition(6), td.users()).collect()}
    assert streamed == batch


def test_topups_of_any_age_are_applied_once(spark, td):
    """Events over several years in shuffled files, some redelivered in a later batch."""
    from pyspark.sql import functions as F

    requests = td.topup_requests()
    batch = {r.UserID: r.WalletBalance for r in C.wallet_topups(requests, td.users()).tables["users"].collect()}
    years = F.expr("RequestTime + make_dt_interval(cast(pmod(hash(RequestID), 1500) as int))")
    spread = requests.withColumn("RequestTime", years.cast(requests.schema["RequestTime"].dataType))
    work = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-ages-{uuid.uuid4().hex}"
    arrivals = [spread.repartition(9, F.rand(3)), spread.where("RequestID % 5 = 0")]
    streamed = {r.UserID: r.WalletBalance for r in S.stream_topups(spark, requests, td.users(), work, arrivals).collect()}
    assert streamed == batch


def test_vehicle_state_does_not_depend_on_delivery(spark, td):
    """Shuffled files, repeated events and one event per batch give the batch state."""
    from pyspark.sql import functions as F

    from ridegrid.plans.q_streams import decided_vehicle_events

    events = S.vehicle_events(td.vehicles(), decided_vehicle_events(td)).cache()
    expected = sorted(tuple(r) for r in S.current_state(S.vehicle_state(events)).collect())
    mixed = events.union(events.where("RequestID % 3 = 0")).repartition(7, F.rand(5))
    assert sorted(map(tuple, S.stream_vehicle_state(spark, mixed, 1).collect())) == expected


def test_late_event_is_applied_in_event_time(spark):
    rows = [(1, -1, "1900-01-01", "snapshot", 3, "available"), (1, 9, "2024-01-02", "report", None, None),
            (1, 5, "2024-01-01", "end", 7, None)]
    df = spark.createDataFrame(rows, "VehicleID int, RequestID long, RequestTime string, Kind string, StationID int, Status string")
    df = df.withColumn("RequestTime", df.RequestTime.cast("timestamp_ntz"))
    state = S.stream_vehicle_state(spark, df.repartition(3, "RequestID"), 1).collect()
    assert [tuple(r) for r in state] == [(1, "under-maintenance", 7)]


def test_failed_stream_raises(spark, td):
    import pytest

    def broken(batch, now):
        raise ValueError("broken batch")

    with pytest.raises(Exception, match="broken batch"):
        S.stream_commands(spark, [td.topup_requests()], {"users": td.users()}, broken)


def test_audit_stream_equals_batch_messages(spark, td):
    from ridegrid.operators import audit as A
    changes = C.cancel_trips(td.cancel_requests(), td.trips(), td.vehicles(), td.users(), td.payments()).changes
    streamed = sorted(tuple(r) for r in S.stream_audit(spark, changes).select(
        "RequestID", "Step", "Sub", "ChangeDescription").collect())
    batch = sorted(tuple(r) for r in A.audit_messages(changes).select(
        "RequestID", "Step", "Sub", "ChangeDescription").collect())
    assert streamed == batch and len(batch) > 0

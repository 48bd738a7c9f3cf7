"""Plan checks for scale: no cartesian products or nested-loop joins, and scans that read only the needed columns with pushed filters."""

import __spark_entry__ as entry_mod

VIEW_KEYS = ["station_availability", "vehicle_details", "trip_history", "technician_assignments", "user_profiles",
             "assignment_status", "vehicles_at_station", "user_rides", "reports_with_ongoing_trip", "active_trip",
             "dashboard_kpis", "ride_counts_by_user", "recent_logs", "booking_quotes", "affordable_plans",
             "wallet_topups", "cancel_trips", "end_rides", "dq_fk", "dq_pk"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_unbounded_nested_loops(spark):
    qs = entry_mod.queries()
    for key in VIEW_KEYS:
        plan = _plan(qs[key](spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in plan, key
        assert "BroadcastNestedLoopJoin" not in plan, key


def test_many_plans_are_joined_by_rank(spark):
    """100,000 plans: an equi join on the rank, and the pairs of the definition."""
    from pyspark.sql import functions as F

    from ridegrid.operators.views import affordable_plans

    plans = spark.range(100_000).select(
        F.col("id").cast("int").alias("PlanID"), F.lit("p").alias("PlanName"), ((F.col("id") * 7919) % 50_000).cast("decimal(10,2)").alias("Cost"))
    users = spark.createDataFrame([(1, None), (2, "-1.00"), (3, "0.00"), (4, "17.00"), (5, "17.00"), (6, "2999.50")], "UserID int, b string").select(
        "UserID", F.col("b").cast("decimal(10,2)").alias("WalletBalance"))
    got = affordable_plans(users, plans)
    assert "NestedLoop" not in _plan(got) and "Cartesian" not in _plan(got)
    assert {r.UserID: (r.n, r.most) for r in got.groupBy("UserID").agg(F.count("*").alias("n"), F.max("PlanCost").cast("int").alias("most")).collect()} == {
        3: (2, 0), 4: (36, 17), 5: (36, 17), 6: (6000, 2999)}


def test_events_scan_is_pruned_and_filtered(spark):
    df = entry_mod.queries()["wallet_topups"](spark, "/root/testdata/sf0.001")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan
    events_scans = [seg for seg in plan.split("FileScan") if "events.parquet" in seg]
    assert events_scans and all("props" not in seg.split("ReadSchema:")[1].split("\n")[0] for seg in events_scans)


def test_counts_are_pre_aggregated_before_the_station_join(spark):
    plan = _plan(entry_mod.queries()["station_availability"](spark, "/root/testdata/sf0.001"))
    join_at = plan.find("Join")
    assert "partial_count" in plan[join_at:]  # the aggregate sits below the join

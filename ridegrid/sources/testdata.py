"""Typed rental tables and request feeds derived from the driver's test tables.

The driver provides TPC-H-like parquet tables.  This adapter is a set of
column projections over them (the mapping is documented in FIXTURES.md and the
DuckDB oracle uses the same mapping in SQL).  Everything stays lazy: each
function returns a DataFrame whose plan starts at a parquet scan, so filters
and column pruning reach the files.  Row counts of other tables enter as
scalar subqueries (planned once, no driver round trip).

Ids start at 1 (the source keys start at 0) because the rental model treats id
0 as "missing".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridegrid.schemas import MONEY, RATE, SCHEMAS
from ridegrid.sources.seed import membership_plans

# Declared source columns: no schema is inferred from the files.
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


class TestData:
    """Lazy accessor for the adapter tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._counts: dict[str, int] = {}

    # -- raw source tables -------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def _count(self, name: str, plus: int = 0) -> Column:
        """Row count of a source table (read from the file footers, once per instance) as a literal.

        As a scalar subquery it would be planned again in every feed and every reference that uses it.
        """
        if name not in self._counts:
            self._counts[name] = self.raw(name).count()
        return F.lit(self._counts[name] + plus).cast("bigint")

    def _events(self, event_type: str) -> DataFrame:
        return self.raw("events").where(F.col("event_type") == event_type)

    # -- rental tables -----------------------------------------------------
    def membership_plans(self) -> DataFrame:
        return membership_plans(self.spark)

    def stations(self) -> DataFrame:
        sup = self.raw("supplier")
        nat = self.raw("nation")
        key = F.col("s_suppkey")
        return sup.join(nat, sup.s_nationkey == nat.n_nationkey).select(
            (key + 1).cast("int").alias("StationID"),
            F.col("s_name").alias("Name"),
            F.col("n_name").alias("Location"),
            (F.lit(15) + key % 16).cast("int").alias("Capacity"),
            (key % 10 != 4).alias("IsActive"),
        )

    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            (key + 1).cast("int").alias("UserID"),
            F.col("c_name").alias("Name"),
            F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com")).alias("Email"),
            F.col("c_name").alias("Password"),
            F.when(key % 50 == 0, "admin").otherwise("user").alias("Role"),
            F.col("c_acctbal").cast(MONEY).alias("WalletBalance"),
            F.date_add(F.lit("1995-01-01").cast("date"), (key % 365).cast("int")).alias("JoinDate"),
            F.when(F.col("c_mktsegment") == "BUILDING", 1)
            .when(F.col("c_mktsegment") == "AUTOMOBILE", 2)
            .when(F.col("c_mktsegment") == "MACHINERY", 3)
            .cast("int")
            .alias("PlanID"),
        )

    def vehicles(self) -> DataFrame:
        key = F.col("p_partkey")
        station = F.lit(1) + (key * 7 + F.floor(key / 11).cast("bigint")) % self._count("supplier", -1)
        return self.raw("part").select(
            (key + 1).cast("int").alias("VehicleID"),
            F.concat(F.lit("KA-"), F.lpad(key.cast("string"), 8, "0")).alias("RegistrationNumber"),
            F.col("p_type").alias("Type"),
            F.col("p_name").alias("Model"),
            F.col("p_brand").alias("Manufacturer"),
            F.col("p_retailprice").cast(MONEY).alias("RatePerHour"),
            F.when(key % 10 < 6, "available")
            .when(key % 10 < 8, "in-use")
            .when(key % 10 == 8, "under-maintenance")
            .otherwise("decommissioned")
            .alias("Status"),
            F.when(key % 17 != 0, station.cast("int")).alias("CurrentStationID"),
        )

    def trips(self) -> DataFrame:
        key = F.col("o_orderkey")
        status = F.col("o_orderstatus")
        n_sup = self._count("supplier")

        def plus_hours(n: Column) -> Column:
            return F.col("o_orderdate") + F.make_dt_interval(hours=n.cast("int"))

        return self.raw("orders").select(
            (key + 1).cast("int").alias("TripID"),
            (F.col("o_custkey") + 1).cast("int").alias("UserID"),
            (F.lit(1) + key % self._count("part")).cast("int").alias("VehicleID"),
            (F.lit(1) + key % n_sup).cast("int").alias("StartStationID"),
            F.when(status == "F", (F.lit(1) + (key * 3) % n_sup).cast("int")).alias("EndStationID"),
            plus_hours(key % 24).alias("StartTime"),
            F.when(~((status == "P") & (key % 2 == 1)), plus_hours(key % 24 + 1 + key % 8)).alias("EndTime"),
            F.col("o_totalprice").cast(MONEY).alias("Cost"),
            F.when(status == "F", "Completed")
            .when(status == "O", "Ongoing")
            .when(key % 2 == 0, "Cancelled")
            .otherwise("Upcoming")
            .alias("Status"),
        )

    def payments(self) -> DataFrame:
        return self.trips().where(F.col("Status") != "Upcoming").select(
            F.col("TripID").alias("PaymentID"),
            "TripID",
            "UserID",
            F.col("Cost").alias("Amount"),
            F.col("StartTime").alias("Timestamp"),
            F.when(F.col("Status") == "Cancelled", "Refunded").otherwise("Success").alias("Status"),
        )

    def technicians(self) -> DataFrame:
        nat = self.raw("nation")
        reg = self.raw("region")
        key = F.col("n_nationkey")
        return nat.join(reg, nat.n_regionkey == reg.r_regionkey).select(
            (key + 1).cast("int").alias("TechnicianID"),
            F.col("n_name").alias("Name"),
            F.col("r_name").alias("Specialization"),
            (key % 4 != 3).alias("IsAvailable"),
            (key % 5).cast("int").alias("ActiveAssignments"),
        )

    def maintenance_logs(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("error").select(
            (key + 1).cast("int").alias("LogID"),
            (F.lit(1) + key % self._count("part")).cast("int").alias("VehicleID"),
            F.concat(F.lit("fault "), F.col("props")).alias("IssueReported"),
            F.col("ts").cast("date").alias("ReportedDate"),
            F.when(key % 3 == 0, "Pending").when(key % 3 == 1, "In-Progress").otherwise("Completed").alias("Status"),
        )

    def technician_assignments(self) -> DataFrame:
        return self.maintenance_logs().where(F.col("Status") != "Pending").select(
            F.col("LogID").alias("AssignmentID"),
            "LogID",
            (F.lit(1) + F.col("LogID") % 20).cast("int").alias("TechnicianID"),
        )

    def reviews(self) -> DataFrame:
        return self.trips().where((F.col("Status") == "Completed") & (F.col("TripID") % 3 == 0)).select(
            F.col("TripID").alias("ReviewID"),
            "TripID",
            "UserID",
            "VehicleID",
            (F.lit(1) + F.col("TripID") % 5).cast("int").alias("Rating"),
            F.lit("").alias("Comment"),
            F.col("EndTime").cast("date").alias("ReviewDate"),
        )

    def logs(self) -> DataFrame:
        key = F.col("event_id")
        et = F.col("event_type")
        return self.raw("events").select(
            (key + 1).cast("int").alias("LogID"),
            F.when(et == "purchase", "Trips")
            .when(et == "click", "Payments")
            .when(et == "view", "Vehicles")
            .when(et == "error", "MaintenanceLogs")
            .otherwise("Users")
            .alias("TableName"),
            F.when(key % 3 == 0, "INSERT").otherwise("UPDATE").alias("OperationType"),
            (F.col("user_id") + 1).cast("int").alias("RecordID"),
            F.lit(None).cast("int").alias("ChangedBy"),
            F.col("props").alias("ChangeDescription"),
            F.col("ts").alias("ChangeTimestamp"),
        )

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def checked_table(self, name: str) -> DataFrame:
        """A rental table whose columns must be those of ``SCHEMAS`` (names, order, types)."""
        df = self.table(name)
        declared = [(f.name, f.dataType.simpleString()) for f in SCHEMAS[name].fields]
        if df.dtypes != declared:
            raise TypeError(f"{name}: columns {df.dtypes}, declared {declared}")
        return df

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.checked_table(name) for name in SCHEMAS}

    # -- request feeds (inputs of the command operators) ----------------------
    def booking_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("purchase").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            (F.col("user_id") + 1).cast("int").alias("UserID"),
            (F.lit(1) + (key * 13) % self._count("part")).cast("int").alias("VehicleID"),
            (F.lit(1) + key % self._count("supplier")).cast("int").alias("StartStationID"),
            (F.lit(0.25) * (F.lit(1) + key % 16)).cast(RATE).alias("DurationHours"),
        )

    def end_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("view").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            (F.lit(1) + (key * 7) % self._count("orders", 50)).cast("int").alias("TripID"),
            (F.lit(1) + key % self._count("supplier", 1)).cast("int").alias("EndStationID"),
        )

    def cancel_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("signup").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            (F.lit(1) + (key * 11) % self._count("orders", 50)).cast("int").alias("TripID"),
        )

    def topup_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("click").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            (F.col("user_id") + F.when(key % 50 == 3, 1_000_000_000).otherwise(1)).cast("int").alias("UserID"),
            F.when(key % 20 == 0, "abc")
            .when(key % 20 == 1, "-5")
            .when(key % 20 == 2, F.lit(None).cast("string"))
            .otherwise(F.col("value").cast(MONEY).cast("string"))
            .alias("amount"),
        )

    def report_requests(self) -> DataFrame:
        ev = self._events("error").alias("e")
        orders = self.raw("orders").select("o_orderkey", "o_custkey").alias("o")
        key = F.col("e.event_id")
        joined = ev.join(orders, (F.col("o.o_orderkey") == key) & (key % 5 == 0), "left")
        return joined.select(
            key.alias("RequestID"),
            F.col("e.ts").alias("RequestTime"),
            F.when(key % 10 == 0, F.lit(None))
            .when(F.col("o.o_orderkey").isNull(), F.col("e.user_id") + 1)
            .otherwise(F.col("o.o_custkey") + 1)
            .cast("int")
            .alias("UserID"),
            F.when(key % 5 == 0, "user").otherwise("admin").alias("user_role"),
            (F.lit(1) + F.coalesce(F.col("o.o_orderkey"), key) % self._count("part")).cast("int").alias("VehicleID"),
            F.when(key % 40 == 7, "   ").otherwise(F.concat(F.lit("fault "), F.col("e.props"))).alias("IssueReported"),
        )

    def register_requests(self) -> DataFrame:
        key = F.col("event_id")
        prefix = F.when(key % 2 == 0, "USER").otherwise("user")
        n = (key * 3) % (self._count("customer") * 2)
        return self._events("signup").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            F.concat(F.lit("New User "), key.cast("string")).alias("name"),
            F.concat(prefix, n.cast("string"), F.lit("@example.com")).alias("email"),
            F.col("props").alias("password"),
        )

    def purchase_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("purchase").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            (F.col("user_id") + 1).cast("int").alias("UserID"),
            (F.lit(1) + key % 4).cast("int").alias("PlanID"),
        )

    def review_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("view").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            (F.lit(1) + (key * 5) % self._count("orders", 50)).cast("int").alias("TripID"),
            F.when(key % 25 == 0, "x").otherwise((key % 7).cast("string")).alias("rating"),
            F.col("props").alias("comment"),
        )

    def complete_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("error").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            F.when(key % 8 == 0, "user").otherwise("admin").alias("user_role"),
            (F.lit(1) + key).cast("int").alias("LogID"),
        )


    def mixed_requests(self) -> DataFrame:
        """All kinds M1 to M9 in one table, in event order.

        ``Ref`` is the nearest booking (of completions: report) before the event among its 64
        neighbours; a tenth of the vehicles takes all bookings, so most are booked, freed and booked again.
        """
        key, kind = F.col("event_id"), F.col("event_type")
        name = (
            F.when(kind == "purchase", "book")
            .when(kind == "view", F.when(key % 3 < 2, "end").otherwise("review"))
            .when(kind == "signup", F.when(key % 2 == 0, "cancel").otherwise("register"))
            .when(kind == "click", F.when(key % 3 < 2, "topup").otherwise("purchase"))
            .otherwise(F.when(key % 2 == 0, "report").otherwise("complete")))
        vehicle = F.lit(1) + (key * 13) % F.greatest(F.floor(self._count("part") / 10).cast("bigint"), F.lit(1))
        ev = self.raw("events").select(
            key.alias("RequestID"), F.col("ts").alias("RequestTime"), name.alias("Kind"), (F.col("user_id") + 1).cast("int").alias("__user"),
            vehicle.cast("int").alias("__vehicle"), "value", "props")
        near = Window.partitionBy(F.floor(F.col("RequestID") / 64)).orderBy("RequestID").rowsBetween(Window.unboundedPreceding, -1)

        def last(what: str) -> Column:
            return F.last(F.when(F.col("Kind") == what, F.struct("RequestID", "__user", "__vehicle")), ignorenulls=True).over(near)

        rid = F.col("RequestID")
        ev = ev.withColumn("__booked", last("book")).withColumn("__reported", last("report"))
        own = (F.col("Kind") == "report") & (rid % 5 == 0)  # riders report the vehicle they booked
        ref = (F.when(F.col("Kind").isin("end", "cancel", "review") & (rid % 4 != 0), F.col("__booked.RequestID"))
               .when((F.col("Kind") == "complete") & (rid % 4 != 1), F.col("__reported.RequestID")))
        return ev.select(
            "RequestID", "RequestTime", "Kind",
            F.when(own, F.col("__booked.__user")).otherwise(F.col("__user")).alias("UserID"),
            F.when(rid % 5 == 0, "user").otherwise("admin").alias("user_role"),
            F.when(own, F.col("__booked.__vehicle")).otherwise(F.col("__vehicle")).alias("VehicleID"),
            (F.lit(1) + rid % self._count("supplier", 1)).cast("int").alias("StationID"),
            (F.lit(0.25) * (F.lit(1) + rid % 16)).cast(RATE).alias("DurationHours"),
            (F.lit(1) + (rid * 7) % self._count("orders", 50)).cast("int").alias("TripID"),
            (F.lit(1) + rid - rid % 8).cast("int").alias("LogID"),
            (F.lit(1) + rid % 4).cast("int").alias("PlanID"),
            ref.alias("Ref"),
            F.when(rid % 20 == 0, "abc").when(rid % 20 == 1, "-5").when(rid % 20 == 2, F.lit(None).cast("string"))
            .otherwise((F.col("value") * 20).cast(MONEY).cast("string")).alias("amount"),
            F.when(rid % 40 == 6, "   ").otherwise(F.concat(F.lit("fault "), F.col("props"))).alias("IssueReported"),
            F.when(rid % 25 == 0, "x").otherwise((rid % 7).cast("string")).alias("rating"),
            F.col("props").alias("comment"),
            F.concat(F.lit("New User "), rid.cast("string")).alias("name"),
            F.concat(F.when(rid % 4 == 1, "USER").otherwise("user"), ((rid * 3) % (self._count("customer") * 2)).cast("string"),
                     F.lit("@example.com")).alias("email"),
            F.col("props").alias("password"),
        )

    # -- feeds for the admin / profile commands (M10-M17) -----------------------
    def profile_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("view").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            (F.lit(1) + (key * 3) % self._count("customer", 10)).cast("int").alias("UserID"),
            F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Renamed "), key.cast("string"))).alias("name"),
            F.when(key % 4 == 0, F.lit(None)).otherwise(F.col("props")).cast("string").alias("password"),
        )

    def station_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("signup").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            F.when(key % 7 == 0, "user").otherwise("admin").alias("user_role"),
            F.concat(F.lit("Station "), key.cast("string")).alias("name"),
            F.when(key % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("Zone "), (key % 50).cast("string"))).alias("location"),
            (key % 40).cast("int").alias("capacity"),
        )

    def deactivate_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("click").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            F.when(key % 9 == 0, "user").otherwise("admin").alias("user_role"),
            (F.lit(1) + (key * 7) % self._count("supplier", 6)).cast("int").alias("StationID"),
        )

    def vehicle_add_requests(self) -> DataFrame:
        key = F.col("event_id")
        n_part = self._count("part")
        return self._events("purchase").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            F.when(key % 8 == 0, "user").otherwise("admin").alias("user_role"),
            F.when(key % 13 == 0, F.lit("")).otherwise(F.lit("Scooter")).alias("type"),
            F.concat(F.lit("Model "), (key % 97).cast("string")).alias("model"),
            F.concat(F.lit("Maker "), (key % 11).cast("string")).alias("manufacturer"),
            F.col("value").cast(MONEY).alias("rate_per_hour"),
            F.when(key % 10 == 0, F.concat(F.lit("ka-"), F.lpad((key % n_part).cast("string"), 8, "0")))
            .otherwise(F.concat(F.lit("KA-NEW-"), (key % 700).cast("string")))
            .alias("registration_number"),
            F.when(key % 9 == 0, F.lit(None))
            .otherwise(F.lit(1) + key % self._count("supplier", 3))
            .cast("int")
            .alias("station_id"),
        )

    def decommission_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("error").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            F.when(key % 6 == 0, "user").otherwise("admin").alias("user_role"),
            (F.lit(1) + (key * 3) % self._count("part", 20)).cast("int").alias("VehicleID"),
        )

    def technician_add_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("view").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            F.when(key % 5 == 0, "user").otherwise("admin").alias("user_role"),
            F.concat(F.lit("Tech "), key.cast("string")).alias("name"),
            F.when(key % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Spec "), (key % 6).cast("string")))
            .alias("specialization"),
        )

    def technician_update_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("click").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            F.when(key % 10 == 0, "user").otherwise("admin").alias("user_role"),
            (F.lit(1) + key % 30).cast("int").alias("TechnicianID"),
            F.when(key % 3 == 0, F.concat(F.lit("Tech "), key.cast("string"))).alias("name"),
            F.when(key % 5 == 0, F.concat(F.lit("Spec "), (key % 6).cast("string"))).otherwise(F.lit(""))
            .alias("specialization"),
            F.when(key % 4 == 0, key % 8 == 0).alias("is_available"),
        )

    def technician_delete_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("error").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            F.when(key % 7 == 0, "user").otherwise("admin").alias("user_role"),
            (F.lit(1) + key % 30).cast("int").alias("TechnicianID"),
        )

    def onboard_requests(self) -> DataFrame:
        key = F.col("event_id")
        n_cust = self._count("customer")
        email = (F.when(key % 6 == 0, F.concat(F.lit("user"), (key % n_cust).cast("string")))
                 .otherwise(F.concat(F.lit("new"), ((key * 7) % (n_cust * 2)).cast("string"))))
        return self._events("signup").select(
            key.alias("RequestID"),
            F.col("ts").alias("RequestTime"),
            F.concat(F.lit("Onboard "), key.cast("string")).alias("name"),
            F.concat(email, F.lit("@example.com")).alias("email"),
            F.col("props").alias("password"),
            F.when(key % 9 == 0, F.lit("0")).when(key % 9 == 1, F.lit("abc"))
            .otherwise((F.col("value").cast(MONEY) * 100).cast(MONEY).cast("string")).alias("topup"),
            F.when(key % 7 == 0, F.lit(None)).otherwise(F.lit(1) + key % 4).cast("int").alias("PlanID"),
        )


    # -- dirty copies: inputs of the data-quality rules only ---------------------
    def redelivered_requests(self) -> DataFrame:
        """Booking requests, some delivered twice."""
        feed = self.booking_requests().select("RequestID", "UserID")
        return feed.unionByName(feed.where(F.col("RequestID") % 25 == 4))

    def imported_users(self) -> DataFrame:
        """Users as a careless import leaves them: unknown roles, overlong names, missing e-mails."""
        key = F.col("UserID")
        return self.users().select(
            "UserID",
            F.when(key % 40 == 7, F.concat("Name", F.lit(" "), F.repeat(F.lit("x"), 100))).otherwise(F.col("Name")).alias("Name"),
            F.when(key % 40 != 9, F.col("Email")).alias("Email"),
            F.when(key % 40 == 11, "root").otherwise(F.col("Role")).alias("Role"),
        )


def load(spark: SparkSession, sf_dir: str) -> TestData:
    return TestData(spark, sf_dir)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """SRC1: typed load of the 11 rental tables."""
    return TestData(spark, sf_dir).tables()

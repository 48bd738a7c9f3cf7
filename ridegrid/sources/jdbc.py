"""SRC3: reading the operational database with Spark's JDBC source.

Only the option builder lives here; no driver for the reference's database
is on this classpath, so nothing connects in tests.  ``partition_column``
splits the scan into ``num_partitions`` parallel range queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridegrid.schemas import PRIMARY_KEYS, SCHEMAS

# Table names in the operational database (the reference's DDL names).
SOURCE_NAMES = {
    "membership_plans": "MembershipPlans", "users": "Users", "stations": "Stations", "vehicles": "Vehicles",
    "trips": "Trips", "payments": "Payments", "technicians": "Technicians", "maintenance_logs": "MaintenanceLogs",
    "technician_assignments": "TechnicianAssignments", "reviews": "Reviews", "logs": "Logs",
}


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 num_partitions: int = 8, bounds: tuple[int, int] | None = None,
                 fetch_size: int = 10_000) -> dict[str, str]:
    """Options for ``spark.read.format("jdbc")``; partitions on the table's integer key when bounds are given."""
    opts = {"url": url, "dbtable": SOURCE_NAMES[table], "fetchsize": str(fetch_size)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if bounds is not None:
        opts.update(partitionColumn=PRIMARY_KEYS[table], lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
                    numPartitions=str(num_partitions))
    return opts


def jdbc_tables(spark: SparkSession, url: str, props: dict | None = None,
                bounds: dict[str, tuple[int, int]] | None = None) -> dict[str, DataFrame]:
    """Lazy JDBC readers for the 11 tables, cast to the model's schemas."""
    props = props or {}
    bounds = bounds or {}
    out = {}
    for table, schema in SCHEMAS.items():
        opts = jdbc_options(url, table, bounds=bounds.get(table), **props)
        df = spark.read.format("jdbc").options(**opts).load()
        out[table] = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    return out

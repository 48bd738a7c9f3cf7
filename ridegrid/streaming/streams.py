"""Structured Streaming versions of the audit and command operators.

* ``stream_audit`` (S1): change rows arriving as files -> audit rows; a
  stateless projection appended to a Parquet sink.
* ``stream_commands`` (S2): requests applied batch by batch with
  ``foreachBatch``.  Each micro-batch reads the newest snapshot, runs the batch
  operator and writes the next version (partition ``_version=<batch id>``) with
  dynamic partition overwrite, so a replayed batch rewrites its own version and
  nothing else (idempotent); versions that no replay can need any more are
  removed.  Redelivered requests are removed by an anti join with the ids that
  earlier batches applied, however late they come; no request is dropped for its time.
* ``stream_vehicle_state`` (S3): per-vehicle status and station from the
  decided events of the commands, by built-in streaming aggregates.  Per
  vehicle the state keeps the last status-setting event, the last moving event and
  the last report, each the maximum in (RequestTime, RequestID, kind) order:
  maxima do not depend on the order of delivery and ignore repeated events, and
  they combine before the shuffle, so a busy vehicle is one row per task.

All folders (sources, sinks, streaming checkpoints) live under the shared
checkpoint folder of the cluster.  ``queries()`` runs these with
``trigger(availableNow=True)`` and returns the sink read back as a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridegrid.operators import audit as A
from ridegrid.operators import commands as C
from ridegrid.session import ensure_checkpoint_dir, remember
from ridegrid.sources.sinks import VERSION, drop_snapshots, newest_version, read_snapshot, write_snapshot

FILES_PER_BATCH = 4


def _folder(spark: SparkSession, label: str) -> str:
    return remember(f"{ensure_checkpoint_dir(spark).rstrip('/')}/ridegrid-{label}-{uuid.uuid4().hex}")


def stage_files(df: DataFrame, label: str) -> str:
    """Write ``df`` as the source folder of a stream, in as many files as Spark's partitions give."""
    path = _folder(df.sparkSession, label)
    df.write.parquet(path)
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _run(writer) -> None:
    """Run the stream over everything available, however long that takes; a failed stream raises."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


# ----------------------------------------------------------------------------- S1
def stream_audit(spark: SparkSession, changes: DataFrame, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    src = stage_files(changes, "changes")
    out, ckpt = _folder(spark, "audit-out"), _folder(spark, "audit-ckpt")
    stream = spark.readStream.schema(C.CHANGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(src)
    rows = stream.where(A.fires()).select(
        "RequestID", "Step", "Sub", "TableName", "OperationType", "RecordID",
        A.message().alias("ChangeDescription"), "ChangeTimestamp")
    _run(rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", ckpt).option("path", out))
    return spark.read.schema(rows.schema).parquet(out)


# ----------------------------------------------------------------------------- S2
def stream_commands(spark: SparkSession, arrivals: list[DataFrame], tables: dict[str, DataFrame],
                    apply: Callable[[DataFrame, dict[str, DataFrame]], dict[str, DataFrame]],
                    workdir: str | None = None, files_per_batch: int | None = None) -> dict[str, DataFrame]:
    """Apply a command operator to a stream of requests; returns the last snapshots of ``tables``.

    Each element of ``arrivals`` is added to the source folder and worked off before
    the next one comes.  ``apply(batch, tables)`` returns the tables that it changed.
    Inside a micro-batch requests are applied in RequestID order, and batches in
    order of arrival; a batch holds all files at hand, or ``files_per_batch`` where the order of
    files does not matter.  With ``workdir`` the source, state and checkpoint folders are fixed, so a
    second call resumes from the checkpoint (and, with no new arrivals, changes
    nothing); without it every call starts fresh.
    """
    work = workdir or _folder(spark, "commands")
    src, ckpt, applied = f"{work}/source", f"{work}/checkpoint", f"{work}/applied"
    state = {name: f"{work}/state/{name}" for name in tables}
    for name, df in tables.items():
        if not _exists(spark, state[name]):
            write_snapshot(df, state[name], -1)

    def first_deliveries(batch: DataFrame, batch_id: int) -> DataFrame:
        once = batch.dropDuplicates(["RequestID"])
        if not _exists(spark, applied):
            return once
        low, high = batch.agg(F.min("RequestID"), F.max("RequestID")).first()
        ids = T.StructType([batch.schema["RequestID"], T.StructField(VERSION, T.LongType())])
        seen = spark.read.schema(ids).parquet(applied).where(
            (F.col(VERSION) < batch_id) & (F.col("RequestID").isNull() | F.col("RequestID").between(low, high)))
        return once.join(seen.select(F.col("RequestID").alias("__seen")), F.col("RequestID").eqNullSafe(F.col("__seen")), "left_anti")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = first_deliveries(batch, batch_id)
        base = {name: newest_version(spark.read, path, batch_id) for name, path in state.items()}
        now = {name: read_snapshot(spark.read, path, base[name]) for name, path in state.items()}
        for name, df in apply(batch, now).items():
            if name in state:
                write_snapshot(df, state[name], batch_id)
        write_snapshot(batch.select("RequestID"), applied, batch_id)
        for name, path in state.items():
            drop_snapshots(spark, path, base[name])  # a replay of this batch needs ``base``

    def work_off() -> None:
        stream = spark.readStream.schema(spark.read.parquet(src).schema)
        if files_per_batch is not None:
            stream = stream.option("maxFilesPerTrigger", files_per_batch)
        _run(stream.parquet(src).writeStream.foreachBatch(step).option("checkpointLocation", ckpt))

    for arrival in arrivals:
        arrival.write.mode("append").parquet(src)
        work_off()
    if not arrivals and _exists(spark, src):
        work_off()
    return {name: read_snapshot(spark.read, path) for name, path in state.items()}


def in_arrivals(requests: DataFrame, parts: int = 2) -> list[DataFrame]:
    """Consecutive ranges of RequestID, as they would arrive one after the other."""
    cuts = requests.select(F.percentile_approx("RequestID", [i / parts for i in range(1, parts)])).first()[0] or []
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        part = requests
        if low is not None:
            part = part.where(F.col("RequestID") > low)
        if high is not None:
            part = part.where(F.col("RequestID") <= high)
        out.append(part)
    return out


def stream_topups(spark: SparkSession, requests: DataFrame, users: DataFrame, workdir: str | None = None,
                  arrivals: list[DataFrame] | None = None) -> DataFrame:
    """M7 as a stream: the last users snapshot.  Top-ups commute, so files may arrive in any order."""
    return stream_commands(spark, [requests] if arrivals is None else arrivals, {"users": users},
                           lambda batch, now: C.wallet_topups(batch, now["users"]).tables,
                           workdir, FILES_PER_BATCH)["users"]


# ----------------------------------------------------------------------------- S3
VEHICLE_EVENT_SCHEMA = "VehicleID int, RequestID long, RequestTime timestamp_ntz, Kind string, StationID int, Status string"
# Tie-break when two command feeds carry the same request id and time (a total event order).
KIND_RANK = {"snapshot": 0, "book": 1, "end": 2, "cancel": 3, "report": 4, "complete": 5, "decommission": 6}
SETS_STATUS = {"book": "in-use", "end": "available", "cancel": "available", "complete": "available",
               "decommission": "decommissioned"}


def vehicle_events(snapshot: DataFrame, *decided: DataFrame) -> DataFrame:
    """Snapshot rows (ordered before everything) plus decided command events."""
    out = snapshot.select("VehicleID", F.lit(-1).cast("long").alias("RequestID"),
                          F.lit("1900-01-01 00:00:00").cast("timestamp_ntz").alias("RequestTime"),
                          F.lit("snapshot").alias("Kind"), F.col("CurrentStationID").alias("StationID"), "Status")
    for d in decided:
        out = out.unionByName(d.select("VehicleID", "RequestID", "RequestTime", "Kind", "StationID",
                                       F.lit(None).cast("string").alias("Status")))
    return out


def _choose(values: dict[str, Column], otherwise: Column) -> Column:
    expr = None
    for kind, value in values.items():
        cond = F.col("Kind") == kind
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(otherwise)


def vehicle_state(events: DataFrame) -> DataFrame:
    """Per vehicle: the last status-setting event, the last moving one, the last report (batch or stream)."""
    rank = _choose({k: F.lit(v) for k, v in KIND_RANK.items()}, F.lit(-1))
    order = (F.col("RequestTime").alias("t"), F.col("RequestID").alias("r"), rank.alias("k"))
    status = _choose({k: F.lit(v) for k, v in SETS_STATUS.items()}, F.col("Status"))
    sets = F.col("Kind").isin("snapshot", *SETS_STATUS)
    moves = F.col("Kind").isin("snapshot", "end", "cancel")
    return events.groupBy("VehicleID").agg(
        F.max(F.when(sets, F.struct(*order, status.alias("Status")))).alias("set"),
        F.max(F.when(moves, F.struct(*order, F.col("StationID")))).alias("move"),
        F.max(F.when(F.col("Kind") == "report", F.struct(*order))).alias("report"),
    )


def current_state(state: DataFrame) -> DataFrame:
    """(VehicleID, Status, CurrentStationID): a report after the last setting event takes an available vehicle out."""
    last_set = F.struct("set.t", "set.r", "set.k")
    reported = F.col("report").isNotNull() & (F.col("set").isNull() | (F.col("report") > last_set))
    status = F.when((F.col("set.Status") == "available") & reported, F.lit("under-maintenance")).otherwise(F.col("set.Status"))
    return state.select("VehicleID", status.alias("Status"), F.col("move.StationID").alias("CurrentStationID"))


def stream_vehicle_state(spark: SparkSession, events: DataFrame, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """S3: the state table after all events; the sink gets the changed vehicles of every batch."""
    src = stage_files(events, "vehicle-events")
    out, ckpt = _folder(spark, "vehicle-state-out"), _folder(spark, "vehicle-state-ckpt")
    stream = spark.readStream.schema(VEHICLE_EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(src)
    state = vehicle_state(stream)

    def keep(batch: DataFrame, batch_id: int) -> None:
        write_snapshot(batch, out, batch_id)  # the changed vehicles; a replayed batch replaces its own version

    _run(state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", ckpt))
    changed = spark.read.parquet(out)
    newest = changed.groupBy("VehicleID").agg(F.max_by(F.struct("set", "move", "report"), "_version").alias("s"))
    return current_state(newest.select("VehicleID", "s.*"))

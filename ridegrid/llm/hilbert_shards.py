"""Operator 4: sharding by Hilbert-curve order of several metadata dimensions.

Built from DataFrame functions only.  Each dimension is quantised to
``2**bits`` bins of near-equal row counts: the distinct values are ranked with
their counts (a distributed sort), and a value's bin is its position in the
cumulated counts.  A row's bins form a cell; the cell's index on the Hilbert
curve orders the rows; the order is cut into ``shards`` runs whose row counts
differ by at most one (law ``rows``).  Neighbouring cells share most of their
bins, so each shard covers a narrow range of every dimension, which file
statistics turn into pruning.

Defined results: a null dimension value is its own lowest value.  Ties on the
curve follow the text checksum, the size and the id, so equal texts of one
cell are neighbours; rows equal in all of these are interchangeable.
Fewer rows than shards leave the last shards' runs empty.  Only the named
columns are read; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridegrid.llm.common import fresh, stage
from ridegrid.operators.ids import global_rank

BITS = 5
SHARDS = 8


def curve_table(dims: int) -> tuple[list[int], list[int]]:
    """The Hilbert curve's state machine: (digit of the index, next state) per state and cell digit.

    A state is (entry corner, direction); its number is entry * dims + direction.
    """
    full = (1 << dims) - 1

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def rank(g: int) -> int:
        i = 0
        while g:
            i ^= g
            g >>= 1
        return i

    def low_ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x >> by) | (x << (dims - by))) & full

    digit, follow = [], []
    for entry in range(1 << dims):
        for direction in range(dims):
            for cell in range(1 << dims):
                w = rank(turn(cell ^ entry, direction + 1))
                start = 0 if w == 0 else gray((w - 1) // 2 * 2)
                along = 0 if w == 0 else low_ones(w - 1 if w % 2 == 0 else w) % dims
                nxt = entry ^ turn(start, dims - (direction + 1) % dims)
                digit.append(w)
                follow.append(nxt * dims + (direction + along + 1) % dims)
    return digit, follow


def hilbert_index(bins: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of the cell with these bins (0 to 2**bits - 1 each)."""
    dims = len(bins)
    digit, follow = curve_table(dims)
    digits, follows = F.array(*[F.lit(x) for x in digit]), F.array(*[F.lit(x) for x in follow])
    coords = F.array(*[b.cast("int") for b in bins])

    def step(acc: Column, level: Column) -> Column:
        cell = F.lit(0)
        for d in range(dims):
            bit = F.call_function("shiftright", coords[d], level).bitwiseAND(F.lit(1))
            cell = cell + bit * F.lit(1 << d)
        at = acc["state"] * F.lit(1 << dims) + cell + F.lit(1)
        return F.struct(
            (acc["index"] * F.lit(1 << dims) + F.element_at(digits, at)).cast("long").alias("index"),
            F.element_at(follows, at).cast("int").alias("state"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).cast("int").alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda acc: acc["index"])


def _bins(df: DataFrame, dim: str, bits: int) -> DataFrame:
    """(value, bin) of one dimension: bins of near-equal row counts, in value order."""
    counts = df.groupBy(F.col(dim).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = global_rank(counts.withColumn("present", F.col("value").isNotNull()), ["present", "value"], "r")
    # Cumulated counts in two levels: within blocks of ranks, then over block totals.
    block = F.floor(F.col("r") / 4096)
    inner = Window.partitionBy("block").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    blocked = ranked.withColumn("block", block)
    outer = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("block").agg(F.sum("n").alias("t"))  # one row per 4096 distinct values
    before = totals.select("block", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("before"))
    total = ranked.agg(F.sum("n")).scalar()
    at = F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0))
    cum = blocked.join(before, "block").withColumn("at", at)
    return cum.select("value", F.expr(f"at * {1 << bits}").alias("scaled")).select(
        "value", F.floor(F.col("scaled") / total).cast("int").alias("bin"))


def hilbert_order(rows: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """Add ``hilbert`` to ``rows``: the curve index of the row's cell."""
    out = rows
    for i, dim in enumerate(dims):
        bins = _bins(rows, dim, bits).select(F.col("value").alias(f"__v{i}"), F.col("bin").alias(f"__b{i}"))
        out = out.join(bins, out[dim].eqNullSafe(F.col(f"__v{i}")), "left").drop(f"__v{i}")
    index = hilbert_index([F.col(f"__b{i}") for i in range(len(dims))], bits)
    return out.withColumn("hilbert", index).drop(*[f"__b{i}" for i in range(len(dims))])


def assign_shards(
    docs: DataFrame, dims: tuple[str, ...] = ("lang", "source"), shards: int = SHARDS, bits: int = BITS,
    text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert.

    The size in bytes is always the first dimension.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            *[F.col(d).cast("string").alias(f"dim{i}") for i, d in enumerate(dims)],
        ), "shard-rows")
    placed = hilbert_order(slim, ["size", *[f"dim{i}" for i in range(len(dims))]], bits)
    ranked = global_rank(placed, ["hilbert", "text_crc32", "size", "doc_id"], "r")
    n = slim.agg(F.count(F.lit(1))).scalar()
    pos = F.col("r") - 1
    shard = F.expr(f"(r - 1) * {shards} div n")
    return (
        ranked.withColumn("n", n).withColumn("shard", shard.cast("int"))
        .withColumn("first", F.expr(f"(shard * n + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                (pos - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")
    )


def write_shards(docs: DataFrame, path: str, dims: tuple[str, ...] = ("lang", "source"), shards: int = SHARDS,
                 text_col: str = "text", id_col: str = "doc_id") -> None:
    """Write ``docs`` (all columns) as one folder per shard, rows in curve order inside each file.

    ``id_col`` must be unique.  Several files per shard at scale: each shard is
    split by slot ranges, so no task holds a whole shard.
    """
    key, shard, slot = fresh(docs, "shard_key"), fresh(docs, "shard"), fresh(docs, "shard_slot")
    placed = assign_shards(docs, dims, shards, BITS, text_col, id_col).select(
        F.col("doc_id").alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot))
    (
        docs.join(placed, docs[id_col].eqNullSafe(F.col(key))).drop(key)
        .repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
        .drop(slot).write.partitionBy(shard).parquet(path)
    )

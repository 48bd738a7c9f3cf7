"""Operator 1: exact deduplication with an extendible-hash index on shared files.

Built from DataFrame functions only.

* ``fingerprints``: one slim entry per row (row id, doc_id, 64-bit key, SHA-256),
  written to the shared folder.
* ``directory``: the extendible-hash directory.  A bucket is a prefix of the key
  bits.  Starting from one bucket, a bucket with more than ``capacity``
  distinct keys splits on its next bit, and the directory doubles whenever a
  split needs more bits than it has.  The doubling is computed from counts per
  prefix at every depth, so it costs one aggregation of slim rows.  Equal texts
  have one key and count once, so a hot text cannot overfill a bucket.
* ``chains``: texts are pre-aggregated per map task by (key, SHA-256, bytes):
  the hash aggregate compares the bytes themselves and at most one copy of a
  text leaves a task, however often it repeats.  Each owner task holds whole
  buckets and numbers the texts that share a key (the collision chain).
* rows find their chain entry by (key, SHA-256).  Were two different texts to
  share both, the run stops with an error rather than merge them.

Defined results: null text counts as empty.  Null doc_id is below every
number.  Rows that repeat doc_id and text are all returned and exactly one of
them stays.  Empty tables give empty results.  Other columns never take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridegrid.llm.common import ascii_lower, fresh, stage

CAPACITY = 1 << 12  # distinct keys a bucket holds before it splits
MAX_DEPTH = 20  # key bits that the directory can use; beyond them keys chain in their bucket
KEY_BITS = 64


def _keyed(docs: DataFrame, text_col: str, id_col: str, key_bits: int) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm"))
    key = F.xxhash64("norm")
    return rows.withColumn("key", F.shiftleft(key, KEY_BITS - key_bits) if key_bits < KEY_BITS else key)


def _prefix(key: Column | str, depth: Column | int) -> Column:
    """The first ``depth`` bits of the key (0 for depth 0)."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    k = F.col(key) if isinstance(key, str) else key
    return F.when(d == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", k, (KEY_BITS - d).cast("int")))


def directory(fingerprints: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Buckets of the extendible hash: (depth, prefix, keys), covering every key exactly once."""
    cells = (
        fingerprints.select("key").distinct()
        .groupBy(_prefix("key", max_depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    )
    levels = cells.select(
        "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"), "cell"
    ).select("n", "depth", F.call_function("shiftright", F.col("cell"), F.lit(max_depth) - F.col("depth")).alias("prefix"))
    sized = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("keys"))
    parent = sized.select(
        (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("keys").alias("up_keys"))
    split = sized.withColumn("up", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
    joined = split.join(parent, ["depth", "up"], "left")
    # A leaf: its parent had to split, it need not (or cannot).
    return joined.where(
        ((F.col("keys") <= capacity) | (F.col("depth") == max_depth))
        & (F.col("up_keys").isNull() | (F.col("up_keys") > capacity))
    ).select("depth", "prefix", "keys")


def slots(buckets: DataFrame) -> tuple[DataFrame, int]:
    """The directory as a table: 2**depth slots, each naming its bucket; and its global depth (one number)."""
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    spread = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(depth) - F.col("depth")).cast("int"))
    first = F.col("prefix") * spread
    return buckets.select(
        F.concat_ws("/", F.col("depth").cast("string"), F.col("prefix").cast("string")).alias("bucket"),
        F.explode(F.sequence(first, first + spread - 1)).alias("slot"),
    ), depth


def exact_groups(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY,
    max_depth: int = MAX_DEPTH, key_bits: int = KEY_BITS,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain_slot."""
    keyed = _keyed(docs, text_col, id_col, key_bits)
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    rows = stage(
        keyed.select("doc_id", "key", F.unhex(sha).alias("sha"), F.monotonically_increasing_id().alias("rid")),
        "dedup-rows",
    )
    buckets = stage(directory(rows, capacity, max_depth), "dedup-directory")
    texts = keyed.select("key", F.unhex(sha).alias("sha"), "norm").distinct()  # compares bytes, combines map-side
    table, depth = slots(buckets)
    owned = texts.select("key", "sha", _prefix("key", depth).alias("slot")).join(table, "slot")
    chain = Window.partitionBy("bucket").orderBy("key", "sha")
    in_key = Window.partitionBy("bucket", "key").orderBy("sha")
    index = owned.select(
        "key", "sha", "bucket", F.row_number().over(in_key).alias("chain_slot"),
        (F.lag("key").over(chain).eqNullSafe(F.col("key")) & F.lag("sha").over(chain).eqNullSafe(F.col("sha"))).alias("clash"),
    ).select(
        "key", "sha", "bucket",
        F.when(F.col("clash"), F.raise_error(F.lit("two texts share key and SHA-256")).cast("int"))
        .otherwise(F.col("chain_slot")).alias("chain_slot"),
    )
    winner = rows.groupBy("key", "sha").agg(
        F.max(F.struct("doc_id", "rid")).alias("win"), F.count(F.lit(1)).alias("group_size"))
    # Written first: a join of two plain scans is one that Spark can split where a text is hot.
    groups = stage(index.join(winner, ["key", "sha"]), "dedup-groups")
    return rows.join(groups, ["key", "sha"]).select(
        "doc_id", F.col("win.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("win.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain_slot",
    )


def drop_exact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of equal texts the row with the largest id stays; all columns of ``docs`` are returned.

    Of rows that repeat id and text, one stays.
    """
    rid = fresh(docs, "row_number")
    staged = stage(docs.withColumn(rid, F.monotonically_increasing_id()), "dedup-docs")
    slim = staged.select(F.struct(F.col(id_col).alias("id"), F.col(rid).alias("rid")).alias("row"), F.col(text_col).alias("text"))
    # The pair (id, row id) is the id here: it is unique and orders as the id does.
    losers = exact_groups(slim, "text", "row").where(~F.col("kept")).select(F.col("doc_id.rid").alias(rid))
    return staged.join(losers, rid, "left_anti").drop(rid)
